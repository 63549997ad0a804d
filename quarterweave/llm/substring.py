"""Substring de-duplication: windows of words that an earlier document already holds are removed.

Method: super-k-mer partitioning. Consecutive windows that share their minimiser (the word triple of lowest order in
the window) travel as one packed string to the minimiser's bucket, where sorting groups equal windows exactly.
Triples that very many documents hold come last in the order, so that windows beside a common passage go by their
rarer words; a super-k-mer that a block of documents holds several times travels once, for its smallest document.
Super-k-mers of common triples are hot: their bucket is split by a salt of the sending task, each part keeps of equal
windows those of its smallest document, and only these meet in the whole bucket, in a second, small step.

Contract of `remove_repeats`: a null text counts as empty; texts shorter than a window lose nothing; rows with a null
id neither lose words nor make others lose them; repeated rows of one id are one document; other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import cache
from itertools import compress
from math import isqrt

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions_for, stage, tidy

WINDOW, TRIPLE = 13, 3
#: Bytes of text a task works on at once, words a bucket gets on average, and raw bytes held before a task sends.
BLOCK_BYTES, BUCKET_WORDS, SEND_BYTES = 1_500_000, 200_000, 16_000_000
#: Buckets per partition at first; beyond so many partitions only buckets become more. A partition holds one at a time.
FINE, MOST_PARTS = 2, 50_000
#: A triple in over this share of a block's documents, and of all documents, counts as common.
COMMON = 0.005

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


_SLAB = 1 << 16


@cache
def _powers(base: int) -> np.ndarray:
    """base to the 0, 1, ... power, one slab; what lies beyond is made of these and powers of a slab's width."""
    out = np.full(_SLAB, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Text:
    """Words of a text in which blanks and line feeds separate words, one between two; hashes of its stretches."""

    def __init__(self, text: bytes):
        raw = np.frombuffer(text, np.uint8)
        gaps = np.flatnonzero((raw == 32) | (raw == 10))
        self.start = np.concatenate(([0], gaps + 1))
        self.end = np.append(gaps, len(raw))
        self._sum = np.zeros(len(raw) + 1, np.uint64)
        for k in range(0, len(raw), _SLAB):
            part = raw[k : k + _SLAB]
            self._sum[k + 1 : k + 1 + len(part)] = part * _powers(_BASE)[: len(part)] * np.uint64(pow(_BASE, k, 1 << 64))
        np.cumsum(self._sum, out=self._sum)
        self._wide = np.array([pow(_BACK, k, 1 << 64) for k in range(0, len(raw) + 1, _SLAB)], np.uint64)

    def hashes(self, first: np.ndarray, words: int) -> np.ndarray:
        """Of the stretches of so many words that start at these words: alike wherever a stretch stands."""
        s, e = self.start[first], self.end[first + words - 1]
        return _mixed((self._sum[e] - self._sum[s]) * _powers(_BACK)[s % _SLAB] * self._wide[s // _SLAB])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, bytes, np.ndarray]]:
    """Ids, text hashes, joined texts and words of each text, by block, in order of id; texts without words are left out."""
    rows, held = [], 0

    def done():
        rows.sort(key=lambda r: r[:2])
        return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), b"\n".join([r[2] for r in rows]), np.array([r[2].count(b" ") + 1 for r in rows])

    for batch in batches:
        for doc, print_, text in zip(*(batch.column(k) for k in range(3)), strict=True):
            joined = b" ".join(text.as_py().split())
            if joined:
                rows.append((doc.as_py(), print_.as_py(), joined))
                held += len(joined)
            if held > BLOCK_BYTES:
                yield done()
                rows, held = [], 0
    if rows:
        yield done()


def _common(window: int):
    """(triple, documents, null) for triples common in a block, and one row (null, the block's words, its documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, text, sizes in _blocks(batches):
            doc = np.repeat(np.arange(len(sizes)), sizes)
            first = np.flatnonzero(doc[: 1 - TRIPLE or None] == doc[TRIPLE - 1 :]) if len(doc) >= TRIPLE else np.zeros(0, int)
            triples = _Text(text).hashes(first, TRIPLE)
            some = triples < np.uint64(1 << 61)  # the lowest eighth: what most minimisers are from
            order = np.lexsort((doc[first[some]], triples[some]))
            t, d = triples[some][order], doc[first[some]][order]
            fresh = np.concatenate(([True], (t[1:] != t[:-1]) | (d[1:] != d[:-1]))) if len(t) else np.zeros(0, bool)
            values, counts = np.unique(t[fresh], return_counts=True)
            often = counts > max(1, COMMON * len(ids))
            triple = [None, *values[often].view(np.int64).tolist()]
            docs = [len(ids), *[None] * (len(triple) - 1)]
            yield pa.record_batch([pa.array(triple, pa.int64()), pa.array([len(doc), *counts[often].tolist()], pa.int64()), pa.array(docs, pa.int64())], ["triple", "n", "docs"])

    return run


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[k], starts[k] + 1, ... sizes[k] of them, for all k."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(starts, sizes)


SENT = "kind int, bucket long, salt int, blob binary"


def _blob(docs: np.ndarray, prints: np.ndarray, starts: np.ndarray, pieces: list[bytes]) -> bytes:
    return np.int64(len(docs)).tobytes() + np.diff(docs, prepend=0).tobytes() + prints.astype(np.uint32).tobytes() + starts.astype(np.uint32).tobytes() + b"\n".join(pieces)


def _sent(rows: Iterator[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    """Rows (kind, bucket, salt, blob) to send: super-k-mers are kind 0, windows known as repeated kind 1."""
    squeeze = zstandard.ZstdCompressor(level=5)
    columns = list(zip(*((kind, bucket, salt, squeeze.compress(raw)) for kind, bucket, salt, raw in rows), strict=True))
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.int32(), pa.int64(), pa.int32(), pa.binary()], strict=True)], ["kind", "bucket", "salt", "blob"])


def _pack(window: int, buckets: int, common: np.ndarray, salts: int):
    """Super-k-mers of each task, packed by bucket; and the windows found repeated within a block."""
    span = window - TRIPLE + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[array, array, array, list[bytes]]] = {}
        held_bytes, own_salt = 0, 1 + TaskContext.get().partitionId() % salts

        def packed() -> Iterator[tuple[int, int, int, bytes]]:
            while held:  # what is compressed is let go at once
                (bucket, hot), (docs, prints, starts, pieces) = held.popitem()
                yield 0, bucket, own_salt if hot else 0, _blob(*(np.array(x) for x in (docs, prints, starts)), pieces)

        def take(ids: np.ndarray, prints: np.ndarray, joined: bytes, sizes: np.ndarray) -> tuple[list[tuple[int, int, int]], int]:
            """Holds a block's super-k-mers; what it returns is the windows known as repeated and the bytes now held more.
            The block's arrays end with the call, before the next block is read."""
            added = 0
            text = _Text(joined)
            begins = np.cumsum(sizes) - sizes
            triples = text.hashes(np.arange(int(sizes.sum()) - TRIPLE + 1), TRIPLE)  # those across texts lie in no window
            order = triples >> np.uint64(1)
            if len(common):
                at = np.minimum(np.searchsorted(common, triples), len(common) - 1)
                order[common[at] == triples] |= np.uint64(1 << 63)
            low, width = order, 1  # the lowest of the next `width`, doubled until a window is spanned
            while width < span:
                step = min(width, span - width)
                low = np.minimum(low[:-step], low[step:])
                width += step
            n_windows = np.maximum(sizes - window + 1, 0)
            windows = _runs(begins, n_windows)
            doc = np.repeat(np.arange(len(sizes)), n_windows)
            low = low[windows]
            first = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]))))
            count = np.diff(np.append(first, len(low)))
            at = windows[first]
            owner = doc[first]
            seen: dict[bytes, int] = {}
            known: list[tuple[int, int, int]] = []
            rows = zip(
                owner.tolist(), ids[owner].tolist(), (prints[owner] & 0xFFFFFFFF).tolist(), (at - begins[owner]).tolist(), count.tolist(),
                text.start[at].tolist(), text.end[at + count + window - 2].tolist(),
                zip((low[first] % np.uint64(buckets)).tolist(), (low[first] >> np.uint64(63)).tolist(), strict=True), strict=True,
            )
            for k, doc_id, print_, start, n, b, e, key in rows:
                piece = joined[b:e]
                if seen.setdefault(piece, doc_id) != doc_id:
                    if known and known[-1][0] == k and known[-1][1] + known[-1][2] == start:
                        known[-1] = (k, known[-1][1], known[-1][2] + n)
                    else:
                        known.append((k, start, n))
                    continue
                if (into := held.get(key)) is None:
                    into = held[key] = (array("q"), array("I"), array("I"), [])
                into[0].append(doc_id), into[1].append(print_), into[2].append(start), into[3].append(piece)
                added += e - b + 60
            return known, added

        for ids, prints, joined, sizes in _blocks(batches):
            if not (sizes >= window).any():
                continue
            known, added = take(ids, prints, joined, sizes)
            held_bytes += added
            if known:
                k, start, n = np.array(known, np.int64).T
                out = np.column_stack([ids[k], prints[k] & 0xFFFFFFFF, start, n])
                yield _sent(iter([(1, int(out[0, 0]) % buckets, 0, out.tobytes())]))
            if held_bytes > SEND_BYTES:
                yield _sent(packed())
                held_bytes = 0
        if held:
            yield _sent(packed())

    return run


def _repeats(blobs: list[bytes], window: int, rest: bool) -> tuple[np.ndarray, bytes]:
    """Rows (doc, print, first window, windows) of all windows in a bucket that a smaller document holds too; and, if
    asked for, the other windows packed as super-k-mers again."""
    docs, prints, starts, texts = [], [], [], []
    for blob in blobs:
        n = int(np.frombuffer(blob, np.int64, 1)[0])
        docs.append(np.cumsum(np.frombuffer(blob, np.int64, n, 8)))
        prints.append(np.frombuffer(blob, np.uint32, n, 8 + 8 * n).astype(np.int64))
        starts.append(np.frombuffer(blob, np.uint32, n, 8 + 12 * n).astype(np.int64))
        texts.append(blob[8 + 16 * n :])
    ids, print_, start = (np.concatenate(x) for x in (docs, prints, starts))
    joined = b"\n".join(texts)
    text = _Text(joined)
    last = np.flatnonzero(np.frombuffer(joined, np.uint8)[text.end[:-1]] == 10)  # the last word of each super-k-mer but one
    sizes = np.diff(np.concatenate(([-1], last, [len(text.start) - 1])))
    begins = np.cumsum(sizes) - sizes
    n_windows = sizes - window + 1
    at = _runs(begins, n_windows)  # where each window starts
    owner = np.repeat(np.arange(len(sizes)), n_windows)
    value = text.hashes(at, window)
    order = np.argsort(value, kind="stable")
    sorted_, place = value[order], at[order]
    new = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
    same = np.flatnonzero(~new)
    b, e = text.start[place], text.end[place + window - 1]
    words = [joined[x:y] for x, y in zip(b[same].tolist(), e[same].tolist(), strict=True)]
    equal = [joined[x:y] == w for x, y, w in zip(b[same - 1].tolist(), e[same - 1].tolist(), words, strict=True)]
    if not all(equal):  # different windows of one hash: number all of them by their words
        exact: dict[bytes, int] = {}
        clash = np.isin(value, sorted_[same[~np.array(equal)]])
        number = np.zeros(len(value), np.int64)
        for i in np.flatnonzero(clash).tolist():
            number[i] = exact.setdefault(joined[text.start[at[i]] : text.end[at[i] + window - 1]], len(exact))
        order = np.lexsort((number, value))
        v, m = value[order], number[order]
        new = np.concatenate(([True], (v[1:] != v[:-1]) | (m[1:] != m[:-1])))
    own_doc = ids[owner]
    least = np.minimum.reduceat(own_doc[order], np.flatnonzero(new))
    hit = np.zeros(len(at), bool)
    hit[order] = least[np.cumsum(new) - 1] < own_doc[order]

    def stretches(chosen: np.ndarray) -> tuple[np.ndarray, ...]:
        """Chosen windows next to each other in one super-k-mer: the first, how many, document, print and place there."""
        some = np.flatnonzero(chosen)
        opens = np.concatenate(([True], (np.diff(some) > 1) | (np.diff(owner[some]) > 0)))[: len(some)]
        begin = some[opens]
        own = owner[begin]
        return at[begin], np.diff(np.append(np.flatnonzero(opens), len(some))), ids[own], print_[own], start[own] + at[begin] - begins[own]

    _, n, doc, own_print, place = stretches(hit)
    found = np.column_stack([doc, own_print, place, n])
    if not rest or hit.all():
        return found, b""
    begin, n, doc, own_print, place = stretches(~hit)
    pieces = [joined[x:y] for x, y in zip(text.start[begin].tolist(), text.end[begin + n + window - 2].tolist(), strict=True)]
    return found, _blob(doc, own_print, place, pieces)


FOUND = "doc long, print long, at long, n long"


def _unpack(window: int):
    """Repeated windows of each bucket; and of each salted part of a bucket the windows to compare with its other parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loosen = zstandard.ZstdDecompressor()

        def rows(found: np.ndarray, bucket: int = 0, blob: bytes = b"") -> pa.RecordBatch:
            n = len(found) + bool(blob)
            pad = [None] * bool(blob)
            columns = [pa.concat_arrays([pa.array(np.ascontiguousarray(found[:, k])), pa.array(pad, pa.int64())]) for k in range(4)]
            blobs = pa.array([*[None] * len(found), *[zstandard.ZstdCompressor(level=5).compress(blob)] * bool(blob)], pa.binary())
            return pa.record_batch([*columns, pa.array([bucket] * n, pa.int64()), blobs], ["doc", "print", "at", "n", "bucket", "blob"])

        own, blobs = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                kind, bucket, salt, blob = (batch.column(c)[k].as_py() for c in range(4))
                raw = loosen.decompress(blob)
                if kind:
                    yield rows(np.frombuffer(raw, np.int64).reshape(-1, 4))
                    continue
                if (bucket, salt) != own and blobs:
                    yield rows(*_one(blobs, own))
                    blobs = []
                own = bucket, salt
                blobs.append(raw)
        if blobs:
            yield rows(*_one(blobs, own))

    def _one(blobs: list[bytes], own: tuple[int, int]) -> tuple[np.ndarray, int, bytes]:
        found, rest = _repeats(blobs, window, own[1] > 0)
        return found, own[0], rest

    return run


def repeated_windows(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, print, at, n): n windows from word `at` that start in a smaller document too; may overlap.

    `rows`: doc long, print long, t binary, without nulls.
    """
    spark = rows.sparkSession
    spread = stage(rows.mapInArrow(tidy(_common(window)), "triple long, n long, docs long"), "common")
    n_words, n_docs = spread.where("triple is null").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("docs"), F.lit(0))).first()
    heavy = spread.where("triple is not null").groupBy("triple").agg(F.sum("n").alias("n")).where(F.col("n") > COMMON * n_docs)
    # A document of w words has w triples, so at most (words / documents) / COMMON triples can be this common.
    common = np.sort(np.array([r[0] for r in heavy.select("triple").collect()], np.int64).view(np.uint64))
    wanted = n_words // BUCKET_WORDS
    parts = partitions_for(spark, min(wanted // FINE, MOST_PARTS))
    buckets = max(wanted, FINE * parts)
    sent = rows.mapInArrow(tidy(_pack(window, buckets, common, 2 + isqrt(wanted))), SENT)
    dealt = sent.repartition(parts, "bucket", "salt").sortWithinPartitions("kind", "bucket", "salt")
    found = stage(dealt.mapInArrow(tidy(_unpack(window)), f"{FOUND}, bucket long, blob binary"), "windows")
    rest = found.where("blob is not null").select(F.lit(0).alias("kind"), "bucket", F.lit(0).alias("salt"), "blob")
    again = rest.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_unpack(window)), f"{FOUND}, bucket long, blob binary")
    return found.where("blob is null").unionByName(again).drop("bucket", "blob")


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, as they are about to be shuffled."""
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            few = batch.slice(at, 1000)
            yield pa.record_batch([*few.columns[:2], pa.array([squeeze.compress(t.as_py()) for t in few.column(2)], pa.binary()), *few.columns[3:]], batch.schema.names)


def _cut(window: int, as_is: bool, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loosen = zstandard.ZstdDecompressor()
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                few = batch.slice(start, 1000)
                words_, removed, kept = [], [], []
                for blob, at, n in zip(*(few.column(k) for k in (1, 2, 3)), strict=True):
                    text, at, n = loosen.decompress(blob.as_py()), at.as_py(), n.as_py()
                    words = text.split()
                    words_.append(len(words))
                    if at:
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, np.array(at), 1)
                        np.add.at(edge, np.array(at) + np.array(n) + window - 1, -1)
                        words = list(compress(words, (np.cumsum(edge[:-1]) == 0).tolist()))
                    removed.append(words_[-1] - len(words))
                    kept.append((text if as_is and not at else b" ".join(words)).decode())
                yield pa.record_batch([few.column(0), pa.array(words_, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), *few.columns[4:]], names)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, carry: tuple[str, ...] = (), as_is: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept_text, the columns of `carry`) for every row.

    Each word that lies in a window of `window` words which also starts in a document with a smaller id is removed;
    windows are those of the input, not of what is left. Kept words are joined by one space; with `as_is`, texts
    that lose nothing stay as they are, white space included.
    """
    own = F.coalesce(F.col(text_col), F.lit(""))
    more = [f"c{k}" for k in range(len(carry))]
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(own).bitwiseAND(F.lit(0xFFFFFFFF)).alias("print"), own.cast("binary").alias("t"), *[F.col(c).alias(m) for c, m in zip(carry, more, strict=True)])
    found = (
        repeated_windows(rows.where("doc is not null").select("doc", "print", "t"), window)
        .groupBy("doc", "print")
        .agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n"))
        .withColumnsRenamed({"doc": "doc_", "print": "print_"})
    )
    types = [f"{m} {docs.schema[c].dataType.simpleString()}" for c, m in zip(carry, more, strict=True)]
    small = rows.mapInArrow(tidy(_squeeze), ", ".join(["doc long, print long, t binary", *types]))
    joined = small.join(found, (F.col("doc") == F.col("doc_")) & (F.col("print") == F.col("print_")), "left")
    names = ["doc", "n_words", "n_removed", "kept_text", *more]
    cut = joined.select("doc", "t", "at", "n", *more).mapInArrow(tidy(_cut(window, as_is, names)), ", ".join(["doc long, n_words long, n_removed long, kept_text string", *types]))
    return cut.withColumnsRenamed({"doc": id_col} | dict(zip(more, carry, strict=True)))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cut = remove_repeats(docs)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))
