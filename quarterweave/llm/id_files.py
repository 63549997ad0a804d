"""Token-id files in directly addressable codes: any token is reached without decoding a block.

An id is split into chunks of some bits, the lowest first. Level k holds the k-th chunks of those ids that have one,
a bitmap that says which of them go on to level k + 1, and a rank directory that counts the set bits before each
stretch, so that position i of level k leads to position rank(i) of level k + 1 in a few steps.

A file is a Parquet table of segments, written by Spark, hence on any file system Spark can write, and without
compression: a segment's bytes lie in the file as they are. Segments hold runs of documents in ascending order of id;
their first and last ids are columns, so that a lookup (`read_tokens`) reads only the segments it needs. Layout of a segment, little-endian:
  8 bytes "DACIDS1\\0"; int64 bits a chunk, levels, documents, ids
  int64[documents] ids of documents; uint8[documents] 1 where null; int64[documents] where each document ends
  per level: int64 length; uint8[length] chunks; uint8[ceil(length / 8)] bitmap, lowest bit first;
             int64[ceil(length / 512) + 1] set bits before each 512

Contract: a null text counts as empty and still gets the end id; rows with a null id come first; repeated ids are
ordered by a hash of their texts; an empty table gives no segments; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import partitions_for, shared_dir, small_batches, tidy
from .tokens import WORD_BPE, word_bpe

MAGIC, BITS, STRETCH = b"DACIDS1\0", 8, 512
#: Ids in a segment, and documents in a task, about.
SEGMENT_IDS, TASK_DOCS = 1 << 20, 8000
#: Places that one reading of a segment looks up.
LOOKUPS = 200_000
#: Words a worker remembers, of the latest and of the time before; what is forgotten is encoded again.
REMEMBERED = 550_000
SEGMENTS = "part int, start long, n_docs long, n_tokens long, first_id long, last_id long, segment binary"


def write_segment(doc_ids: list, ends: list[int], ids: np.ndarray, bits: int = BITS) -> bytes:
    levels = []
    rest = ids.astype(np.uint64)
    while not levels or len(rest):
        on = rest >> np.uint64(bits) > 0
        counts = np.add.reduceat(np.append(on, False).astype(np.int64), np.arange(0, len(on) + 1, STRETCH))
        ranks = np.concatenate(([0], np.cumsum(counts)))[: -(-len(on) // STRETCH) + 1]
        levels.append(np.int64(len(rest)).tobytes() + (rest & np.uint64((1 << bits) - 1)).astype(np.uint8).tobytes() + np.packbits(on, bitorder="little").tobytes() + ranks.astype("<i8").tobytes())
        rest = rest[on] >> np.uint64(bits)
    head = np.array([bits, len(levels), len(doc_ids), len(ids)], "<i8").tobytes()
    own = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], np.uint8).tobytes() + np.array(ends, "<i8").tobytes()
    return MAGIC + head + own + b"".join(levels)


class Segment:
    """Random access to the ids of a segment."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a segment of ids")
        self.bits, n_levels, n_docs, self.n = np.frombuffer(raw, "<i8", 4, 8).tolist()
        at = 40

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        ids, null, self.ends = take("<i8", n_docs), take("u1", n_docs), take("<i8", n_docs)
        self.doc_ids = [None if x else d for d, x in zip(ids.tolist(), null.tolist(), strict=True)]
        self.levels = []
        for _ in range(n_levels):
            n = int(take("<i8", 1)[0])
            self.levels.append((take("u1", n), take("u1", -(-n // 8)), take("<i8", -(-n // STRETCH) + 1)))

    def _on(self, level: int, start: int, stop: int) -> np.ndarray:
        bitmap = self.levels[level][1][start // 8 : -(-stop // 8)]
        return np.unpackbits(bitmap, bitorder="little")[start % 8 : start % 8 + stop - start].astype(bool)

    def _rank(self, level: int, at: int) -> int:
        """Set bits before position `at`."""
        return int(self.levels[level][2][at // STRETCH]) + int(self._on(level, at - at % STRETCH, at).sum())

    def ids(self, start: int, stop: int, level: int = 0) -> np.ndarray:
        """The ids at start..stop, as uint32."""
        out = self.levels[level][0][start:stop].astype(np.uint32)
        on = self._on(level, start, stop)
        if n := int(on.sum()):
            at = self._rank(level, start)
            out[on] |= self.ids(at, at + n, level + 1) << np.uint32(self.bits)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def write_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, vocabulary: str = WORD_BPE) -> None:
    """Encodes every document, adds the end id, and writes all ids to `path` in ascending order of document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, last = word_bpe(vocabulary), np.array([end_id], "<u4").tobytes()
        bpe.limit = REMEMBERED
        owners: list = []
        ends: list[int] = []
        parts: list[bytes] = []
        held = start = 0
        part = 0

        def segment() -> pa.RecordBatch:
            raw = write_segment(owners, ends, np.frombuffer(b"".join(parts), "<u4"))
            some = [d for d in owners if d is not None] or [None]
            numbers = start, len(owners), held, some[0], some[-1]
            return pa.record_batch([pa.array([part], pa.int32()), *(pa.array([v], pa.int64()) for v in numbers), pa.array([raw], pa.binary())], ["part", "start", "n_docs", "n_tokens", "first_id", "last_id", "segment"])

        for batch in batches:
            for k in range(batch.num_rows):
                part = batch.column(0)[k].as_py()
                ids = bpe.ids(batch.column(2)[k].as_py() or "") + last
                held += len(ids) // 4
                owners.append(batch.column(1)[k].as_py()), ends.append(held), parts.append(ids)
                if held >= SEGMENT_IDS:
                    yield segment()
                    start += held
                    owners, ends, parts, held = [], [], [], 0
        if owners:
            yield segment()

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    parts = partitions_for(spark, rows.count() // TASK_DOCS)
    order = ["i", "h"]
    dealt = rows.withColumn("h", F.xxhash64("t")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    with small_batches(spark):
        dealt.select(F.spark_partition_id().alias("part"), "i", "t").mapInArrow(tidy(run), SEGMENTS).write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) of every document in the files; start counts the ids of all before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                segment = Segment(batch.column(1)[k].as_py())
                n = len(segment.ends)
                size = np.diff(np.concatenate(([0], segment.ends)))
                begin = segment.ends - size + batch.column(0)[k].as_py()
                for at in range(0, n, 500):
                    some = range(at, min(n, at + 500))
                    raw = pa.array([segment.document(d).astype("<u4").tobytes() for d in some], pa.binary())
                    yield pa.record_batch([pa.array(segment.doc_ids[at : at + 500], pa.int64()), pa.array(begin[at : at + 500]), pa.array(size[at : at + 500]), raw], ["doc_id", "start", "n_tokens", "ids"])

    segments = spark.read.schema(SEGMENTS).parquet(path)
    totals = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row per writing task
    before = totals.select(F.col("part").alias("part_"), (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    placed = segments.join(F.broadcast(before), F.col("part") == F.col("part_")).select((F.col("before") + F.col("start")).alias("at"), "segment")
    return placed.mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids binary")


def read_tokens(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, position, token) for rows (doc_id, position) of `wanted`: the token at that place of the document, null
    where there is none; of several documents of one id the first is read. Each token costs a few steps in its segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                segment = Segment(batch.column(0)[k].as_py())
                place: dict[int, int] = {}
                for d, doc in enumerate(segment.doc_ids):
                    place.setdefault(doc, d)
                ids, at, out = (batch.column(1)[k].values.field(f).to_pylist() for f in (0, 1)), [], []
                for doc, position in zip(*ids, strict=True):
                    if (d := place.get(doc)) is not None:
                        begin, end = (int(segment.ends[d - 1]) if d else 0), int(segment.ends[d])
                        inside = position is not None and 0 <= position < end - begin
                        at.append((doc, position))
                        out.append(int(segment.ids(begin + position, begin + position + 1)[0]) if inside else None)
                where = [[batch.column(c)[k].as_py()] * len(at) for c in (2, 3)]
                columns = [a[0] for a in at], [a[1] for a in at], out, *where
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["d_", "p_", "token", "part", "start"])

    segments = spark.read.schema(SEGMENTS).parquet(path)
    asked = wanted.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("position").cast("long").alias("position")).distinct()
    # Places are found by numbered stretches of ids, about as many as there are segments. Ids ascend through the files, so
    # segments overlap in their ends only and lie in two stretches each on average; one is read for `LOOKUPS` places at once.
    directory = segments.select("part", "start", "first_id", "last_id")
    low, high, n = directory.agg(F.min("first_id"), F.max("last_id"), F.count(F.lit(1))).first()
    width = max(1, ((high or 0) - (low or 0)) // max(n, 1))
    stretch = lambda c: F.floor((F.col(c).cast("decimal(20,0)") - F.lit(low or 0)) / F.lit(width)).cast("long")
    covered = directory.withColumn("stretch_", F.explode(F.sequence(stretch("first_id"), stretch("last_id"))))
    inside = (F.col("stretch") == F.col("stretch_")) & F.col("doc_id").between(F.col("first_id"), F.col("last_id"))
    hit = asked.where(F.col("doc_id").between(F.lit(low), F.lit(high))).withColumn("stretch", stretch("doc_id")).join(covered, inside)
    where = [F.col("part").alias("part_"), F.col("start").alias("start_")]
    times = hit.groupBy(*where).agg(F.ceil(F.count(F.lit(1)) / LOOKUPS).alias("times"))
    dealt = hit.select(*where, "doc_id", "position").join(times, ["part_", "start_"])
    load = F.pmod(F.xxhash64("doc_id", "position"), F.col("times")).alias("load")
    grouped = dealt.groupBy("part_", "start_", load).agg(F.collect_list(F.struct("doc_id", "position")).alias("asked"))
    chosen = segments.join(grouped, (F.col("part") == F.col("part_")) & (F.col("start") == F.col("start_"))).select("segment", "asked", F.col("part").cast("long"), "start")
    found = chosen.mapInArrow(run, "d_ long, p_ long, token long, part long, start long")
    best = found.groupBy("d_", "p_").agg(F.min_by("token", F.struct("part", "start")).alias("token"))
    return asked.join(best, F.col("doc_id").eqNullSafe(F.col("d_")) & F.col("position").eqNullSafe(F.col("p_")), "left").select("doc_id", "position", "token")


def op5_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
