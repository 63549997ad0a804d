"""Token counts by section: whole documents are encoded once, and token spans are joined to sections by position.

Encoding a section by itself gives other tokens than the document has, so counts of parts would not add up. Here each
token gets its span of characters, spans are interval-joined to the sections of the document, and a token that crosses
a boundary is allocated by a rule: `start`, the section with its first character; `most`, the section with most of its
characters, the first of several. A token of part of a character spans that character.

Contract of `token_counts`: a null text counts as empty and gives one row of 0 tokens; sections are the lines (a line
feed belongs to the line it ends), or those of an array column of (name, start, stop) in any order; where sections
overlap, a character belongs to the one that starts last, of several to the last listed; a section without start or
stop, or that stops where it starts or before, has no characters; characters outside every section count in a row whose
section is null; every row of the input is counted by itself, repeats and null ids too; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import BYTE_RANKS, read_ranks


@cache
def _encoding(path: str):
    import tiktoken

    ranks = read_ranks(path)
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("given", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def token_spans(text: str, path: str = BYTE_RANKS) -> tuple[np.ndarray, np.ndarray]:
    """First character of each token of a text, and the one after its last."""
    encoding, sizes = _encoding(path)
    ids = np.array(encoding.encode_ordinary(text), np.int64)
    stop = np.cumsum(sizes[ids])
    start = stop - sizes[ids]
    raw = np.frombuffer(text.encode(), np.uint8)
    if len(raw) != len(text):
        character = np.cumsum((raw & 0xC0) != 0x80) - 1
        start, stop = character[start], character[stop - 1] + 1
    return start, stop


def owners(start: list[int | None], stop: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sections as stretches (begin, end, section), ascending and apart: each character has one section at most."""
    real = [(b, e, k) for k, (b, e) in enumerate(zip(start, stop, strict=True)) if b is not None and e is not None and b < e]
    real.sort(key=lambda s: (s[0], s[2]))
    if all(a[1] <= b[0] for a, b in zip(real, real[1:])):
        table = np.array(real, np.int64).reshape(-1, 3)
        return table[:, 0], table[:, 1], table[:, 2]
    edges = sorted({x for b, e, _ in real for x in (b, e)})
    out: list[list[int]] = []
    open_: list[tuple[int, int, int]] = []  # sections in reach, by start and place in the list; the largest owns
    at = 0
    for lo, hi in zip(edges, edges[1:]):
        while at < len(real) and real[at][0] <= lo:
            heapq.heappush(open_, (-real[at][0], -real[at][2], real[at][1]))
            at += 1
        while open_ and open_[0][2] <= lo:
            heapq.heappop(open_)
        if open_:
            own = -open_[0][1]
            if out and out[-1][1] == lo and out[-1][2] == own:
                out[-1][1] = hi
            else:
                out.append([lo, hi, own])
    table = np.array(out, np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def allocate(start: np.ndarray, stop: np.ndarray, begin: np.ndarray, end: np.ndarray, rule: str, section: np.ndarray | None = None) -> np.ndarray:
    """The section of each token, -1 for none; stretches begin[k]..end[k] are of `section[k]`, or of k."""
    section = np.arange(len(begin)) if section is None else section
    if not len(begin):
        return np.full(len(start), -1)
    at = np.searchsorted(begin, start, side="right") - 1  # the last stretch that begins at the token or before
    inside = (at >= 0) & (start < end[np.maximum(at, 0)])
    own = np.where(inside, section[np.maximum(at, 0)], -1)
    if rule == "most":
        for k in np.flatnonzero((stop > end[np.maximum(at, 0)]) | ~inside):
            first, last = max(at[k], 0), np.searchsorted(begin, stop[k], side="left")
            parts = np.minimum(end[first:last], stop[k]) - np.maximum(begin[first:last], start[k])
            most: dict[int, int] = {}
            for s, n in zip(section[first:last].tolist(), parts.tolist(), strict=True):
                if n > 0:
                    most[s] = most.get(s, 0) + n
            own[k] = max(most, key=most.__getitem__) if most else -1  # of several the first
    return own


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None, rule: str = "start", ranks: str = BYTE_RANKS) -> DataFrame:
    """(id, section int, name, start, stop, n_tokens): a row for each section of each document."""
    if rule not in ("start", "most"):
        raise ValueError(f"no rule {rule!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                few = batch.slice(at, 1000)
                out: list[list] = [[], [], [], [], [], []]
                for k in range(few.num_rows):
                    text = few.column(1)[k].as_py() or ""
                    if sections_col is None:
                        size = np.array([len(line) + 1 for line in text.split("\n")])
                        end = np.cumsum(size)
                        begin = end - size
                        end[-1] -= 1
                        names = [None] * len(size)
                    else:
                        own = few.column(2)[k].as_py() or []
                        own = [s or {"name": None, "start": None, "stop": None} for s in own]
                        begin, end, names = ([s[f] for s in own] for f in ("start", "stop", "name"))
                    start, stop = token_spans(text, ranks)
                    lo, hi, own_section = (begin, end, None) if sections_col is None else owners(begin, end)
                    section = allocate(start, stop, lo, hi, rule, own_section)
                    counts = np.bincount(section + 1, minlength=len(begin) + 1)
                    doc = few.column(0)[k].as_py()
                    if counts[0] or not len(begin):
                        for column, value in zip(out, (doc, None, None, None, None, int(counts[0])), strict=True):
                            column.append(value)
                    for column, values in zip(out, ([doc] * len(begin), range(len(begin)), names, list(begin), list(end), counts[1:].tolist()), strict=True):
                        column.extend(values)
                types = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.record_batch([pa.array(v, t) for v, t in zip(out, types, strict=True)], [id_col, "section", "name", "start", "stop", "n_tokens"])

    columns = [F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")]
    if sections_col is not None:
        columns.append(F.col(sections_col).alias("s"))
    return docs.select(*columns).mapInArrow(run, f"`{id_col}` long, section int, name string, start long, stop long, n_tokens long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
