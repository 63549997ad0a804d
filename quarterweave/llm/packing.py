"""Best-fit packing of documents into sequences of bounded length.

Only lengths decide, and there are as many as a sequence is long, so the plan is made from a histogram of that bounded
size: pieces above a third of a sequence, of which at most two share one, are matched greedily, the largest each with
the largest that fits; smaller ones, in descending order, go to the sequence whose gap they fill best. The plan says
for each length which ranks go to which run of sequences; a piece's rank within its length is that within its task after
those of the tasks before. The plan, of a size that only the capacity bounds, is joined to the pieces by length and rank.

Contract of `pack`: lengths are 1 to `capacity`; every row is placed; ties are in the order in which a task met them;
full pieces are sequences by themselves. `pieces` of a document: a null text counts as empty and still gets the end id;
repeated rows and null ids are packed like others; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stage, tidy
from .tokens import WORD_BPE, WORDS_REMEMBERED, word_bpe

CAPACITY = 2048


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, end rank, first sequence, pieces in each, offset of the first) that place all pieces."""
    left = {n: c for n, c in counts.items() if c}
    taken = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap to runs (first sequence, sequences)
    order: list[int] = []  # gaps in use, ascending
    n_sequences = 0

    def put(length: int, each: int, first: int, sequences: int, offset: int, n: int | None = None) -> None:
        n = each * sequences if n is None else n
        rows.append((length, taken[length], taken[length] + n, first, each, offset))
        taken[length] += n
        left[length] -= n

    def open_gap(gap: int, run: tuple[int, int]) -> None:
        if gap and run[1]:
            if gap not in gaps:
                gaps[gap] = []
                order.insert(bisect_left(order, gap), gap)
            gaps[gap].append(run)

    large = sorted(n for n in left if 3 * n > capacity)
    for length in reversed(large):
        for other in reversed(large[: bisect_left(large, min(length, capacity - length) + 1)]):
            n = left[length] // 2 if other == length else min(left[length], left[other])
            if n:
                put(length, 1, n_sequences, n, 0)
                put(other, 1, n_sequences, n, length)
                open_gap(capacity - length - other, (n_sequences, n))
                n_sequences += n
        if n := left[length]:
            put(length, 1, n_sequences, n, 0)
            open_gap(capacity - length, (n_sequences, n))
            n_sequences += n
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while n := left[length]:
            at = bisect_left(order, length)
            if at == len(order):
                each = capacity // length
                first, sequences, gap = n_sequences, -(-n // each), capacity
                n_sequences += sequences
            else:
                gap = order[at]
                each = gap // length
                first, sequences = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(at)
            full = min(sequences, n // each)
            if full:
                put(length, each, first, full, capacity - gap)
                open_gap(gap - each * length, (first, full))
            if full < sequences:
                if rest := left[length] if left[length] < each else 0:
                    put(length, rest, first + full, 1, capacity - gap)
                    open_gap(gap - rest * length, (first + full, 1))
                    full += 1
                open_gap(gap, (first + full, sequences - full))
    return np.array(rows, np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of a stored table `pieces` (task int, within long, length long, ...) with sequence_id long and offset long.

    `within` numbers the rows of a task and length from 0; `task` is any number.
    """
    spark = pieces.sparkSession
    counts = stage(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "lengths")
    total = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `capacity` rows at most
    before = counts.select(F.col("length").alias("length_"), F.col("task").alias("task_"), (F.sum("n").over(W.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    ranked = pieces.join(before, (F.col("length") == F.col("length_")) & (F.col("task") == F.col("task_"))).withColumn("rank_", F.col("before") + F.col("within"))
    table = pa.table(dict(zip(["l_", "first_", "end_", "sequence_", "each_", "offset_"], plan(total, capacity).T, strict=True)))
    runs = spark.createDataFrame(table.to_pandas(), ", ".join(f"{c} long" for c in table.column_names))
    placed = ranked.join(F.broadcast(runs), (F.col("length") == F.col("l_")) & (F.col("rank_") >= F.col("first_")) & (F.col("rank_") < F.col("end_")))
    at = F.col("rank_") - F.col("first_")
    return placed.select(
        *[c for c in pieces.columns if c not in ("task", "within")],
        (F.col("sequence_") + F.floor(at / F.col("each_"))).cast("long").alias("sequence_id"),
        (F.col("offset_") + at % F.col("each_") * F.col("length")).alias("offset"),
    )


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False, vocabulary: str = WORD_BPE, remember: int = WORDS_REMEMBERED, forget: bool = False) -> DataFrame:
    """Encoded pieces (task, within, id, piece, start, length, ids_crc32 and, if asked for, ids binary); only documents
    longer than a sequence make several. A worker remembers up to twice `remember` words; if it is to `forget`, only within
    a task, at whose end it lets the vocabulary go as well, so that idle workers hold little."""
    names = ["task", "within", id_col, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, last, task = word_bpe(vocabulary), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        bpe.limit = remember
        met: Counter[int] = Counter()  # pieces so far, by length
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                few = batch.slice(at, 1000)
                rows: list[tuple] = []
                for k in range(few.num_rows):
                    ids, doc = bpe.ids(few.column(1)[k].as_py() or "") + last, few.column(0)[k].as_py()
                    for piece, lo in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[lo : lo + 4 * capacity]
                        rows.append((task, met[len(own)], doc, piece, lo // 4, len(own) // 4, zlib.crc32(own), *[own] * with_ids))
                        met[len(own)] += 1
                types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * with_ids]
                yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        if forget:
            bpe.forget()
            del bpe
            word_bpe.cache_clear()

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(tidy(run), f"task int, within long, `{id_col}` long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False, vocabulary: str = WORD_BPE, remember: int = WORDS_REMEMBERED, forget: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids], sequence_id, offset) for every piece of every document."""
    pieces = stage(cut(docs, id_col, text_col, end_id, capacity, with_ids, vocabulary, remember, forget), "pieces")
    placed = pack(pieces, capacity)
    return placed.select(id_col, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "sequence_id", "offset")


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
