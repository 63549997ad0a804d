"""SimHash near-duplicates: fingerprints, then tiled exact comparison of all that differ.

Contract of `fingerprints`: a null text counts as empty; a text without words has fingerprint 0, one with fewer
words than a shingle is its own shingle; repeated rows give repeated rows; other columns are ignored.
Contract of `near_duplicates`: rows with a null id keep their fingerprint, link with nothing and have a null
component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, forest, join_weighted, stage, tidy, tile_pairs

SHINGLE, SEED, RADIUS, TILE = 4, 42, 4, 8192


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits, each the majority of that bit over the hashes of all word shingles, as a signed integer."""
    words = text.lower().split()  # of bytes: lowers A-Z and splits at ASCII white space only
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [h(b" ".join(words), seed)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
        hashes = [h(joined[s:e], seed) for s, e in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    each = np.array(hashes, np.uint64)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(each), 65536):
        counts += np.unpackbits(each[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(each), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, fp long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py() or b"", shingle, seed) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(fps, pa.int64())], [id_col, "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(tidy(run), f"`{id_col}` long, fp long")


def _partners(spark: SparkSession, radius: int) -> DataFrame:
    """Cells are the one-bit counts of both halves; fingerprints within the radius lie in cells this close."""
    cells = [(i, j) for i in range(33) for j in range(33)]
    near = [
        (i * 33 + j, x * 33 + y)
        for i, j in cells
        for x in range(i, min(33, i + radius + 1))
        for y in range(max(0, j - radius), min(33, j + radius + 1))
        if abs(x - i) + abs(y - j) <= radius and (i, j) <= (x, y)
    ]
    return spark.createDataFrame(near, "cell_a int, cell_b int")


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                same = batch.column(0)[row].as_py()
                sides = [batch.column(k)[row].values for k in (1, 2)]
                (fa, ia), (fb, ib) = [(s.field(0).to_numpy().view(np.uint64), s.field(1).to_numpy()) for s in sides]
                step = max(1, (1 << 18) // max(1, len(fb)))
                left, right = [], []
                for k in range(0, len(fa), step):
                    near = np.bitwise_count(fa[k : k + step, None] ^ fb[None, :]) <= radius
                    i, j = np.nonzero(near)
                    i += k
                    if same:
                        i, j = i[i < j], j[i < j]
                    if len(i) > 8192:  # of a dense block only a spanning forest goes on
                        label = forest(len(fa) + len(fb), i, j + len(fa))
                        moved = np.flatnonzero(label != np.arange(len(label)))
                        both = np.concatenate([ia, ib])
                        left.append(both[moved]), right.append(both[label[moved]])
                    elif len(i):
                        left.append(ia[i]), right.append(ib[j])
                if left:
                    a, b = np.concatenate(left), np.concatenate(right)
                    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
                    label = forest(len(nodes), at[: len(a)], at[len(a) :])
                    moved = np.flatnonzero(label != np.arange(len(nodes)))
                    yield pa.record_batch([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], ["u", "v"])

    return run


def near_duplicates(prints: DataFrame, id_col: str = "doc_id", radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(id, fp, component_id): the smallest id reachable by links of fingerprints within `radius` bits.

    Equal fingerprints are one class first. Classes lie in cells by the one-bit counts of their two halves; large
    cells are split into tiles by hash. Only tiles of cells whose counts differ by the radius at most are compared,
    exactly, in blocks. The work left still grows with the square of the distinct fingerprints.
    """
    spark = prints.sparkSession
    classes = stage(prints.where(F.col(id_col).isNotNull()).groupBy("fp").agg(F.min(id_col).alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    cell = F.bit_count(F.shiftrightunsigned("fp", 32)) * 33 + F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    classes = classes.withColumn("cell", cell.cast("int"))
    cells = classes.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("k"))  # 1,089 rows at most
    tiles = (
        classes.join(F.broadcast(cells), "cell")
        .withColumn("salt", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
        .groupBy("cell", "salt")
        .agg(F.collect_list(F.struct("fp", "rep")).alias("body"))
    )
    pairs = tile_pairs(stage(tiles, "tiles"), _partners(spark, radius), cells, ["body"])
    links = pairs.mapInArrow(tidy(_compare(radius)), "u long, v long")
    found = components(links)
    labels = classes.join(found, classes["rep"] == found["node"], "left").select(F.col("fp").alias("fp_"), F.coalesce("component", "rep").alias("component_id"), "n")
    out = join_weighted(prints, stage(labels, "labels"), {"fp": "fp_"}, "n", total).drop("n")
    return out.withColumn("component_id", F.when(F.col(id_col).isNotNull(), F.col("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose id is the smallest of its group; rows with a null id stay."""
    groups = near_duplicates(stage(fingerprints(docs, id_col, text_col), "prints"), id_col)
    drop = groups.where(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias("_drop_id")).distinct()
    return docs.join(drop, docs[id_col] == drop["_drop_id"], "left_anti")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    groups = near_duplicates(stage(fingerprints(docs), "prints"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
