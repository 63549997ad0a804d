"""Hard negatives: rows of other labels that score just below an anchor's positives, found behind an orthogonal rotation.

A rotation leaves inner products as they are. That of the principal axes puts most of a vector into its first components, so
of two rotated vectors the product of the leading ones is close to the whole, and what is left is at most the product of
the norms of what is left. Tiles of anchors meet tiles of rows; the leading components of all pairs are multiplied, pairs
whose bound cannot reach what an anchor still needs are dropped, the next components are added for those that stay, and
survivors of all steps are verified by integer products of the vectors themselves. Bounds get a slack far above what rounding
can add, so none is lost.

Axes come from a hash-chosen sample of `SAMPLE` rows; they steer what is dropped early, never what is found. Rows are dealt to
tiles by hash, in the first pass within labels, so a label of any size is many tiles. Each pair of tiles passes on a few rows
for each anchor, and ranks are cut per task before they are shuffled.

Contract of `hard_negatives`: rows with a null label, vector or id, or any null or non-finite component, take no part, nor do
empty vectors and those with a component over `LARGEST` as a whole number (no product of theirs is sure to fit a long); of
several rows of an id the one with the smallest label and vector counts; vectors of another length are not compared; equal
scores go by the smaller id; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stage

POSITIVES, NEGATIVES, LEAST_PERCENT = 5, 5, 80
SCALE, LARGEST, SAMPLE = 256, 1 << 23, 4096
#: Rows and anchors of a tile; rows of it that are compared at a time.
ROWS, ANCHORS, STEP = 4096, 1024, 1024
#: Shares of the components that the steps have seen.
STEPS = (0.125, 0.25, 0.5, 1.0)
#: What rounding may add to a product, per product of norms.
SLACK = 1e-9


def scored_rows(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(id, label, dim, q): what takes part, components as whole numbers."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double") * SCALE)
    whole = F.transform(v, lambda x: F.when(F.abs(x) <= LARGEST, F.floor(x)))  # NaN compares as larger than any number
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), whole.alias("q"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("q") > 0) & F.forall("q", lambda x: x.isNotNull()))
    one = rows.groupBy("id").agg(F.min(F.struct("label", "q")).alias("r"))
    return one.select("id", "r.label", F.size("r.q").alias("dim"), "r.q")


def principal_axes(rows: DataFrame, dim: int, sample: int = SAMPLE) -> np.ndarray:
    """Orthogonal columns, those along which the sample's products are largest first."""
    some = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id").limit(sample).select("q").collect()
    q = np.array([r[0] for r in some], float)
    return np.linalg.eigh(q.T @ q)[1][:, ::-1].copy()


class _Rotated:
    """Whole-number vectors with their rotation and, at each step, the norm of what is left."""

    def __init__(self, column: pa.Array, axes: np.ndarray):
        self.q = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)
        self.r = self.q.astype(float) @ axes
        dim = self.r.shape[1]
        self.cuts = sorted({max(1, round(dim * s)) for s in STEPS})
        tails = np.cumsum((self.r * self.r)[:, ::-1], axis=1)[:, ::-1]
        self.rest = [np.sqrt(tails[:, k]) if k < dim else np.zeros(len(self.r)) for k in self.cuts]
        self.norm = np.sqrt(tails[:, 0])


def survivors(a: _Rotated, b: _Rotated, at: slice, live: np.ndarray, need: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) for the pairs of `a` and `b`[at] that `live` allows and no bound rules out. `need` takes the lower and upper
    bounds of all pairs and those alive, and says which stay."""
    r, q = b.r[at], b.q[at]
    part = np.zeros(live.shape)
    slack = SLACK * a.norm[:, None] * b.norm[at][None, :] + 1e-6
    begin = 0
    for k, end in enumerate(a.cuts):
        if live.mean() > 0.05:
            part += a.r[:, begin:end] @ r[:, begin:end].T
        else:  # few are left: theirs alone
            i, j = np.nonzero(live)
            for s in range(0, len(i), 1 << 16):
                x, y = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                part[x, y] += np.einsum("ij,ij->i", a.r[x, begin:end], r[y, begin:end])
        left = a.rest[k][:, None] * b.rest[k][at][None, :] + slack
        live = live & need(part - left, part + left, live)
        begin = end
    i, j = np.nonzero(live)
    score = np.empty(len(i), np.int64)
    for s in range(0, len(i), 1 << 16):
        score[s : s + (1 << 16)] = np.einsum("ij,ij->i", a.q[i[s : s + (1 << 16)]], q[j[s : s + (1 << 16)]])
    return i, j, score


def _first(n: int, i: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of the first n of each i, by score, then id."""
    order = np.lexsort((ids, -score, i))
    own = i[order]
    start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, int)
    rank = np.arange(len(own)) - np.repeat(start, np.diff(np.r_[start, len(own)]))
    return order[rank < n]


class _Best:
    """The first n rows of each anchor so far, and the least score that still counts."""

    def __init__(self, anchors: int, n: int, least: np.ndarray):
        self.n, self.least = n, least
        self.i, self.score, self.ids = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, i: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        i, score, ids = (np.concatenate(x) for x in ((self.i, i), (self.score, score), (self.ids, ids)))
        keep = _first(self.n, i, score, ids)
        self.i, self.score, self.ids = i[keep], score[keep], ids[keep]
        full = np.flatnonzero(np.bincount(self.i, minlength=len(self.least)) == self.n)
        last = np.full(len(self.least), np.iinfo(np.int64).max)
        np.minimum.at(last, self.i, self.score)
        self.least[full] = np.maximum(self.least[full], last[full])


def best_positives(ids_a: np.ndarray, a: _Rotated, ids_b: np.ndarray, b: _Rotated, n: int) -> _Best:
    """The first n rows of `b` for each anchor of `a`, itself apart."""
    best = _Best(len(ids_a), n, np.full(len(ids_a), -np.inf))
    for s in range(0, len(ids_b), STEP):
        at = slice(s, s + STEP)

        def need(low: np.ndarray, high: np.ndarray, live: np.ndarray) -> np.ndarray:
            least = best.least
            if low.shape[1] >= n:  # n rows that surely score so much
                least = np.maximum(least, -np.partition(-np.where(live, low, -np.inf), n - 1, axis=1)[:, n - 1])
            return high >= least[:, None]

        i, j, score = survivors(a, b, at, ids_a[:, None] != ids_b[at][None, :], need)
        best.add(i, score, ids_b[at][j])
    return best


def best_negatives(labels_a: np.ndarray, a: _Rotated, top: np.ndarray, labels_b: np.ndarray, ids_b: np.ndarray, b: _Rotated, n: int, percent: int) -> list[_Best]:
    """For each place among the positives of an anchor (`top`: their scores, a column each, -1 where there is none) the first
    n rows of another label that score from `percent` of it up to it."""
    floor = np.where(top >= 0, -(-percent * top // 100), np.iinfo(np.int64).max)
    slots = [_Best(len(a.q), n, floor[:, k].astype(float)) for k in range(top.shape[1])]
    most = top.max(axis=1)
    for s in range(0, len(ids_b), STEP):
        at = slice(s, s + STEP)

        def need(low: np.ndarray, high: np.ndarray, live: np.ndarray) -> np.ndarray:
            least = np.min([x.least for x in slots], axis=0)
            return (high >= least[:, None]) & (low <= most[:, None])

        i, j, score = survivors(a, b, at, labels_a[:, None] != labels_b[at][None, :], need)
        for k, slot in enumerate(slots):
            fits = (score >= floor[i, k]) & (score <= top[i, k])
            slot.add(i[fits], score[fits], ids_b[at][j[fits]])
    return slots


def _columns(body: pa.StructArray, *names: str) -> list[np.ndarray]:
    return [body.field(n).to_numpy(zero_copy_only=False) for n in names]


def _mine_positives(axes: np.ndarray, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x, y = (batch.column(k)[row].values for k in (0, 1))
                (ids_a,), (ids_b,) = _columns(x, "id"), _columns(y, "id")
                best = best_positives(ids_a, _Rotated(x.field("q"), axes), ids_b, _Rotated(y.field("q"), axes), n)
                if len(best.i):
                    yield pa.record_batch([pa.array(ids_a[best.i]), pa.array(best.ids), pa.array(best.score)], ["anchor_id", "positive_id", "positive_score"])

    return run


def _mine_negatives(axes: np.ndarray, n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x, y = (batch.column(k)[row].values for k in (0, 1))
                ids_a, labels_a = _columns(x, "id", "label")
                ids_b, labels_b = _columns(y, "id", "label")
                own = x.field("positives")
                size = np.diff(own.offsets.to_numpy())
                at = np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                top = np.full((len(size), int(size.max(initial=1))), -1, np.int64)
                ids_p = np.zeros_like(top)
                flat = own.flatten()
                ids_p[at], top[at] = flat.field("id").to_numpy(), flat.field("score").to_numpy()
                slots = best_negatives(labels_a, _Rotated(x.field("q"), axes), top, labels_b, ids_b, _Rotated(y.field("q"), axes), n, percent)
                for k, slot in enumerate(slots):
                    if len(slot.i):
                        columns = [ids_a[slot.i], ids_p[slot.i, k], slot.ids, top[slot.i, k], slot.score]
                        yield pa.record_batch([pa.array(c) for c in columns], ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    return run


def _tiles(rows: DataFrame, keys: list[str], size: int, body: list[str], name: str) -> tuple[DataFrame, DataFrame | int]:
    """Stored tiles (keys, salt, body) of about `size` rows, and how many there are: for each key (keys, k), or of all."""
    many = F.greatest(F.ceil(F.count(F.lit(1)) / size), F.lit(1)).cast("int").alias("k")
    counts = stage(rows.groupBy(*keys).agg(many), "counts") if keys else rows.agg(many).first()[0]
    counted = rows.join(counts, keys) if keys else rows.withColumn("k", F.lit(counts))
    salted = counted.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(name)), F.col("k")).cast("int"))
    return stage(salted.groupBy(*keys, "salt").agg(F.collect_list(F.struct(*body)).alias("body")), name), counts


def _meet(anchors: DataFrame, tiles: DataFrame, counts: DataFrame | int, keys: list[str]) -> DataFrame:
    """(body_a, body_b): every tile of anchors with every tile of rows of its keys; the join's key is one tile of rows."""
    counted = anchors.join(counts, keys) if keys else anchors.withColumn("k", F.lit(counts))
    spread = counted.select(*keys, F.col("body").alias("body_a"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("salt"))
    return spread.join(tiles.withColumnRenamed("body", "body_b").hint("merge"), [*keys, "salt"]).select("body_a", "body_b")


def hard_negatives(vectors: DataFrame, is_anchor, positives: int = POSITIVES, negatives: int = NEGATIVES, percent: int = LEAST_PERCENT, rows_per_tile: int = ROWS, anchors_per_tile: int = ANCHORS, **columns: str) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). `is_anchor` is a column over id and label."""
    rows = stage(scored_rows(vectors, **columns), "scored")
    found = []
    for (dim,) in rows.select("dim").distinct().collect():  # lengths in use: one, as a rule
        own = rows.where(F.col("dim") == dim)
        axes = principal_axes(rows, dim)
        anchors = own.where(is_anchor)
        tiles_a, _ = _tiles(anchors, ["label"], anchors_per_tile, ["id", "q"], "anchors")
        tiles, counts = _tiles(own, ["label"], rows_per_tile, ["id", "q"], "labels")
        near = _meet(tiles_a, tiles, counts, ["label"]).mapInArrow(_mine_positives(axes, positives), "anchor_id long, positive_id long, positive_score long")
        order = W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
        best = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)
        per = best.groupBy(F.col("anchor_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", F.col("positive_id").alias("id"), F.col("positive_score").alias("score")))).alias("positives"))
        asked = anchors.join(per, "id")
        tiles_a, _ = _tiles(asked, [], anchors_per_tile, ["id", "label", "q", "positives"], "asked")
        tiles, counts = _tiles(own, [], rows_per_tile, ["id", "label", "q"], "rows")
        far = _meet(tiles_a, tiles, counts, [])
        found.append(far.mapInArrow(_mine_negatives(axes, negatives, percent), "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"))
    out = vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    for part in found:
        out = out.unionByName(part)
    order = W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    moved = given.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long")))
    return hard_negatives(moved, F.col("id") % 100 == 0)
