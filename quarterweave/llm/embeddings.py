"""Embedding near-duplicates: all pairs of vectors at a cosine threshold, by dual traversal of cover trees.

On unit vectors a cosine of at least c is a distance of at most sqrt(2 - 2c). Distinct vectors are dealt to the nearest
of some pivots (a hash-chosen sample, one for so many vectors within bounds; it steers placement only) and within a pivot
to blocks of bounded size. Each block gets a cover tree: nested levels whose radii halve, each node with its true covering radius. Block
pairs, and below them node pairs, are dropped when the distance of their centres exceeds both covering radii and the
threshold; pairs whose every member must link are counted whole; what is left is compared exactly.

Contract: vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do rows
with a null id (their component is null); vectors of different length never link; equal vectors always link;
rows of one id are vectors of their own, each with its own links, and all go by that id in components; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, forest, join_weighted, stage, tile_pairs

COSINE, BLOCK = 0.9, 4096
#: Pivots at least and at most; their pairs are told to all tasks.
PIVOTS = 16, 512
#: What rounding may add to a distance.
SLACK = 1e-7


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows in unit length. Each is first brought near 1 by a power of two, which changes no digit: squares of very small or
    large components would be 0 or infinite."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])
    x = x / np.sqrt((x * x).sum(axis=1))[:, None]
    if not np.isfinite(x).all():
        raise ValueError("a vector without a length got among those that can link")
    return x


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, all of one length, in double precision and unit length."""
    return _unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))


def _apart(dots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * dots))


class CoverTree:
    """Cover tree of unit vectors. `at` orders the points so that each node holds a run of them; a node is
    (first point, end, centre's point, covering radius, first child, end of children); level k + 1 halves radii."""

    def __init__(self, points: np.ndarray):
        self.at = np.arange(len(points))
        self.nodes: list[tuple[int, int, int, float, int, int]] = []
        far = float(_apart(points @ points[0]).max())
        pending = [(0, len(points), far)]
        self.nodes.append((0, len(points), 0, far, 0, 0))
        k = 0
        while k < len(pending):
            lo, hi, reach = pending[k]
            centre, radius = self.nodes[k][2:4]
            if hi - lo > 1:
                first = len(self.nodes)
                for members, at, r in self._net(points, lo, hi, max(reach / 2, 1e-12)):
                    self.nodes.append((at, at + len(members), members[0], r, 0, 0))
                    self.at[at : at + len(members)] = members
                    pending.append((at, at + len(members), reach / 2))
                self.nodes[k] = (lo, hi, centre, radius, first, len(self.nodes))
            k += 1
        table = np.array([n[:3] + n[4:] for n in self.nodes], np.int64).reshape(-1, 5)
        self.lo, self.hi, self.centre, self.first, self.end = table.T
        self.radius = np.array([n[3] for n in self.nodes])
        self.leaf = self.first == self.end

    def _net(self, points: np.ndarray, lo: int, hi: int, reach: float):
        """Children of the run lo..hi: greedy centres, each with the open points within `reach` of it."""
        left, at = self.at[lo:hi].copy(), lo
        if reach <= 1e-9:  # equal up to rounding: one leaf each
            for p in left.tolist():
                yield np.array([p]), at, 0.0
                at += 1
            return
        while len(left):
            some = left[:256]
            apart = _apart(points[some] @ points[left].T)
            open_ = np.ones(len(left), bool)
            for i in range(len(some)):
                if open_[i]:
                    near = open_ & (apart[i] <= reach)
                    near[i] = True
                    open_ &= ~near
                    near[i] = False
                    members = np.concatenate(([some[i]], left[near]))
                    yield members, at, float(apart[i][near].max()) if near.any() else 0.0
                    at += len(members)
            left = left[open_]


def dual_traversal(a: np.ndarray, b: np.ndarray, wa: np.ndarray, wb: np.ndarray, cosine: float, same: bool):
    """Links of points of `a` with points of `b` (of `a` with itself where `same`): for each point the summed weights
    it links with, and edges (index into both, a first) that span the same components."""
    ta = CoverTree(a)
    tb = ta if same else CoverTree(b)
    near = float(np.sqrt(2 - 2 * cosine))
    shift = 0 if same else len(a)
    count_a, count_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    if same:
        count_b = count_a
    edges: list[np.ndarray] = []
    stack = [(0, 0)]
    while stack:
        x, y = stack.pop()
        mine = np.arange(ta.first[x], ta.end[x]) if not ta.leaf[x] else np.array([x])
        theirs = np.arange(tb.first[y], tb.end[y]) if not tb.leaf[y] else np.array([y])
        centres = b[tb.centre[theirs]].T
        for k in range(0, len(mine), 512):
            part = mine[k : k + 512]
            dots = a[ta.centre[part]] @ centres
            bound = ta.radius[part][:, None] + tb.radius[theirs][None, :]
            apart = _apart(dots)
            live = apart <= bound + near + SLACK
            if same and x == y:
                live &= part[:, None] <= theirs[None, :]
            leaves = ta.leaf[part][:, None] & tb.leaf[theirs][None, :]
            hit = live & leaves & (dots >= cosine)
            if same:
                hit &= part[:, None] != theirs[None, :]
            if hit.any():
                ca, cb = ta.centre[part], tb.centre[theirs]
                np.add.at(count_a, ca, hit @ wb[cb])
                np.add.at(count_b, cb, wa[ca] @ hit)
                i, j = np.nonzero(hit)
                edges.append(np.column_stack([ca[i], cb[j] + shift]) if len(i) < 8192 else _spanning(ca[i], cb[j] + shift))
            rest = live & ~leaves
            whole = rest & (apart + bound <= near - SLACK)
            if same:
                whole &= part[:, None] != theirs[None, :]
            for i, j in zip(*np.nonzero(whole), strict=True):
                u, v = ta.at[ta.lo[part[i]] : ta.hi[part[i]]], tb.at[tb.lo[theirs[j]] : tb.hi[theirs[j]]]
                count_a[u] += wb[v].sum()
                count_b[v] += wa[u].sum()
                edges.append(np.column_stack([u, np.full(len(u), v[0] + shift)]))
                edges.append(np.column_stack([np.full(len(v), u[0]), v + shift]))
            stack += [(int(part[i]), int(theirs[j])) for i, j in zip(*np.nonzero(rest & ~whole), strict=True)]
    return count_a, count_b, np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)


def _spanning(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    nodes, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    label = forest(len(nodes), at[: len(left)], at[len(left) :])
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return np.column_stack([nodes[label[moved]], nodes[moved]])


def _assign(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                dots = _matrix(batch.column(2)) @ pivots.T
                cell = dots.argmax(axis=1)
                yield pa.record_batch(
                    [pa.array(cell, pa.int32()), pa.array(_apart(dots.max(axis=1))), *(batch.column(k) for k in range(3))],
                    ["cell", "apart", "class", "weight", "vector"],
                )

    return run


def _traverse(cosine: float):
    """Rows (kind 0, class, linked weight) and (kind 1, class, class of its component's)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                same = batch.column(0)[row].as_py()
                (ra, wa, va), (rb, wb, vb) = [[s.field(f) for f in range(3)] for s in (batch.column(k)[row].values for k in (1, 2))]
                a = _matrix(va)
                b = a if same else _matrix(vb)
                ra, wa, rb, wb = (x.to_numpy() for x in (ra, wa, rb, wb))
                count_a, count_b, edges = dual_traversal(a, b, wa, wb, cosine, same)
                ids = ra if same else np.concatenate([ra, rb])
                counts = count_a if same else np.concatenate([count_a, count_b])
                some = np.flatnonzero(counts)
                if len(some):
                    pairs = _spanning(ids[edges[:, 0]], ids[edges[:, 1]])
                    kind = np.repeat(np.array([0, 1], np.int32), [len(some), len(pairs)])
                    u = np.concatenate([ids[some], pairs[:, 1]])
                    v = np.concatenate([counts[some], pairs[:, 0]])
                    yield pa.record_batch([pa.array(kind), pa.array(u), pa.array(v)], ["kind", "u", "v"])

    return run


def valid(vector: str):
    """True for vectors that can link."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def near_pairs(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, pivots: tuple[int, int] = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept) for every row."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(F.col(id_col).isNotNull() & valid(vector_col), F.col(vector_col)).alias("vector"))
    classes = rows.where("vector is not null").groupBy("vector").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    classes = stage(classes.withColumn("class", F.monotonically_increasing_id()), "classes")  # stored, so numbers stay
    links, total = [], 0
    for dim, n, weight in classes.groupBy(F.size("vector")).agg(F.count(F.lit(1)), F.sum("weight")).collect():  # lengths in use: one, as a rule
        total += weight
        own = classes.where(F.size("vector") == dim).select("class", "weight", "vector")
        chosen = own.select("vector").orderBy(F.xxhash64("class")).limit(min(max(pivots[0], n // block), pivots[1])).collect()
        centres = _unit(np.array([r[0] for r in chosen], float))
        dealt = own.mapInArrow(_assign(centres), f"cell int, apart double, class long, weight long, vector {own.schema['vector'].dataType.simpleString()}")
        cells = dealt.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("k"), F.max("apart").alias("radius"))
        cells = stage(cells, "cells")
        reach = {r.cell: r.radius for r in cells.collect()}  # a row per pivot
        between = _apart(centres @ centres.T)
        near = float(np.sqrt(2 - 2 * cosine)) + SLACK
        partners = [(a, b) for a in reach for b in reach if a <= b and (a == b or between[a, b] <= reach[a] + reach[b] + near)]
        tiles = (
            dealt.join(F.broadcast(cells.select("cell", "k")), "cell")
            .withColumn("salt", F.pmod(F.xxhash64("class"), F.col("k")).cast("int"))
            .groupBy("cell", "salt")
            .agg(F.collect_list(F.struct("class", "weight", F.col("vector"))).alias("body"))
        )
        pairs = tile_pairs(stage(tiles, "tiles"), spark.createDataFrame(partners, "cell_a int, cell_b int"), cells.select("cell", "k"), ["body"])
        links.append(stage(pairs.mapInArrow(_traverse(cosine), "kind int, u long, v long"), "links"))
    found = spark.createDataFrame([], "kind int, u long, v long")
    for part in links:
        found = found.unionByName(part)
    linked = found.where("kind = 0").groupBy(F.col("u").alias("class")).agg(F.sum("v").alias("linked"))
    joined = components(found.where("kind = 1").select("u", "v")).withColumnRenamed("node", "class")
    named = classes.select("class", "rep", "weight").join(joined, "class", "left")
    named = stage(named.withColumn("component", F.coalesce("component", "class")), "members")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("n"))  # components go by their smallest id
    named = join_weighted(named, least.withColumnRenamed("component", "c_"), {"component": "c_"}, "n", total)
    labels = (
        classes.select("class", "vector")
        .join(named.select("class", "weight", "component_id"), "class")
        .join(linked, "class", "left")
        .select(F.col("vector").alias("vector_"), (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id", "weight")
    )
    out = join_weighted(rows, stage(labels, "labels"), {"vector": "vector_"}, "weight", total).select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def op3_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_pairs(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
