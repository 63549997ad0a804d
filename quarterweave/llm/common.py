"""What several operators share: the shared folder, staged tables, components, tile pairs."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_BREAK = r"[\x20\x09-\x0D]+"
#: A key that holds over one in so many rows is hot; so many keys at most are.
HOT = 1000
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as `spark.checkpoint.dir` names it.

    Only where that setting is absent and all runs in this process (tests) a folder of our own is made and remembered;
    on a cluster its absence is an error, as executors do not share local folders.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-stage-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` to the shared folder and returns it reread: it is computed once, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for scope in _scopes[-1:]:
        scope.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Meanwhile so many rows at most go to a Python worker at once: ten thousand whole texts, Spark's own number, are tens
    of megabytes several times over. What is computed later than that has the setting of before."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, rows)
    try:
        yield
    finally:
        spark.conf.set(setting, before)


@contextmanager
def staged() -> Iterator[list[str]]:
    """The folders of the tables staged meanwhile, for `drop_staged`."""
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        _scopes.pop()


def drop_staged(spark: SparkSession, paths: list[str]) -> None:
    """Deletes staged tables that nothing reads any more."""
    for path in paths:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def unstage(df: DataFrame) -> None:
    drop_staged(df.sparkSession, sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()}))


def join_weighted(rows: DataFrame, labels: DataFrame, on: dict[str, str], weight: str, total: int) -> DataFrame:
    """`rows` left-joined with `labels` on columns of both, by name in `rows`: name in `labels`. `weight` of a label counts
    its rows, of `total`. Labels of hot keys, `HOT` at most by that count, are broadcast; the others meet in a shuffle."""
    match = [F.col(a) == F.col(b) for a, b in on.items()]
    heavy = F.broadcast(labels.where(F.col(weight) * HOT > total))
    some = rows.join(heavy, match)
    rest = rows.join(heavy.select(*on.values()), match, "left_anti")
    return some.unionByName(rest.join(labels.where(F.col(weight) * HOT <= total), match, "left")).drop(*on.values())


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, after which a worker gives freed memory back: it outlives its task and waits beside those of other stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
            trim(0)

    return whole


def partitions_for(spark: SparkSession, wanted: int) -> int:
    """A partition count that follows the data, never below the session's own."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(wanted))


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node its component holds, given links left[k] - right[k]."""
    label = np.arange(n)
    while True:
        a, b = label[left], label[right]
        open_ = a != b
        if not open_.any():
            return label
        left, right, a, b = left[open_], right[open_], a[open_], b[open_]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while not np.array_equal(label, nxt := label[label]):
            label = nxt


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (batch.column(k).to_numpy() for k in (0, 1))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = forest(len(nodes), at[: len(a)], at[len(a) :])
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.record_batch([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (u, v long); component is the smallest node reachable.

    Alternating large-star and small-star steps: each node's neighbours move to the smallest one in reach. Edges
    stay spread over tasks, minima are combined before they are shuffled, and every round is a written table.
    Few edges per task are passed on: those of a spanning forest.
    """
    now = stage(edges.mapInArrow(_local_forest, "u long, v long").distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
            .select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        after = stage(small, "edges")
        mark = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        unstage(now)
        now = after
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = mark


def tile_pairs(tiles: DataFrame, partners: DataFrame, cells: DataFrame, body: list[str]) -> DataFrame:
    """Rows of two tiles each, a tile's cell and salt at most its partner's.

    `tiles` (cell int, salt int, body...), `partners` (cell_a, cell_b: cell pairs to compare, cell_a <= cell_b),
    `cells` (cell, k: tiles in the cell). The last two hold one row per cell or cell pair, which a rule bounds,
    so both are broadcast. Tiles meet on (cell, salt) of the partner: every key is one tile of bounded size.
    """
    b = F.broadcast
    left = (
        tiles.join(b(partners), tiles["cell"] == partners["cell_a"])
        .join(b(cells.select(F.col("cell").alias("cell_k"), F.col("k"))), F.col("cell_b") == F.col("cell_k"))
        .select(
            F.col("cell").alias("cell_1"),
            F.col("salt").alias("salt_1"),
            "cell_b",
            F.explode(F.when(F.col("cell") == F.col("cell_b"), F.sequence(F.col("salt"), F.col("k") - 1)).otherwise(F.sequence(F.lit(0), F.col("k") - 1))).alias("salt_b"),
            *[F.col(c).alias(f"{c}_1") for c in body],
        )
    )
    right = tiles.select(F.col("cell").alias("cell_b"), F.col("salt").alias("salt_b"), *[F.col(c).alias(f"{c}_2") for c in body])
    same = (F.col("cell_1") == F.col("cell_b")) & (F.col("salt_1") == F.col("salt_b"))
    return left.join(right.hint("merge"), ["cell_b", "salt_b"]).select(same.alias("same"), *[f"{c}_{k}" for k in (1, 2) for c in body])
