"""Filter interaction audit: what each filter removes in every order of five, from 32 signed parity sums.

A document's failures are a mask of five bits. For each part and kind of label the 32 Walsh-Hadamard sums are taken over
all documents: sum T adds one for a document that fails an even number of the filters in T, else takes one away. Such sums
merge by adding, so tasks combine them before the shuffle and a hot part is no hot task. The transform is its own inverse
but for a factor of 32, so the documents of every mask follow exactly, in whole numbers. All 120 orders are then read from
these 32 numbers, and so is a filter's Shapley total: in 120 orders each of a document's n failing filters comes first in
120 / n.

Whether a text stands under a smaller id elsewhere is found without moving texts: by SHA-256, rows of one text first add up
by part, label and id, then by part and label, and only these sums meet.

Contract of `filter_audit`: a null text is empty; a null part is the empty string; a null id is no smaller than others and
has no label; rows of one id and one text are not copies of each other; of several labels of an id any 1 counts; other values
of a label count as none; other columns are ignored; an empty table gives an empty result; every part gives 600 rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD_BREAK

#: Filters by letter; a failure of the k-th is bit k of a mask.
FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT = 200, 50, 2
_COPY = 1 << FILTERS.index("E")


def failures(text: Column) -> Column:
    """The mask of what a text fails by itself: A few words, B few distinct ones, C many capitals, D a symbol."""
    words = F.array_remove(F.split(text, WORD_BREAK), "")

    def mask(w: Column) -> Column:
        tests = {
            "A": F.size(w) < MIN_WORDS,
            "B": 100 * F.size(F.array_distinct(w)).cast("long") < MIN_DISTINCT_PERCENT * F.size(w).cast("long"),
            "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > MAX_UPPER_PERCENT * F.length(text).cast("long"),
            "D": text.rlike(r"[#$%&*|]"),
        }
        return sum((F.when(test, 1 << FILTERS.index(k)).otherwise(0) for k, test in tests.items()), F.lit(0))

    return F.element_at(F.transform(F.array(words), mask), 1)  # bound once, so that the words are found once


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """(part, good, toxic, mask, n): documents by all five failures."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), failures(text).alias("mask"))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.coalesce(F.col(good_col) == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col(toxic_col) == 1, F.lit(False))).alias("toxic"))
    rows = rows.join(known, "id", "left").select("id", "part", "digest", "mask", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    kind = ["digest", "mask", "part", "good", "toxic"]
    by_id = rows.groupBy(*kind, "id").agg(F.count(F.lit(1)).alias("n"))
    named = F.when(F.col("id").isNotNull(), F.struct("id", "n"))
    by_kind = by_id.groupBy(*kind).agg(F.sum("n").alias("n"), F.min(named).alias("least"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"))
    # Of one text, a row for each part and label is left, whatever the number of its copies.
    by_kind = by_kind.withColumn("first", F.min("least.id").over(W.partitionBy("digest")))
    clean = F.col("unnamed") + F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0)
    both = F.array(F.struct(F.col("mask").alias("mask"), clean.alias("n")), F.struct((F.col("mask") + _COPY).alias("mask"), (F.col("n") - clean).alias("n")))
    return by_kind.select("part", "good", "toxic", F.explode(both).alias("e")).select("part", "good", "toxic", F.col("e.mask").alias("mask"), F.col("e.n").alias("n"))


def _odd(a: Column, b: Column) -> Column:
    """1 where two masks share an odd number of bits."""
    return F.bit_count(a.bitwiseAND(b)).bitwiseAND(F.lit(1))


def parity_sums(counted: DataFrame) -> DataFrame:
    """(part, label, sums: 32 signed sums), label being all, good or toxic."""
    labels = F.array_compact(F.array(F.lit("all"), F.when(F.col("good"), F.lit("good")), F.when(F.col("toxic"), F.lit("toxic"))))
    rows = counted.select("part", "mask", "n", F.explode(labels).alias("label"))
    sums = [F.sum(F.when(_odd(F.col("mask"), F.lit(t)) == 1, -F.col("n")).otherwise(F.col("n"))).alias(f"s{t}") for t in range(MASKS)]
    return rows.groupBy("part", "label").agg(*sums).select("part", "label", F.array(*[f"s{t}" for t in range(MASKS)]).alias("sums"))


def mask_cells(sums: DataFrame) -> DataFrame:
    """(part, all, good, toxic): documents by mask, from the parity sums, exact as whole numbers."""
    terms = lambda m: F.transform("sums", lambda s, t: F.when(_odd(m, t) == 1, -s).otherwise(s))
    cell = lambda m: F.aggregate(terms(m), F.lit(0).cast("long"), lambda a, b: a + b)
    cells = F.transform(F.sequence(F.lit(0), F.lit(MASKS - 1)), lambda m: F.shiftright(cell(m), len(FILTERS)))
    per = sums.select("part", "label", cells.alias("cells")).groupBy("part")
    none = F.array_repeat(F.lit(0).cast("long"), MASKS)
    return per.agg(*[F.coalesce(F.max(F.when(F.col("label") == k, F.col("cells"))), none).alias(k) for k in ("all", "good", "toxic")])


def _over(cells: str, test) -> Column:
    """Documents of the masks that pass a test."""
    return F.aggregate(F.transform(cells, lambda c, m: F.when(test(m), c).otherwise(0)), F.lit(0).cast("long"), lambda a, b: a + b)


def orders(cells: DataFrame) -> DataFrame:
    """A row for every part, order and step, by the sums over masks that the order asks for."""
    each = cells.withColumn("filter_order", F.explode(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])))
    each = each.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bits = lambda s: sum((F.when(s.contains(k), 1 << i).otherwise(0) for i, k in enumerate(FILTERS)), F.lit(0))
    each = each.withColumn("bit", bits(F.substring("filter_order", F.col("step"), F.lit(1)))).withColumn("before", bits(F.left("filter_order", F.col("step") - 1)))
    bit, before = F.col("bit"), F.col("before")
    fails, earlier = lambda m: m.bitwiseAND(bit) != 0, lambda m: m.bitwiseAND(before) != 0
    here = lambda m: fails(m) & ~earlier(m)
    share = F.aggregate(F.transform("all", lambda c, m: F.when(fails(m), c * (F.lit(120) / F.greatest(F.bit_count(m), F.lit(1))).cast("long")).otherwise(0)), F.lit(0).cast("long"), lambda a, b: a + b)
    return each.select(
        "part", "filter_order", "step",
        _over("all", lambda m: ~fails(m) & ~earlier(m)).alias("kept"),
        _over("all", here).alias("removed"),
        _over("all", lambda m: fails(m) & earlier(m)).alias("redundant"),
        _over("all", lambda m: m == bit).alias("unique_fails"),
        _over("good", here).alias("good_lost"),
        _over("toxic", here).alias("toxic_lost"),
        share.alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """All orders of the five filters, step by step, for every part; see `masks` for the names of columns."""
    return orders(mask_cells(parity_sums(masks(docs, labels, **columns))))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
