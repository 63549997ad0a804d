"""Quality rules with adaptive thresholds, in DataFrame functions only.

Fixed cutoffs fit one language and one kind of source. Here every (language, source) group gets its own: for each
measure a quantile sketch counts values in buckets whose bounds grow by a constant factor (relative error 1 %), zeros
apart. Such sketches merge by adding counts, so tasks combine them before the shuffle, a hot group is no hot task, and the
result does not depend on the order of rows. From the sketch of the values that are not zero come the median and the upper
quartile, both as logarithms, in which one fence suits measures of any size: a group's limit lies so many quartile
distances (`FENCES`) above its median; no distance is less than the sketch can tell. A small group's median and distance
are drawn to those of its language, and a language's to those of all, by weight of documents: there is no size at which a
rule changes. No limit exceeds `LIFT` times that of the level above, so a source that is mostly bad cannot switch its rule
off. Limits are joined to the documents and filter them.

Most texts have no symbols at all, and of those that do most may be bad, so their own sketch would say that bad is usual.
Symbols are judged by the sketch of all marks (characters of words that are no letters), which nearly every text has:
symbols that alone outweigh what the group's texts hold in marks altogether are too many.

Contract of `quality`: a null text has no words; null language or source are groups of their own; measures of a
text without words are 0; every row gives a row; other columns are carried as asked, else ignored. Repeated windows
are told apart by 64-bit hashes within one text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_BREAK, stage

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
LIFT, ERROR = 3.0, 0.01
#: Documents of the level above that a group is taken to hold besides its own.
PRIOR = 50
#: Measures that are sketched, and how many quartile distances above the median their limit lies.
FENCES = {"m_word_length": 12.0, "m_marks": 4.0, "m_dup_lines": 12.0, "m_repeats": 12.0, "m_upper": 12.0, "m_loud": 12.0}
#: Measures that are judged, each by the limit of a sketch.
JUDGED = {"m_word_length": "m_word_length", "m_symbols": "m_marks", "m_dup_lines": "m_dup_lines", "m_repeats": "m_repeats", "m_upper": "m_upper", "m_loud": "m_loud"}
_GAMMA = math.log((1 + ERROR) / (1 - ERROR))


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and the measures (double)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    step = docs.withColumn("_w", F.array_remove(F.split(text, WORD_BREAK), ""))
    n = F.size("_w")
    # Of each window of three words its hash; _w and _h are used more than once below, so Spark computes each once.
    step = step.withColumn("_h", F.transform(F.slice("_w", 1, F.greatest(n - 2, F.lit(0))), lambda w, k: F.xxhash64(w, F.col("_w")[k + 1], F.col("_w")[k + 2])))
    step = step.withColumn("_p", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, k: F.struct(h.alias("h"), k.alias("k"))))))
    twice = F.filter("_p", lambda p, k: (F.when(k > 0, F.col("_p")[k - 1]["h"]) == p["h"]) | (F.when(k < F.size("_p") - 1, F.col("_p")[k + 1]["h"]) == p["h"]))
    step = step.withColumn("_at", F.sort_array(F.transform(twice, lambda p: p["k"])))
    steps = F.transform(F.slice("_at", 1, F.greatest(F.size("_at") - 1, F.lit(0))), lambda a, k: F.least(F.lit(3), F.col("_at")[k + 1] - a))
    covered = F.when(F.size("_at") > 0, F.aggregate(steps, F.lit(3), lambda x, y: x + y)).otherwise(0)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = step.withColumn("_l", lines)
    out = step.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "n_repeat_words": covered.cast("long"),
            "_n_lines": F.size("_l"),
            "_letters": F.length(F.regexp_replace(text, r"[^\p{L}\p{M}]+", "")),
            "_upper": F.length(F.regexp_replace(text, r"[^\p{Lu}]", "")),
            "_loud": F.size(F.filter("_w", lambda w: w.endswith("!"))),
        }
    )
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return out.withColumns(
        {
            "m_word_length": per("word_chars", "n_words"),
            "m_symbols": per("n_symbols", "word_chars"),
            "m_marks": F.when(F.col("word_chars") > 0, (F.col("word_chars") - F.col("_letters")) / F.col("word_chars")).otherwise(F.lit(0.0)),
            "m_dup_lines": per("n_dup_lines", "_n_lines"),
            "m_repeats": per("n_repeat_words", "n_words"),
            "m_upper": per("_upper", "word_chars"),
            "m_loud": per("_loud", "n_words"),
        }
    ).drop("_w", "_h", "_p", "_at", "_l", "_n_lines", "_letters", "_upper", "_loud")


def sketch(measured: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, bucket, n): how many values lie in each bucket; bucket 0 holds zeros, others log-spaced values."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), _bucket(F.col(m)).alias("bucket")) for m in FENCES])
    return measured.select(*keys, F.explode(pairs).alias("e")).groupBy(*keys, "e.measure", "e.bucket").agg(F.count(F.lit(1)).alias("n"))


def _bucket(value: Column) -> Column:
    return F.when(value > 0, F.greatest(F.ceil(F.log(value) / F.lit(_GAMMA)) + 100_000, F.lit(1))).otherwise(0).cast("int")


def spreads(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, size, centre, spread) from a sketch: of the values that are not zero their number, and median and quartile
    distance of their logarithms."""
    per = counts.where("bucket > 0").groupBy(*keys, "measure").agg(F.sum("n").alias("size"), F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("b"))
    # At most a few thousand buckets a group, whatever the number of documents.

    def quantile(q: float) -> Column:
        state = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("at"))
        end = F.aggregate("b", state, lambda s, x: F.struct((s["sum"] + x["n"]).alias("sum"), F.when((s["at"] < 0) & (s["sum"] + x["n"] >= F.col("size") * q), x["bucket"]).otherwise(s["at"]).alias("at")))
        return (end["at"] - 100_000 - 0.5) * F.lit(_GAMMA)

    two = per.select(*keys, "measure", "size", quantile(0.5).alias("centre"), quantile(0.75).alias("upper"))
    return two.select(*keys, "measure", "size", "centre", (F.col("upper") - F.col("centre")).alias("spread"))


def _fence() -> Column:
    out = F.lit(None).cast("double")
    for m, fence in FENCES.items():
        out = F.when(F.col("measure") == m, F.lit(fence)).otherwise(out)
    return out


def drawn(own: DataFrame, above: DataFrame | None, keys: list[str]) -> DataFrame:
    """(keys, measure, centre, spread, lim) of a level, drawn to the one above by weight of documents."""
    if above is None:
        both, lift = own, F.lit(None).cast("double")
    else:
        shared = [k for k in above.columns if k in keys]
        up = above.select(*[F.col(k).alias(f"_{k}") for k in [*shared, "measure"]], F.col("centre").alias("centre_"), F.col("spread").alias("spread_"), F.col("lim").alias("lim_"))
        match = [own[k].eqNullSafe(F.col(f"_{k}")) for k in [*shared, "measure"]]
        blend = lambda c: ((F.col("size") * F.col(c) + PRIOR * F.col(f"{c}_")) / (F.col("size") + PRIOR)).alias(c)
        both, lift = own.join(up, match).select(*keys, "measure", blend("centre"), blend("spread"), "lim_"), LIFT * F.col("lim_")
    fence = F.exp(F.col("centre") + _fence() * F.greatest(F.col("spread"), F.lit(_GAMMA)))
    return both.select(*keys, "measure", "centre", "spread", F.least(fence, lift).alias("lim"))


def limits(measured: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang_, source_, limit_<measure>...): the limits of every group of a stored table of `measures`; null for what no text of
    the group has."""
    by_both = stage(sketch(measured.select(F.col(lang_col).alias("lang_"), F.col(source_col).alias("source_"), *FENCES), ["lang_", "source_"]), "sketch")
    by_lang = by_both.groupBy("lang_", "measure", "bucket").agg(F.sum("n").alias("n"))  # sketches merge by adding
    of_all = by_lang.groupBy("measure", "bucket").agg(F.sum("n").alias("n"))
    every = drawn(spreads(of_all, []), None, [])
    some = drawn(spreads(by_lang, ["lang_"]), every, ["lang_"])
    own = drawn(spreads(by_both, ["lang_", "source_"]), some, ["lang_", "source_"])
    return stage(own.groupBy("lang_", "source_").agg(*[F.max(F.when(F.col("measure") == m, F.col("lim"))).alias(f"limit_{m}") for m in FENCES]), "limits")


def quality(measured: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """A stored table of `measures` with base_failed, too_high (array of measures above their limit) and kept."""
    table = limits(measured, lang_col, source_col)
    joined = measured.join(table, measured[lang_col].eqNullSafe(table["lang_"]) & measured[source_col].eqNullSafe(table["source_"]), "left")
    high = F.array_compact(F.array(*[F.when(F.col(m) > F.col(f"limit_{by}"), F.lit(m)) for m, by in JUDGED.items()]))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return joined.withColumns({"base_failed": failed, "too_high": high}).withColumn("kept", ~failed & (F.size("too_high") == 0)).drop("lang_", "source_", *[f"limit_{m}" for m in FENCES])


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return quality(stage(measures(docs).drop("text"), "measures")).drop("lang", "source")
