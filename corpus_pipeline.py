"""The corpus pipeline: quality rules, near-duplicates, repeated passages, personal data, packing.

`STAGES` lists (name, function); each function takes (spark, docs, sf_dir) and returns what it kept, with the columns
of documents (the last: packed pieces with their token ids). Every stage's result is written as Parquet in the shared
folder and reread, and dropped when the next one is written. SQL can express neither fingerprints nor tokenizers, so
`ORACLE_SQL` is None; tests compare the rows of every stage with a brute-force version of it.

Null texts have no words, so the quality rules drop them; rows with a null id stay (no copies of others, as copies go by
their ids); repeated rows of one id stay together; columns besides those of documents are left out; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterweave.llm.common import drop_staged, small_batches, stage, staged
from quarterweave.llm.packing import pack_documents
from quarterweave.llm.quality import measures, quality
from quarterweave.llm.simhash import keep_one
from quarterweave.llm.substring import remove_repeats
from quarterweave.llm.surrogates import replace_entities, session_key

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule; the measured table is stored once, as thresholds and verdicts both read it."""
    return quality(stage(measures(docs.select(*COLUMNS)), "measures")).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group."""
    with small_batches(spark):
        return keep_one(docs.select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document holds go. A text that loses none stays as it is, line ends included;
    in the others kept words are joined by blanks. Documents of which nothing is left go. The texts themselves pass through
    Python when the result is computed: give it `small_batches` as well, as `run` does, where memory is short."""
    with small_batches(spark):
        cut = remove_repeats(docs, carry=("lang", "source"), as_is=True)
    kept = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities give way to stand-ins."""
    out = replace_entities(docs.select(*COLUMNS), session_key(spark)).drop("n_entities")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encoded pieces, their ids, and where each lies."""
    with small_batches(spark):
        return pack_documents(docs, with_ids=True, remember=60_000, forget=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("personal_data", personal_data),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, function in STAGES[:-1]:
        with small_batches(spark), staged() as tables:
            docs = stage(function(spark, docs, sf_dir), name)
        drop_staged(spark, before + tables[:-1])  # the last is the result
        before = tables[-1:]
    with staged() as tables:
        return STAGES[-1][1](spark, docs, sf_dir)
