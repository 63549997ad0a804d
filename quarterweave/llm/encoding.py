"""Byte-level BPE encoding and decoding of whole documents, by corpus-level merge replay.

The corpus of a replay is what a task has in hand: the new words of a batch of documents, each once, merge together in
rank order through an inverted index from token pair to positions (`tokens.MergeReplay`). Words that recur in later
batches are looked up. Joining codes of a global word list back to every occurrence would shuffle the whole corpus;
this way no text leaves its task.

Contract of `encode_documents`: a null text counts as empty; every row gives a row, ties, repeats and null ids too;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import BYTE_RANKS, byte_bpe


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = BYTE_RANKS) -> DataFrame:
    """(id, ids binary, decoded binary): ids as little-endian unsigned 32-bit integers, and the bytes they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks)
        for batch in batches:
            for at in range(0, batch.num_rows, 10_000):
                part = batch.slice(at, 10_000)
                bpe.learn([t.as_py() or "" for t in part.column(1)])
                for k in range(0, part.num_rows, 500):
                    few = part.slice(k, 500)
                    ids = [bpe.ids(t.as_py() or "") for t in few.column(1)]
                    decoded = [bpe.decode(i) for i in ids]
                    yield pa.record_batch([few.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], [id_col, "ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, f"`{id_col}` long, ids binary, decoded binary")


def op4_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
