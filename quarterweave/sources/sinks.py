"""Results as files, written by Spark: a corpus of Markdown, manifests, raw copies, audits, packs as nested JSON, errors apart.

Every sink can be run again: it replaces what it wrote, of a table by partitions only the partitions it has rows for. Rows
are dealt to files by bytes, so that files are of a size whatever the rows are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def _write(rows: DataFrame, path: str, by: list[str], form: str = "parquet") -> None:
    dealt = rows.hint("rebalance", *by) if by else rows.hint("rebalance")
    writer = dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*by) if by else writer).format(form).save(path)


def write_markdown(documents: DataFrame, path: str) -> None:
    """One document per release, by fiscal year."""
    _write(documents.where(F.col("content_source").isNotNull()).select("release_id", "fiscal_year", "markdown"), f"{path}/markdown", ["fiscal_year"])


def write_manifest(manifest: DataFrame, path: str) -> None:
    _write(manifest, f"{path}/manifest", [], "json")


def write_raw(content: DataFrame, path: str) -> None:
    """Raw contents by format, `html` or `txt`."""
    _write(content.where(F.col("content_source").isNotNull()).select("release_id", "raw_format", "raw_content"), f"{path}/raw", ["raw_format"])


def write_audit(candidates: DataFrame, path: str) -> None:
    """The ranked candidates of each request, by fiscal year."""
    _write(candidates, f"{path}/audit", ["fiscal_year"])


def write_packs(packs: DataFrame, path: str) -> None:
    _write(packs, f"{path}/evidence", [], "json")


def errors(*parts: tuple[str, DataFrame, Column, Column]) -> DataFrame:
    """(stage, key, error) of all steps of a job: each part is a name, rows, their key and their error, null where there is none."""
    out = None
    for stage, rows, key, error in parts:
        own = rows.select(F.lit(stage).alias("stage"), key.cast("string").alias("key"), error.alias("error")).where(F.col("error").isNotNull())
        out = own if out is None else out.unionByName(own)
    return out


def write_routed(rows: DataFrame, path: str, error_col: str = "content_error") -> dict[str, int]:
    """Rows by `status`, ok or quarantine, written in one pass, and how many went where: a bad key ends no job, and no row is
    computed twice to be sorted out."""
    seen = Observation()
    status = F.when(F.col(error_col).isNull(), "ok").otherwise("quarantine")
    routed = rows.withColumn("status", status).observe(seen, F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "quarantine").alias("quarantine"))
    routed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("status").parquet(path)
    return dict(seen.get)
