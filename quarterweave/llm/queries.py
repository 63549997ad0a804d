"""Queries of this subpackage, each over its whole table, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, embeddings, encoding, filter_audit, hard_negatives, id_files, licenses, packing, quality, simhash, substring, surrogates, token_counts
from .oracle import AUDIT_SQL, CHAT_SQL, LICENSE_SQL, NEGATIVES_SQL, QUALITY_SQL, SUBSTRING_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_quality": quality.op2_quality,
    "op3_cover_tree": embeddings.op3_cover_tree,
    "op4_merge_replay": encoding.op4_merge_replay,
    "op5_id_files": id_files.op5_id_files,
    "op6_surrogates": surrogates.op6_surrogates,
    "op7_substring": substring.op7_substring,
    "op8_simhash": simhash.op8_simhash,
    "op9_best_fit": packing.op9_best_fit,
    "op10_license": licenses.op10_license,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_chat_format": chat.op12_chat_format,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op2_quality": QUALITY_SQL, "op7_substring": SUBSTRING_SQL, "op10_license": LICENSE_SQL,
    "op11_filter_audit": AUDIT_SQL, "op12_chat_format": CHAT_SQL, "op13_hard_negatives": NEGATIVES_SQL,
}
