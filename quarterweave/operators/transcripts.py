"""Earnings calls: one text per call, where its questions begin, and how complete it is.

Everything after the one shuffle that joins a call's items is columns of the call's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import clean_transcript, count_words, first_hit, hits, plain_punctuation, speaker_labels, strip

CALL = ["symbol", "year", "quarter"]
MIN_CALL_WORDS, MIN_QA_WORDS, CHUNK = 2500, 250, 24_000


def transcript_text(items: DataFrame) -> DataFrame:
    """(call, raw, text): the longest field of each item, the first of equals, in order; and the text normalised."""
    fields = F.array(*[F.struct(F.length(strip(F.col(c))).alias("n"), F.lit(-k).alias("k"), strip(F.col(c)).alias("t")) for k, c in enumerate(("content", "transcript", "text"))])
    longest = F.array_max(F.filter(fields, lambda x: x["n"] > 0))["t"]
    own = items.select(*CALL, "item_ord", longest.alias("t"))  # before the shuffle: one field travels, not three
    calls = own.groupBy(*CALL).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("t").isNotNull(), F.struct("item_ord", "t")))), lambda x: x["t"]), "\n\n").alias("raw"))
    return calls.withColumn("text", speaker_labels(plain_punctuation(clean_transcript(F.col("raw")))))


def qa_candidates(calls: DataFrame) -> DataFrame:
    """`calls` with `candidates`: for each detector that hits (method, position, matched, ratio, base, score)."""
    text = F.col("text")
    ratio = lambda at: at / F.greatest(F.length(text), F.lit(1))
    step = calls.withColumn("turns", hits(text, P.TURN))
    late = F.filter("turns", lambda p: ratio(p) >= 0.25)
    found = [(m, c, first_hit(text, p), F.regexp_substr(text, F.lit(p))) for m, c, p in P.DETECTORS]
    found.append((*P.LATE, F.get(late, F.lit(0)), F.lit("Late Operator intervention")))
    found.append((*P.SECOND, F.get("turns", F.lit(1)), F.lit("Second Operator intervention")))

    def candidate(method: str, base: float, at: Column, matched: Column) -> Column:
        fallback = "fallback" in method
        score = F.lit(base)
        if method != "explicit_q_and_a_heading":
            score = score - F.when(ratio(at) < 0.12, F.lit(0.30)).otherwise(F.lit(0.0))
        if fallback:
            score = score - F.lit(0.05) - F.when(ratio(at) > 0.92, F.lit(0.20)).otherwise(F.lit(0.0))
        score = score + F.lit({"explicit_q_and_a_heading": 0.02, "management_qa_transition": 0.01}.get(method, 0.0))
        return F.when(
            at.isNotNull(),
            F.struct(F.lit(method).alias("method"), at.alias("position"), matched.alias("matched"), (F.round(ratio(at) * 1e6) / 1e6).alias("ratio"), F.round(F.greatest(F.lit(0.0), F.least(score, F.lit(1.0))), 6).alias("score")),
        )

    return step.withColumn("candidates", F.array_compact(F.array(*[candidate(*f) for f in found])))


def qa_split(candidates: DataFrame) -> DataFrame:
    """The chosen candidate and both parts. A transition by management wins if another hit, headings aside, follows within
    4,000 characters; else the highest score, then the earliest position."""
    c = F.col("candidates")
    management = F.get(F.filter(c, lambda x: x["method"] == "management_qa_transition"), F.lit(0))
    step = candidates.withColumn("_m", management)
    follows = F.exists(c, lambda x: ~x["method"].isin("explicit_q_and_a_heading", "management_qa_transition") & (x["position"] > F.col("_m.position")) & (x["position"] - F.col("_m.position") <= 4000))
    order = F.array_sort(F.transform(c, lambda x, k: F.struct((-x["score"]).alias("s"), x["position"].alias("p"), k.alias("k"), x.alias("x"))))
    lifted = F.struct(F.col("_m.method").alias("method"), F.col("_m.position").alias("position"), F.col("_m.matched").alias("matched"), F.col("_m.ratio").alias("ratio"), F.greatest(F.col("_m.score"), F.lit(0.97)).alias("score"))
    step = step.withColumn("_b", F.when(follows, lifted).otherwise(F.get(order, F.lit(0))["x"]))
    text, at = F.col("text"), F.col("_b.position")
    step = step.withColumn("prepared", strip(F.when(at.isNull(), text).otherwise(F.substring(text, F.lit(1), at))))
    step = step.withColumn("qna", F.when(at.isNull(), F.lit("")).otherwise(strip(F.substring(text, at + 1, F.length(text)))))
    # format_number rounds the number itself; format_string its shortest decimal form, in which 2.55 is a tie that it is not.
    told = lambda name, x: F.concat(F.lit(f"{name}:"), x["method"], F.lit(":"), F.format_number(x["ratio"] * 100, 1), F.lit("%"))
    early = F.flatten(
        F.transform(
            c,
            lambda x: F.array_compact(
                F.array(
                    F.when((x["ratio"] < 0.12) & (x["method"] != "explicit_q_and_a_heading"), told("qna_candidate_very_early", x)),
                    F.when((x["ratio"] > 0.92) & x["method"].contains("fallback"), told("qna_fallback_candidate_very_late", x)),
                )
            ),
        )
    )
    own = F.array_compact(
        F.array(
            F.when((F.length("qna") > 0) & (count_words(F.col("qna")) < MIN_QA_WORDS), F.lit("qna_detected_but_too_short")),
            F.when((F.length("prepared") > 0) & (F.length("prepared") / F.greatest(F.length(text), F.lit(1)) < 0.10), F.lit("prepared_remarks_unusually_short")),
            F.when(F.col("_b.score") < 0.70, F.lit("low_confidence_qna_split")),
            F.when(F.col("_b.method").contains("fallback"), F.lit("qna_split_used_fallback_method")),
        )
    )
    none = F.array_compact(F.array(F.when(F.length(text) == 0, F.lit("empty_transcript_payload")).when(text.rlike(P.MENTION), F.lit("qna_mentioned_but_no_reliable_qna_start"))))
    step = step.withColumn("warnings", F.when(at.isNull(), none).otherwise(F.concat(early, own)))
    return step.select(*CALL, "raw", "text", F.col("_b.method").alias("method"), at.alias("position"), F.coalesce("_b.score", F.lit(0.0)).alias("score"), F.col("_b.matched").alias("matched"), "prepared", "qna", "warnings")


def ends_mid_sentence(raw: Column) -> Column:
    tail = strip(F.expr("right(regexp_replace(raw, '(?U)\\\\A\\\\s+|\\\\s+\\\\z', ''), 300)"))
    low = F.regexp_replace(F.lower(tail), r"[.!?\"'”’)\]}]+\z", "")
    unfinished = F.exists(F.array(*map(F.lit, P.UNFINISHED)), lambda x: F.endswith(low, x))
    return (F.length(tail) > 0) & (unfinished | ~tail.rlike(P.FINISHED))


def transcript_quality(split: DataFrame) -> DataFrame:
    """Counts, flags, warnings and status of each call; on the raw text but for the parts."""
    raw, qna = F.col("raw"), F.col("qna")
    step = split.select(
        *CALL,
        (F.length(raw) > 0).alias("has_text"),
        count_words(raw).alias("words"),
        count_words(F.col("prepared")).alias("prepared_words"),
        count_words(qna).alias("qna_words"),
        (F.length(qna) > 0).alias("qna_found"),
        raw.rlike(P.CLOSING).alias("closed"),
        raw.rlike(P.TRUNCATION).alias("truncated"),
        ends_mid_sentence(raw).alias("mid_sentence"),
        raw.rlike(P.MENTION).alias("mentioned"),
        F.regexp_count(qna, F.lit(P.QUESTION)).cast("long").alias("question_marks"),
        F.regexp_count(qna, F.lit(P.ANSWER)).cast("long").alias("answer_marks"),
        F.get("warnings", F.lit(0)).alias("split_warning"),
    )
    short = F.col("has_text") & (F.col("words") < MIN_CALL_WORDS)
    warnings = F.array_compact(
        F.array(
            F.when(~F.col("has_text"), F.lit("empty_transcript_payload")),
            F.when(short, F.lit("too_short_for_typical_full_earnings_call")),
            F.when(F.col("has_text") & ~F.col("qna_found"), F.when(F.col("mentioned"), F.lit("qna_mentioned_but_reliable_qna_start_not_detected")).otherwise(F.lit("qna_start_not_detected"))),
            F.col("split_warning"),
            F.when(F.col("qna_found") & (F.col("qna_words") < MIN_QA_WORDS), F.lit("qna_detected_but_too_short")),
            F.when(F.col("has_text") & ~F.col("closed"), F.lit("operator_close_not_detected")),
            F.when(F.col("truncated"), F.lit("explicit_truncation_marker_detected")),
            F.when(F.col("mid_sentence"), F.lit("ends_mid_sentence")),
        )
    )
    broken = ~F.col("has_text") | F.col("truncated") | F.col("mid_sentence") | ((F.col("words") < MIN_CALL_WORDS) & ~F.col("closed") & ~F.col("qna_found"))
    return step.withColumns(
        {
            "qna_complete": F.col("qna_found") & (F.col("qna_words") >= MIN_QA_WORDS) & F.col("closed"),
            "status": F.when(broken, "incomplete").when(F.col("closed"), "complete").otherwise("usable_with_warnings"),
            "warnings": F.array_join(warnings, ","),
        }
    ).drop("split_warning")


def transcript_sections(split: DataFrame, max_chars: int | None = None) -> DataFrame:
    """A row for each section of each call: full, prepared_remarks, q_and_a, metadata (empty)."""
    parts = F.array(*[F.struct(F.lit(n).alias("section"), t.alias("content")) for n, t in (("full", F.col("raw")), ("prepared_remarks", F.col("prepared")), ("q_and_a", F.col("qna")), ("metadata", F.lit("")))])
    rows = split.select(*CALL, F.inline(parts))
    return rows if max_chars is None else rows.withColumn("content", F.substring("content", 1, max_chars))


def transcript_chunks(calls: DataFrame, size: int = CHUNK) -> DataFrame:
    """Stretches of `size` characters; an empty text has none."""
    n = F.ceil(F.length("raw") / size).cast("int")
    rows = calls.where(F.length("raw") > 0).select(*CALL, "raw", n.alias("total_chunks"), F.explode(F.sequence(F.lit(1), n)).alias("chunk_index"))
    start = (F.col("chunk_index") - 1) * size
    return rows.select(*CALL, "chunk_index", "total_chunks", start.alias("start_char"), F.least(start + size, F.length("raw")).alias("end_char"), (F.col("chunk_index") == F.col("total_chunks")).alias("is_final"), F.substring(F.col("raw"), start + 1, F.lit(size)).alias("content"))


def speaker_positions(calls: DataFrame) -> DataFrame:
    return calls.select(*CALL, F.posexplode(hits(F.col("text"), P.TURN)).alias("turn", "position"))
