"""Press releases: fields from aliases, relevance to a requested quarter, and the best one with its rivals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.patterns import LIKELY_EARNINGS, LITIGATION, QUARTER_WORDS
from ..functions.text import clean_text, first_filled, lenient_date

MIN_SCORE, AUDITED, SPLITS = 55, 20, 16
_WORD = "(first|second|third|fourth)"


def _any(text: Column, phrases: list[str]) -> Column:
    return text.rlike("|".join(phrases))  # none of them holds a special character


#: Names under which feeds give a field, the first that holds something wins.
ALIASES = {
    "title": ["title", "headline", "subject"],
    "date": ["published_date", "date", "accepted_date", "filing_date", "created_at", "updated_at"],
    "url": ["url", "link", "source_url", "final_url"],
    "text": ["text", "content", "body", "summary", "description"],
    "publisher": ["publisher", "site", "source"],
    "company": ["company_name", "company", "name"],
}


def slug(c: Column, longest: int) -> Column:
    """ASCII letters and digits in lower case, anything between as one underscore; `unknown` if none is left."""
    trimmed = lambda x: F.regexp_replace(x, "^_+|_+$", "")
    own = trimmed(F.substring(trimmed(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "[^a-zA-Z0-9]+", "_"))), 1, longest))
    return F.coalesce(F.nullif(own, F.lit("")), F.lit("unknown"))


def detect_period(low: Column) -> Column:
    """Forms are tried in order, whatever their position: `Qn FYyyyy` or null. `low` is lower-cased."""
    quarter = F.create_map(*[x for k, w in enumerate(QUARTER_WORDS, 1) for x in (F.lit(w), F.lit(str(k)))])

    def form(pattern: str, year: int, q: int, word: bool) -> Column:
        hit = F.nullif(F.regexp_extract(low, pattern, q), F.lit(""))
        return F.concat(F.lit("Q"), quarter[hit] if word else hit, F.lit(" FY"), F.regexp_extract(low, pattern, year))

    return F.coalesce(
        form(rf"fiscal\s+(?:year\s+)?(\d{{4}})\s+{_WORD}[-\s]quarter", 1, 2, True),
        form(rf"{_WORD}[-\s]quarter\s+(?:(?:of|for)\s+)?(?:fiscal\s+(?:year\s+)?)?(\d{{4}})", 2, 1, True),
        form(r"\bq([1-4])\s+fy\s?(\d{4})\b", 2, 1, False),
        form(r"\bq([1-4])\s+fiscal\s+(\d{4})\b", 2, 1, False),
        form(r"\bq([1-4])\s+(\d{4})\b", 2, 1, False),
    )


def release_fields(releases: DataFrame) -> DataFrame:
    """One value for each field, whichever alias holds it; and all that does not depend on the request."""
    has = lambda field: [c for c in ALIASES[field] if c in releases.columns]
    filled = lambda field: first_filled(*has(field)) if has(field) else F.lit(None).cast("string")
    title = clean_text(F.coalesce(filled("title"), F.lit("Untitled press release")))
    dates = [lenient_date(F.col(c)) for c in has("date")]
    symbol = F.col("symbol") if "symbol" in releases.columns else F.lit(None).cast("string")
    rows = releases.select(
        "ticker", "row_ord", title.alias("title"), F.coalesce(*dates, F.lit(None).cast("date")).alias("release_date"), filled("url").alias("url"), clean_text(filled("text")).alias("text"),
        filled("publisher").alias("publisher"), filled("company").alias("company"), symbol.alias("symbol"),
    )
    host = F.lower(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")))
    # Named, so that each is computed once for all that asks of it.
    rows = rows.withColumns({"low": F.lower(F.concat_ws("\n", "title", "text", "url")), "host": host, "head": F.lower("title")})
    low, head, host = F.col("low"), F.col("head"), F.col("host")
    fixed = (
        F.when(_any(low, LIKELY_EARNINGS), 25).otherwise(0)
        + F.when(head.contains("results") & (head.contains("quarter") | head.contains("financial")), 20).otherwise(0)
        + F.when(head.contains("reports") | head.contains("announces"), 10).otherwise(0)
        - F.when(_any(head, LITIGATION), 100).otherwise(0)
        - F.when(head.contains("dividend"), 50).otherwise(0)
        + F.when(F.upper("symbol") == F.upper("ticker"), 20).otherwise(0)
    )
    return rows.withColumns(
        {
            "domain": F.replace(host, F.lit("www."), F.lit("")),
            "is_sec": host.contains("sec.gov"),
            "detected_period": detect_period(low),
            "fixed_score": fixed,
            "release_id": F.concat_ws("_", slug(F.col("ticker"), 20), F.coalesce(F.date_format("release_date", "yyyyMMdd"), F.lit("unknown")), slug(F.col("title"), 90)),
            # What a request can ask of the text, as tokens: the pair join carries these, not the text.
            "years": F.array_distinct(F.regexp_extract_all(low, F.lit(r"(?=([0-9]{4}))"), F.lit(1))),
            "fiscal_years": F.array_distinct(F.regexp_extract_all(low, F.lit(r"fiscal ([0-9]{4})"), F.lit(1))),
            "short_quarters": F.array_distinct(F.regexp_extract_all(low, F.lit(r"q([1-4])"), F.lit(1))),
            "word_quarters": F.array_distinct(F.regexp_extract_all(low, F.lit(rf"{_WORD} quarter"), F.lit(1))),
        }
    ).drop("low", "head", "host")


def release_contenders(fields: DataFrame, requests: DataFrame, n: int = AUDITED) -> DataFrame:
    """Of `release_fields`, without texts, those that can be among the n best of any request for their ticker, and no other that
    a rule can tell.

    A request's points depend only on which of the requested years, quarters and periods a release names, and on its year.
    Releases of a ticker that agree in these keep one order in every request, by the points of their own, date and feed; so
    of each such kind the first n are enough. In two steps, as no task is to sort all of a busy ticker.
    """
    text = lambda c: F.col(c).cast("string")
    wanted = F.concat(F.lit("Q"), text("quarter"), F.lit(" FY"), text("fiscal_year"))
    asked = requests.groupBy("ticker").agg(F.collect_set(text("fiscal_year")).alias("ys"), F.collect_set(text("quarter")).alias("qs"), F.collect_set(wanted).alias("ps"))
    public = fields.where(F.col("url").isNotNull() & ~F.col("is_sec")).drop("text").join(asked, "ticker")
    both = lambda a, b: F.array_sort(F.array_intersect(a, b))
    kind = F.struct(
        both("years", "ys").alias("years"), both("fiscal_years", "ys").alias("fiscal"), both("short_quarters", "qs").alias("short"), F.array_sort("word_quarters").alias("words"),
        F.when(F.array_contains("ps", F.col("detected_period")), F.col("detected_period")).when(F.col("detected_period").isNotNull(), "other").alias("period"),
        F.array_sort(F.filter("ys", lambda y: F.abs(F.year("release_date") - y.cast("int")) <= 1)).alias("near"),
    )
    order = [F.desc("fixed_score"), F.desc_nulls_last("release_date"), F.asc("row_ord")]
    split = public.withColumns({"_kind": kind, "_part": F.pmod(F.xxhash64("row_ord"), F.lit(SPLITS))}).drop("ys", "qs", "ps")
    some = split.withColumn("_rank", F.row_number().over(W.partitionBy("ticker", "_kind", "_part").orderBy(*order))).where(F.col("_rank") <= n)
    return some.withColumn("_rank", F.row_number().over(W.partitionBy("ticker", "_kind").orderBy(*order))).where(F.col("_rank") <= n).drop("_kind", "_part", "_rank")


def release_scores(fields: DataFrame, requests: DataFrame) -> DataFrame:
    """Every public release of a ticker against every request for it."""
    public = fields.where(F.col("url").isNotNull() & ~F.col("is_sec")).drop("text")
    pairs = public.join(requests, "ticker")
    year, quarter = F.col("fiscal_year").cast("string"), F.col("quarter").cast("string")
    word = F.element_at(F.array(*map(F.lit, QUARTER_WORDS)), F.col("quarter").cast("int"))
    wanted = F.concat(F.lit("Q"), quarter, F.lit(" FY"), year)
    score = (
        F.col("fixed_score")
        + F.when(F.array_contains("years", year), 15).otherwise(0)
        + F.when(F.array_contains("short_quarters", quarter), 15).otherwise(0)
        + F.when(F.array_contains("word_quarters", word), 30).otherwise(0)
        + F.when(F.array_contains("fiscal_years", year), 20).otherwise(0)
        + F.when(F.col("detected_period") == wanted, 60).when(F.col("detected_period").isNotNull(), -100).otherwise(0)
        + F.when(F.abs(F.year("release_date") - F.col("fiscal_year")) <= 1, 5).otherwise(0)
    )
    return pairs.select("ticker", "fiscal_year", "quarter", "row_ord", "release_id", "title", "release_date", "url", "publisher", "company", score.cast("long").alias("score"))


def release_candidates(scores: DataFrame, n: int = AUDITED) -> DataFrame:
    """The n best of each request: by score, then date (none last), then order of the feed.

    In two steps, so that no task sorts all releases of a busy ticker: the n best of each of `SPLITS` parts of a request,
    then of what these leave.
    """
    keys, order = ["ticker", "fiscal_year", "quarter"], [F.desc("score"), F.desc_nulls_last("release_date"), F.asc("row_ord")]
    split = scores.withColumn("_part", F.pmod(F.xxhash64("row_ord"), F.lit(SPLITS)))
    some = split.withColumn("rank", F.row_number().over(W.partitionBy(*keys, "_part").orderBy(*order))).where(F.col("rank") <= n)
    return some.drop("_part").withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def release_best(candidates: DataFrame, least: int = MIN_SCORE) -> DataFrame:
    return candidates.where((F.col("rank") == 1) & (F.col("score") >= least)).drop("rank")


def release_failures(requests: DataFrame, candidates: DataFrame, least: int = MIN_SCORE) -> DataFrame:
    """Requests without an answer, and why."""
    top = candidates.where("rank = 1").select("ticker", "fiscal_year", "quarter", F.col("score").alias("best_score"))
    out = requests.join(top, ["ticker", "fiscal_year", "quarter"], "left").where(F.col("best_score").isNull() | (F.col("best_score") < least))
    return out.withColumn("error", F.when(F.col("best_score").isNull(), "no_public_release").otherwise("below_minimum_score"))
