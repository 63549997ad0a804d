"""Latest call periods of each company, and the statement rows that match them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import lenient_int, quarter_code, quarter_word


def valid_symbols(rows: DataFrame) -> DataFrame:
    """Symbols trimmed and upper-cased, with whether the form is allowed (letters, digits, dot, dash, backslash; 12 at most)."""
    clean = F.upper(F.trim("symbol"))
    return rows.select(clean.alias("symbol"), F.coalesce(clean.rlike(r"^[A-Za-z0-9.\\\-]{1,12}$"), F.lit(False)).alias("valid")).distinct()


def latest_periods(dates: DataFrame, n: int = 2, min_year: int = 2025) -> DataFrame:
    """The last n periods of each company; ties keep the order of the feed."""
    filled = lambda c: F.when((F.col(c) != "") & (F.col(c) != "0"), F.col(c))
    rows = dates.select("symbol", lenient_int(F.coalesce(filled("year"), F.col("fiscal_year"))).alias("year"), lenient_int(F.col("quarter")).alias("quarter"), "call_date", "row_ord")
    rows = rows.where(F.col("year").isNotNull() & F.col("quarter").isNotNull() & (F.col("year") >= min_year))
    order = W.partitionBy("symbol").orderBy(F.desc("year"), F.desc("quarter"), F.desc(F.coalesce("call_date", F.lit(""))), "row_ord")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return ranked.select("symbol", "rank", "year", "quarter", F.format_string("Q%d %d", "quarter", "year").alias("period_label"), "call_date")


def latest_fiscal_year(periods: DataFrame) -> DataFrame:
    """The last completed fiscal year: that of the latest period if it is a fourth quarter, else the one before."""
    top = periods.groupBy("symbol").agg(F.max(F.struct("year", "quarter")).alias("top"))
    return top.select("symbol", F.when(F.col("top.quarter") == 4, F.col("top.year")).otherwise(F.col("top.year") - 1).alias("fiscal_year"))


def statement_tables(statements: DataFrame, quarters: int = 2, years: int = 3) -> DataFrame:
    """The newest rows of each table: 1 to 4 quarters as asked, and some years."""
    limit = F.when(F.col("freq") == "quarter", F.greatest(F.lit(1), F.least(F.lit(quarters), F.lit(4)))).otherwise(F.lit(years))
    order = W.partitionBy("symbol", "table_name", "freq").orderBy("row_ord")
    # Dealt by company, so that what follows by company moves these rows no more.
    ranked = statements.repartition("symbol").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(4, years))
    return ranked.where(F.col("rank") <= limit)


def _row(tables: DataFrame) -> Column:
    """A statement row as a struct of all columns but the keys, newest first when sorted. Measures are open: a map of them becomes
    its entries by name, as maps have no order."""
    maps = {f.name for f in tables.schema if f.dataType.typeName() == "map"}
    own = [c for c in tables.columns if c not in ("symbol", "table_name", "freq", "rank")]
    return F.struct("rank", *[F.array_sort(F.map_entries(c)).alias(c) if c in maps else F.col(c) for c in own])


def period_match(tables: DataFrame, periods: DataFrame, allow_fallback: bool = False) -> DataFrame:
    """For each company and quarterly table its rows that match a selected period exactly ('Q1', never '1'), and a status.

    With `allow_fallback`, tables without a match give as many of their newest rows as the company has periods. Rows are
    structs of all columns of `tables` but the keys, newest first, with any measures they hold.
    """
    # A company's few periods meet its rows as one array, by company alone: the rows of a company stay where they are.
    wanted = F.collect_set(F.struct(F.col("year").alias("fy"), F.concat(F.lit("Q"), F.col("quarter").cast("string")).alias("p"))).alias("asked")
    asked = periods.groupBy("symbol").agg(wanted)
    rows = tables.where("freq = 'quarter'").withColumn("row", _row(tables)).withColumns({"fy_": lenient_int(F.col("fiscal_year")), "p_": F.upper("period")})
    hit = F.exists("asked", lambda x: (x["fy"] == F.col("fy_")) & (x["p"] == F.col("p_")))
    joined = rows.select("symbol", "table_name", "row", "fy_", "p_").join(asked, "symbol", "left").withColumn("hit", F.when(hit, True))
    out = joined.groupBy("symbol", "table_name").agg(
        F.count("hit").alias("n_matched"),
        F.array_sort(F.collect_list(F.when(F.col("hit"), F.col("row")))).alias("matched_rows"),
        F.array_sort(F.collect_list("row")).alias("all_rows"),
        F.max(F.when(F.col("asked").isNotNull(), F.size(F.filter("asked", lambda x: x["fy"].isNotNull() & x["p"].isNotNull())))).alias("n_periods"),
    )
    if allow_fallback:
        out = out.withColumn("fallback_rows", F.when((F.col("n_matched") == 0) & F.col("n_periods").isNotNull(), F.slice("all_rows", F.lit(1), F.col("n_periods"))).otherwise(F.slice("all_rows", 1, 0)))
    else:
        out = out.withColumn("fallback_rows", F.slice("all_rows", 1, 0))
    out = out.withColumn("fallback_used", F.size("fallback_rows") > 0).drop("all_rows", "n_periods")
    return out.withColumn("match_status", F.when(F.col("n_matched") > 0, "exact_period_match").otherwise("no_exact_period_match"))


def annual_match(tables: DataFrame, years: DataFrame) -> DataFrame:
    """For each company and yearly table its rows of the last completed fiscal year, and a status."""
    wanted = years.select("symbol", F.col("fiscal_year").alias("fy"))
    rows = tables.where("freq = 'annual' and table_name in ('income_statement', 'balance_sheet', 'cash_flow_statement')")
    joined = rows.withColumn("row", _row(tables)).join(wanted, "symbol")
    hit = lenient_int(F.col("fiscal_year")) == F.col("fy")
    out = joined.groupBy("symbol", "table_name", "fy").agg(F.count(F.when(hit, 1)).alias("n_matched"), F.array_sort(F.collect_list(F.when(hit, F.col("row")))).alias("matched_rows"))
    return out.withColumn("match_status", F.when(F.col("n_matched") > 0, "exact_fiscal_year_match").otherwise("no_exact_fiscal_year_match")).withColumnRenamed("fy", "fiscal_year")


def followup_actions(periods: DataFrame, requested: int = 2) -> DataFrame:
    """Rows (symbol, scope, period_label, limit): three sources to read per period, statements to review per company."""
    scopes = F.array(*map(F.lit, ("selected_quarter_prepared_remarks", "selected_quarter_q_and_a", "selected_quarter_official_earnings_release")))
    each = periods.select("symbol", F.explode(scopes).alias("scope"), "period_label", F.lit(None).cast("int").alias("row_limit"))
    years = latest_fiscal_year(periods).select("symbol", F.lit("latest_completed_fiscal_year").alias("scope"), F.format_string("FY%d", "fiscal_year").alias("period_label"), F.lit(3).alias("row_limit"))
    found = F.count(F.lit(1)).cast("int")
    quarters = periods.groupBy("symbol").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "period_label"))), lambda x: x["period_label"]), ", ").alias("period_label"), F.greatest(F.lit(1), F.least(found, F.lit(4))).alias("row_limit"))
    return each.unionByName(years).unionByName(quarters.select("symbol", F.lit("selected_quarters").alias("scope"), "period_label", "row_limit"))


def recheck_actions(quality: DataFrame) -> DataFrame:
    """(symbol, year, quarter, scope, min_year): dates to look at again for calls (symbol, year, quarter, status) whose text is incomplete."""
    # Exploded, as a filter on the status would be pushed below what computes it and compute that once more.
    scope = F.explode_outer(F.when(F.col("status") == "incomplete", F.array(F.lit("recheck_transcript_dates")))).alias("scope")
    return quality.select("symbol", "year", "quarter", scope, F.greatest(F.lit(2000), F.col("year") - 1).cast("int").alias("min_year")).where("scope is not null")


def widen_actions(symbols: DataFrame, periods: DataFrame, min_year: int) -> DataFrame:
    """(symbol, scope, min_year): companies without a period at or after `min_year`, to be asked for one year more."""
    return symbols.select("symbol").distinct().join(periods, "symbol", "left_anti").select("symbol", F.lit("widen_min_year").alias("scope"), F.lit(min_year - 1).alias("min_year"))


def period_labels(periods: DataFrame) -> DataFrame:
    """(symbol, year, quarter, quarter_code, quarter_word, call_label, release_label) for whatever way a quarter is written; null
    labels where it is none."""
    code = quarter_code(F.col("quarter"))
    return periods.select("symbol", "year", "quarter", code.alias("quarter_code"), quarter_word(code).alias("quarter_word"), F.concat_ws(" ", F.when(code.isNotNull(), code), F.when(code.isNotNull(), F.col("year").cast("string"))).alias("call_label"), F.concat(code, F.lit(" FY"), F.col("year").cast("string")).alias("release_label"))


def evidence_pack(symbols: DataFrame, periods: DataFrame, quarterly: DataFrame, annual: DataFrame, actions: DataFrame, requested: int = 2) -> DataFrame:
    """One row per company, of `symbols` or with a period: its periods, tables with their matched rows, transcripts to fetch
    and actions as arrays, and notes; missing parts are null."""
    labels = periods.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("rank", "year", "quarter", "period_label", "call_date"))).alias("selected_periods"))
    kept = lambda df: [c for c in ("fiscal_year", "match_status", "n_matched", "matched_rows", "fallback_rows", "fallback_used") if c in df.columns]
    tables = quarterly.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("table_name", *kept(quarterly)))).alias("financial_tables"))
    years = annual.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("table_name", *kept(annual)))).alias("annual_tables"))
    next_ = actions.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("scope", "period_label", "row_limit"))).alias("actions"))
    out = symbols.select("symbol").unionByName(periods.select("symbol")).distinct()
    for part in (labels, latest_fiscal_year(periods), tables, years, next_):
        out = out.join(part, "symbol", "left")
    found = F.when(F.col("selected_periods").isNull(), 0).otherwise(F.size("selected_periods"))
    transcripts = F.transform("selected_periods", lambda p: F.struct(p["period_label"].alias("period_label"), F.lit(True).alias("transcript_available"), F.lit(False).alias("prepared_remarks_included"), F.lit(False).alias("q_and_a_included")))
    notes = F.array_compact(F.array(F.when(found < requested, F.lit("fewer_transcript_periods_found_than_requested")), F.when(found == 0, F.lit("no_selected_periods"))))
    return out.withColumn("transcripts", transcripts).withColumn("notes", F.array_sort(F.array_distinct(notes)))
