"""Regulatory filings: which matter, the best for a requested quarter, and the documents inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.patterns import CAPITAL_RETURN, CAPITAL_WORDS, EARNINGS_LIKE, EARNINGS_RELEASE, EXHIBIT_99, FIRST_EXHIBIT, LATER_EXHIBIT, LEGAL_EXHIBIT, LEGAL_WORDS, POSITIVE_SEARCH, POSITIVE_TERMS, QUARTER_WORDS, RELEASE_WORDS, RELEVANT_FORMS, RESULTS_ITEM, RESULTS_WORDS
from ..functions.text import date_range, filing_text, holds, lenient_date, squeeze, strip_all
from ..sources.staging import written
from .html import page_texts, parse_pages
from .tables import compact_row, fit_row, markdown_lines, page_class, period_headers, table_label

#: Least score; characters of a text that can be a headline or name a table; days beyond which nearness counts for nothing.
MIN_FILING_SCORE, SHORT, BAND = 250, 220, 90
#: Words of which a page that a pattern fits holds one at least.
PAGE_WORDS = {"legal_words": LEGAL_WORDS, "capital_words": CAPITAL_WORDS}


def filing_search(filings: DataFrame, from_date: str, to_date: str) -> DataFrame:
    """(symbol, kind, rank, ...): the first 12 relevant and first 6 earnings-like filings of a window, in feed order, and how
    many of all are left out. A filing is earnings-like by anything in its row. Raises if the window is none."""
    checked = filings.sparkSession.range(1).select(date_range(F.lit(from_date).cast("string"), F.lit(to_date).cast("string"))).first()[0]
    if checked != "ok":
        raise ValueError(checked)
    own = filings.where((F.col("filing_date") >= (from_date or "")) & (F.col("filing_date") <= (to_date or "9999-12-31"))).withColumn("form", F.upper("form"))
    relevant = F.col("form").isin(RELEVANT_FORMS)
    earnings = F.col("form").isin("8-K", "6-K") & F.concat_ws(" ", *[F.col(c).cast("string") for c in filings.columns if filings.schema[c].dataType.typeName() not in ("array", "map", "struct")]).rlike(EARNINGS_LIKE)
    counts = own.groupBy("symbol").agg(F.greatest(F.lit(0), F.count(F.lit(1)) - F.least(F.lit(12), F.count_if(relevant))).alias("omitted"))
    kinds = F.array_compact(F.array(F.lit("relevant"), F.when(earnings, F.lit("earnings"))))
    rows = own.where(relevant).select("symbol", "row_ord", "accession", "form", F.explode(kinds).alias("kind"))
    order = W.partitionBy("symbol", "kind").orderBy("row_ord")
    top = rows.withColumn("rank", F.row_number().over(order)).where("rank <= 12").where("kind = 'relevant' or rank <= 6")
    return top.join(counts, "symbol").drop("row_ord")


def filing_pairs(filings: DataFrame, requests: DataFrame) -> DataFrame:
    """(symbol, fiscal_year, quarter, accession, form, filing_date, row_ord, score): for each request (symbol, fiscal_year, quarter,
    anchor_date) the filings that can be its best, and no other.

    Two kinds can. Those within `BAND` days of the anchor: a company's requests stand beside each of its filings as an array, of
    which the near ones become rows, so that filings are moved once, by their company. All others differ for a request only in
    which of the company's requested years and quarters they name, so of those that name the same the best by the rest stands for
    all: pairs grow with filings near an anchor and with what filings can name, not with a company's filings times its requests.
    Such a stand-in may lie near an anchor itself; then it scores higher there than any other that it stands for.
    """
    about = ["form", "filing_date", "report_date", "items", "accession", "primary_document", *[c for c in ("primary_doc_description",) if c in filings.columns]]
    anchored = requests.select("symbol", "fiscal_year", "quarter", lenient_date(F.col("anchor_date")).alias("anchor"))
    asked = anchored.groupBy("symbol").agg(
        F.array_sort(F.collect_set(F.col("fiscal_year").cast("string"))).alias("years"),
        F.array_sort(F.collect_set(F.col("quarter").cast("string"))).alias("quarters"),
        F.collect_list(F.struct("fiscal_year", "quarter", "anchor")).alias("asked"),
    )
    rows = filings.withColumn("form", F.upper("form")).where(F.col("form").isin(RELEVANT_FORMS)).withColumn("everything", F.concat_ws(" ", *about)).withColumn("low", F.lower("everything"))
    everything, low = F.col("everything"), F.col("low")
    fixed = (
        F.when(F.col("form").isin("8-K", "6-K"), 1000).otherwise(250)
        + F.when(holds(F.col("items"), F.lower("items"), RESULTS_ITEM, RESULTS_WORDS), 350).otherwise(0)
        + F.when(holds(everything, low, EARNINGS_RELEASE, RELEASE_WORDS), 175).otherwise(0)
    )
    named = F.array_distinct(F.regexp_extract_all(low, F.lit(r"\bq([0-9]+)\b"), F.lit(1)))
    # Null where a filing names every quarter.
    named = F.when(low.contains("quarter"), None).when(low.contains("q"), named).otherwise(F.array().cast("array<string>"))
    own = rows.withColumns({"fixed": fixed, "named": named}).join(asked, "symbol").select(
        "symbol", "accession", "form", "filing_date", "row_ord", "fixed", lenient_date(F.col("filing_date")).alias("filed"),
        F.filter("years", lambda y: F.contains(everything, y)).alias("years"),
        F.filter("years", lambda y: F.contains(F.col("report_date"), y)).alias("reported"),
        F.when(F.col("named").isNull(), F.col("quarters")).otherwise(F.array_intersect("quarters", "named")).alias("quarters"), "asked",
    )
    names = ["years", "reported", "quarters"]
    body = ["accession", "form", "filing_date", "row_ord", "fixed", "filed"]
    stands = own.groupBy("symbol", *names).agg(F.max_by(F.struct(*body), F.struct("fixed", "filing_date", -F.col("row_ord"))).alias("b")).select("symbol", *names, "b.*")
    # The outer form, as the plain one adds a filter on the array, which would be computed once more.
    near = own.select("symbol", *names, *body, F.explode_outer(F.filter("asked", lambda x: F.abs(F.datediff("filed", x["anchor"])) <= BAND)).alias("r")).where(F.col("r").isNotNull())
    pairs = near.select("symbol", *names, *body, "r.*").unionByName(stands.join(anchored, "symbol"))
    year, days = F.col("fiscal_year").cast("string"), F.abs(F.datediff("filed", "anchor"))
    score = (
        F.col("fixed")
        + F.when(F.array_contains("years", year), 40).otherwise(0)
        + F.when(F.array_contains("quarters", F.col("quarter").cast("string")), 30).otherwise(0)
        + F.when(days <= 2, 350).when(days <= 14, 250).when(days <= 45, 150).when(days <= BAND, 50).otherwise(0)
        + F.when(F.array_contains("reported", year), 50).otherwise(0)
    )
    return pairs.select("symbol", "fiscal_year", "quarter", "accession", "form", "filing_date", "row_ord", score.cast("long").alias("score"))


def filing_rank(filings: DataFrame, requests: DataFrame) -> DataFrame:
    """The best filing of each request (symbol, fiscal_year, quarter, anchor_date), if it scores enough: by score, date, then order
    of the feed. An aggregate, which tasks combine before the shuffle."""
    best = F.max_by(F.struct("accession", "form", "filing_date", "score"), F.struct("score", "filing_date", -F.col("row_ord"))).alias("best")
    ranked = filing_pairs(filings, requests).groupBy("symbol", "fiscal_year", "quarter").agg(best)
    return ranked.select("symbol", "fiscal_year", "quarter", "best.*").where(F.col("score") >= MIN_FILING_SCORE)


def cik_lookup(symbols: DataFrame, ticker_map: DataFrame) -> DataFrame:
    """Symbols with their ten-digit number, whatever their case; those without one have status unknown_symbol. Of several rows
    of a ticker the first of the map (`row_ord`, else the smallest number) counts."""
    order = "row_ord" if "row_ord" in ticker_map.columns else "cik_int"
    table = ticker_map.groupBy(F.upper("ticker").alias("t")).agg(F.min_by(F.struct("cik_int", "title"), order).alias("m")).select("t", F.lpad(F.col("m.cik_int").cast("string"), 10, "0").alias("cik"), "m.title")
    out = symbols.join(table, F.upper("symbol") == F.col("t"), "left")
    return out.select("symbol", "cik", "title", F.when(F.col("cik").isNull(), "unknown_symbol").otherwise("ok").alias("status"))


def submissions_rows(blocks: DataFrame, key: str = "symbol") -> DataFrame:
    """(key, row_ord, a column per array) for blocks of parallel arrays: as many rows as the longest has, shorter ones padded with
    nulls; columns that are no arrays are ignored."""
    arrays = [f.name for f in blocks.schema if f.dataType.typeName() == "array"]
    return blocks.select(key, F.posexplode(F.arrays_zip(*[F.coalesce(F.col(c), F.array().cast(blocks.schema[c].dataType)).alias(c) for c in arrays])).alias("row_ord", "r")).select(key, "row_ord", *[F.col(f"r.{c}").alias(c) for c in arrays])


def filing_documents(documents: DataFrame) -> DataFrame:
    """HTML and text documents with their tier (1: exhibits 99, 2: not legal, 3: others), metadata score and address; and the
    best of each filing, of the lowest tier there is."""
    rows = documents.where(F.col("name").rlike(r"(?i)\.(?:htm|html|txt)$")).withColumn("_about", F.concat_ws(" ", "name", "description", "type"))
    about, low = F.col("_about"), F.lower("_about")
    # Columns, as tier and score both ask for them. All patterns of exhibits 99 hold the number, and are found by the first.
    rows = rows.withColumns({"_legal": holds(about, low, LEGAL_EXHIBIT, LEGAL_WORDS), "_exhibit": about.contains("99") & about.rlike(EXHIBIT_99)})
    legal, exhibit = F.col("_legal"), F.col("_exhibit")
    score = (
        F.when(legal, -5000).otherwise(0)
        + F.when(exhibit, F.when(about.rlike(FIRST_EXHIBIT), 3700).when(about.rlike(LATER_EXHIBIT), 2850).otherwise(3000)).otherwise(0)
        + F.when(F.col("name") == F.col("primary_document"), 100).otherwise(0)
        + F.when(holds(about, low, EARNINGS_RELEASE, RELEASE_WORDS), 300).otherwise(0)
        + F.when(F.lower("name").rlike(r"\.html?$"), 50).otherwise(0)
    )
    rows = rows.select(
        "accession",
        "name",
        F.when(exhibit & ~legal, 1).when(~legal, 2).otherwise(3).alias("tier"),
        score.cast("long").alias("score"),
        F.concat_ws("/", F.lit("https://www.sec.gov/Archives/edgar/data"), F.col("cik_int").cast("string"), F.replace("accession", F.lit("-"), F.lit("")), "name").alias("url"),
    )
    order = W.partitionBy("accession").orderBy("tier", F.desc("score"), F.desc("name"))
    return rows.withColumn("rank", F.row_number().over(order))


def period_text_score(low: Column, said: Column, year: Column, quarter: Column) -> Column:
    """How much a lower-cased text speaks of a quarter and of no other; 0 where no quarter is asked for. `said` tells for each
    quarter whether the text names it."""
    word = F.element_at(F.array(*map(F.lit, QUARTER_WORDS)), quarter.cast("int"))
    y, q = year.cast("string"), F.concat(F.lit("q"), quarter.cast("string"))
    forms = F.concat(word, F.lit(r"\s+quarter\s+(?:fiscal\s+)?"), y, F.lit(r"|fiscal\s+"), y, F.lit(r"\s+"), word, F.lit(r"\s+quarter|"), q, F.lit(r"\s+(?:fy|fiscal\s+)?"), y)
    own = F.element_at(said, quarter.cast("int"))
    others = F.when(own, 0).otherwise(F.size(F.filter(said, lambda x: x)))
    # The forms are compiled for each row, so only for texts that hold their words.
    told = F.contains(low, y) & (F.contains(low, q) | (F.contains(low, word) & low.contains("quarter"))) & F.regexp_like(low, forms)
    score = F.when(told, 2500).otherwise(0) + F.when(F.contains(low, y), 200).otherwise(0) + F.when(own, 500).otherwise(0) + F.when(F.contains(low, q), 250).otherwise(0) - 600 * others
    return F.when(year.isNull() | quarter.isNull(), 0).otherwise(score)


def with_content_score(read: DataFrame, asked: str) -> DataFrame:
    """`read` (text, n_tables, neither null) with fiscal_year, quarter and content_score, a row for each request of the array
    `asked`, one without a period where it is null; n_chars for the text. All that no request changes is found once for a text;
    its terms and words are those that `page_texts` found, where `read` has them."""
    text, tables, positive, size = F.col("text"), F.col("n_tables"), F.col("_positive"), F.col("n_chars")
    counted = "n_terms" in read.columns
    # Twelve terms are the most that count: the search ends there.
    found = F.least("n_terms", F.lit(12)) if counted else F.size(F.split(text, POSITIVE_SEARCH, 13)) - 1
    step = read.withColumns({"_low": F.lower(F.left(text, F.lit(40_000))), "_positive": found, "n_chars": F.length(text)})
    step = step.withColumn("_head", F.when(size <= 20_000, text).otherwise(F.left(text, F.lit(20_000))))
    low = F.col("_low")  # of twice the head: what the head holds it holds
    tells = lambda name, pattern: F.col(name) & F.col("_head").rlike(pattern) if counted else holds(F.col("_head"), low, pattern, PAGE_WORDS[name])
    fixed = (
        F.when(tells("legal_words", LEGAL_EXHIBIT), -5000).otherwise(0)
        + positive * 180
        + F.when(tables >= 3, 500).otherwise(tables * 50)
        + F.when(size >= 10_000, 200).when(size >= 5000, 80).otherwise(0)
        - F.when((positive < 3) & (tables < 3) & tells("capital_words", CAPITAL_RETURN), 1200).otherwise(0)
    )
    said = F.array(*[low.contains(f"{w} quarter") for w in QUARTER_WORDS])
    step = step.withColumns({"_fixed": fixed, "_said": said}).drop("text", "_head", "_positive", "n_terms", *PAGE_WORDS)
    each = step.withColumn("_asked", F.explode_outer(asked)).drop(asked)
    year, quarter = F.col("_asked.fiscal_year"), F.col("_asked.quarter")
    period = F.coalesce(period_text_score(low, F.col("_said"), year, quarter), F.lit(0))
    return each.withColumns({"fiscal_year": year, "quarter": quarter, "content_score": (F.col("_fixed") + period).cast("long")}).drop("_low", "_said", "_fixed", "_asked")


def read_first(documents: DataFrame, n: int = 12) -> DataFrame:
    """Of ranked `filing_documents` those to be read: the n best of the lowest tier that a filing has."""
    lowest = documents.withColumn("lowest", F.min("tier").over(W.partitionBy("accession")))
    return lowest.where((F.col("tier") == F.col("lowest")) & (F.col("rank") <= n)).select("accession", "name", "tier", F.col("score").alias("metadata_score"), "url")


def _asked_pages(first: DataFrame, pages: DataFrame) -> DataFrame:
    return pages.join(first.select("accession", "name"), ["accession", "name"], "left_semi").select("accession", "name", "html")


def exhibit_contents(first: DataFrame, pages: DataFrame) -> DataFrame:
    """(accession, name, text, n_tables, sections, error) for the documents in `first`, each page (accession, name, html; a row
    each) parsed once. Other pages go before any is moved; what is left is dealt to tasks by bytes, as pages differ in size a thousandfold."""
    parsed = parse_pages(_asked_pages(first, pages).hint("rebalance"), ["accession", "name"], with_text=True)
    n_tables = F.size(F.filter("sections", lambda s: s["kind"] == "table"))
    return parsed.select("accession", "name", filing_text(F.col("text")).alias("text"), F.coalesce(n_tables, F.lit(0)).alias("n_tables"), "sections", "error")


def exhibit_best(first: DataFrame, contents: DataFrame, requests: DataFrame) -> DataFrame:
    """The best of the documents read, for each filing and each request for it (accession, fiscal_year, quarter; either may be
    null); a filing without one is ranked without a period."""
    # Requests meet documents before texts do, so that texts are moved once.
    read = _with_requests(first, requests).join(contents.select("accession", "name", "text", "n_tables"), ["accession", "name"], "left")
    return _best_scored(with_content_score(read.withColumns({"text": F.coalesce("text", F.lit("")), "n_tables": F.coalesce("n_tables", F.lit(0))}), "asked"), F.count(F.lit(1)))


def _with_requests(first: DataFrame, requests: DataFrame) -> DataFrame:
    """Documents with the requests for their filing as the array `asked`, null without one."""
    return first.join(requests.groupBy("accession").agg(F.collect_list(F.struct("fiscal_year", "quarter")).alias("asked")), "accession", "left")


def _best_scored(scored: DataFrame, n_read: Column) -> DataFrame:
    scored = scored.withColumn("score", F.col("metadata_score") + F.col("content_score"))
    best = F.max_by(F.struct("name", "url", "metadata_score", "content_score", "score", "n_chars"), F.struct("score", "n_chars", "name")).alias("best")
    return scored.groupBy("accession", "fiscal_year", "quarter").agg(n_read.alias("n_read"), best).select("accession", "fiscal_year", "quarter", "n_read", "best.*")


def exhibit_rank(documents: DataFrame, contents: DataFrame, requests: DataFrame, n: int = 12) -> DataFrame:
    """The exhibit of each filing that reads most like the release asked for.

    `documents` are ranked `filing_documents`: of the lowest tier that a filing has, the n best by what is known about
    them are read (`contents`: accession, name, text, n_tables; no row counts as empty) and scored for the filing's request
    (accession, fiscal_year, quarter; either may be null).
    """
    return exhibit_best(read_first(documents, n), contents, requests)


def filing_exhibits(documents: DataFrame, pages: DataFrame, requests: DataFrame, n: int = 12) -> tuple[DataFrame, DataFrame]:
    """`exhibit_best` over raw pages in two phases, and the parsed pages: what is known about documents says which are read,
    and no other page is. Both stand on written tables."""
    first = written(read_first(filing_documents(documents), n), "exhibits")
    contents = written(exhibit_contents(first, pages), "contents")
    return exhibit_best(first, contents, requests), contents


def exhibits_by_pages(documents: DataFrame, pages: DataFrame, requests: DataFrame, n: int = 12) -> DataFrame:
    """The first of `filing_exhibits` alone: of a page only its text and the number of its tables are kept, and not written.

    A page (one for each accession and name) meets what is known about its documents, and the requests for their filing, before
    it is read: it is read and scored once, where it lies, and its text is not moved."""
    own = _with_requests(read_first(filing_documents(documents), n), requests)
    # Documents of one name that are known alike are one, counted: an aggregate that needs no order.
    first = written(own.groupBy("accession", "name", "metadata_score", "url", "asked").agg(F.count(F.lit(1)).alias("n_alike")), "exhibits")
    texts = page_texts(first.join(_asked_pages(first, pages), ["accession", "name"], "left"), first.columns, POSITIVE_TERMS.removeprefix("(?i)"), PAGE_WORDS)
    return _best_scored(with_content_score(texts, "asked"), F.sum("n_alike"))


def filing_headline(sections: Column) -> Column:
    """Of the first 20 sections the first short text that tells of results, else the first short text, else a constant."""
    short = F.filter(F.slice(sections, 1, 20), lambda s: (s["kind"] != "table") & (F.length(s["text"]) <= SHORT))
    low = lambda s: F.lower(s["text"])
    tells = F.filter(short, lambda s: (low(s).contains("reports") | low(s).contains("announces")) & (low(s).contains("results") | low(s).contains("earnings")))
    return F.coalesce(F.get(tells, F.lit(0))["text"], F.get(short, F.lit(0))["text"], F.lit("Earnings Release of a Filing"))


def filing_markdown(parsed: DataFrame, header: dict[str, Column], keys: list[str]) -> DataFrame:
    """(keys, headline, n_tables, markdown) for parsed pages (keys, sections, and what `header` needs).

    Sections are rows in order; one sort serves what each needs of those before it: the last text, which is not said again even
    after a table, the last short text, which names the next table, and the number of tables so far. A page without sections
    has a header and a headline.
    """
    top = parsed.withColumn("headline", filing_headline(F.coalesce("sections", F.array().cast(parsed.schema["sections"].dataType))))
    rows = top.select(*keys, "headline", F.posexplode_outer("sections").alias("p", "s")).select(*keys, "headline", "p", "s.kind", "s.text", "s.rows")
    order = W.partitionBy(*keys).orderBy("p")
    before, upto = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("compact", F.filter(F.transform("rows", compact_row), lambda r: F.size(r) > 0))
    rows = rows.withColumn("heads", period_headers(F.col("compact")))
    rows = rows.withColumn("fitted", F.filter(F.transform("compact", lambda r: fit_row(r, F.col("heads"))), lambda r: r.isNotNull()))
    rows = rows.withColumn("fits", F.col("heads").isNotNull() & (F.size("fitted") > 0))
    rows = rows.withColumn("table", F.when(F.size("compact") > 0, markdown_lines(F.when(F.col("fits"), F.col("heads")), F.when(F.col("fits"), F.col("fitted")).otherwise(F.col("compact")))))
    rows = rows.withColumns(
        {
            "number": F.count("table").over(upto),
            "last": F.last("text", ignorenulls=True).over(before),
            "title": F.left(F.coalesce(F.last(F.when(F.length("text") <= SHORT, F.col("text")), ignorenulls=True).over(before), F.lit("")), F.lit(180)),
        }
    )
    label = table_label(page_class(F.col("title"), F.col("rows")))
    named = F.when((F.col("title") != "") & ~F.col("title").rlike(r"(?i)^table\s+\d+$"), F.concat(F.lit(": "), "title")).otherwise("")
    table = F.concat(F.lit("## "), label, F.lit(" "), F.col("number").cast("string"), named, F.lit("\n\n"), F.col("table"), F.lit("\n"))
    own = (
        F.when(F.col("kind") == "table", F.when(F.col("table").isNotNull(), table))
        .when(F.col("text").eqNullSafe(F.col("last")), None)
        .when(F.col("kind") == "heading", F.when(F.col("text") != F.col("headline"), F.concat(F.lit("## "), "text", F.lit("\n"))))
        .when(F.col("kind") == "list_item", F.concat(F.lit("- "), "text"))
        .otherwise(F.concat("text", F.lit("\n")))
    )
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(own.isNotNull(), F.struct("p", own.alias("x"))))), lambda x: x["x"]), "\n")
    body = rows.groupBy(*keys).agg(lines.alias("body"), F.count_if(F.col("kind") == "table").alias("n_tables")).withColumnsRenamed({k: f"{k}_" for k in keys})
    joined = top.join(body, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]).drop(*[f"{k}_" for k in keys])
    quote = lambda c: F.concat(F.lit('"'), F.replace(squeeze(c), F.lit('"'), F.lit('\\"')), F.lit('"'))
    filled = [F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{k}: "), quote(c.cast("string")))) for k, c in header.items()]
    count = F.concat(F.lit("table_count: "), quote(F.when(F.col("n_tables") > 0, F.col("n_tables").cast("string"))))  # none is written as nothing
    whole = F.concat(F.lit("---\n"), F.array_join(F.array_compact(F.array(*filled, count)), "\n"), F.lit("\n---\n\n# "), F.col("headline"), F.lit("\n\n"), F.col("body"))
    return joined.select(*keys, "headline", "n_tables", F.concat(strip_all(F.regexp_replace(whole, r"\n{3,}", "\n\n")), F.lit("\n")).alias("markdown"))


def filing_releases(filings: DataFrame, requests: DataFrame, documents: DataFrame, pages: DataFrame) -> DataFrame:
    """From filings to documents in one job: the best filing of each request (symbol, fiscal_year, quarter, anchor_date), of its
    documents those worth reading, of their pages the one that reads most like the release, and that page as Markdown.

    (symbol, fiscal_year, quarter, accession, filing_date, name, url, n_read, score, headline, n_tables, markdown). Only documents
    and pages of chosen filings are read on; pages are parsed once.
    """
    best = written(filing_rank(filings, requests), "filings")
    own = documents.join(best.select("accession").distinct(), "accession", "left_semi")
    exhibits, contents = filing_exhibits(own, pages, best.select("accession", "fiscal_year", "quarter").distinct())
    chosen = best.select("symbol", "fiscal_year", "quarter", "accession", "filing_date").join(exhibits.drop("metadata_score", "content_score", "n_chars"), ["accession", "fiscal_year", "quarter"])
    read = chosen.join(contents.select("accession", "name", "sections"), ["accession", "name"], "left")
    period = F.format_string("Q%d FY%d", F.col("quarter").cast("int"), F.col("fiscal_year").cast("int"))
    header = {"symbol": "symbol", "fiscal_year": "fiscal_year", "fiscal_quarter": "quarter", "requested_period": period, "filing_date": "filing_date", "accession_number": "accession", "selected_document": "name", "selected_document_url": "url"}
    keys = ["symbol", "fiscal_year", "quarter"]
    text = filing_markdown(read, {k: F.col(c) if isinstance(c, str) else c for k, c in header.items()}, keys)
    return chosen.join(text, keys)
