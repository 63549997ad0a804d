"""Releases as documents: content of page or feed, sections in order, Markdown and manifest.

Pages are joined to the releases that need them. Blocks of a page are rows while titles and numbers are found, all by one sort;
then each release is one row again, its sections an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import patterns as P
from ..functions.text import EMAIL, LINE_END, SPACE, bound, clean_text, headline, holds, holds_any, is_html, lines, size_estimate, squeeze, strip_all
from ..sources.staging import written
from .release_pages import with_blocks
from .releases import release_best, release_candidates, release_contenders, release_scores
from .tables import compact_row, fit_row, markdown_lines, period_headers

#: Characters of a page at least, lines that may name a table, characters of a title.
LEAST_PAGE, CONTEXT, TITLE = 300, 12, 180


def release_content(releases: DataFrame, pages: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """`releases` (release_id, url, text, is_sec, ...) with html, raw_content, content_source, raw_format and content_error.

    A page of fewer than `LEAST_PAGE` characters counts as not read, one of a regulator is not taken; then the feed's
    text stands in. `pages` (url, html) holds one row for a url. `urls` (url), if given, are all that `releases` ask for:
    other pages go before any page is moved.
    """
    if urls is not None:
        pages = pages.join(urls, "url", "left_semi")
    # What is known of a page goes beside it, so that where its text is not asked for it is not moved.
    own = pages.where(F.length("html") >= LEAST_PAGE).select(F.col("url").alias("url_"), F.col("html").alias("html_"), F.when(is_html(F.col("html")), "html").otherwise("txt").alias("format_"))
    joined = releases.join(own, (F.col("url") == F.col("url_")) & ~F.col("is_sec"), "left").drop("url_")
    # A column of its own, so that a text is cleaned once for all that asks for it, and not at all where a page stands for it.
    joined = joined.withColumn("_feed", F.when(F.col("url").isNotNull() & ~F.coalesce("is_sec", F.lit(False)) & F.col("format_").isNull(), clean_text(F.col("text"))))
    source = F.when(F.col("url").isNull() | F.col("is_sec"), None).when(F.col("format_").isNotNull(), "scraped_public_url_html").when(F.col("_feed") != "", "press_release_text")
    error = F.when(F.col("url").isNull(), "no_url").when(F.col("is_sec"), "regulator_url_refused").when(source.isNull(), "no_usable_content")
    joined = joined.withColumn("content_source", source).withColumn("content_error", error)
    read, told = F.col("content_source") == "scraped_public_url_html", F.col("content_source").isNotNull()
    page = F.when(read, F.col("html_"))
    feed_format = F.when(is_html(F.col("_feed")), "html").otherwise("txt")
    return joined.withColumns(
        {
            "html": page,
            "raw_content": F.when(read, F.col("html_")).when(told, F.col("_feed")),
            "raw_format": F.when(read, F.col("format_")).when(told, feed_format),
        }
    ).drop("html_", "format_", "_feed")


def looks_like_table(line: Column) -> Column:
    words = bound(F.lower(line), lambda low: holds(line, low, P.TABLE_WORDS, P.TABLE_WORD_LIST))
    return line.rlike(P.TABLE_SIGNS) & line.rlike(P.TABLE_NUMBERS) & (line.rlike(P.TABLE_SPACING) | words) & line.rlike(f"[^{SPACE}]")


def text_table_blocks(text: Column) -> Column:
    """Runs of lines that look like rows of a table, and of those that do not, as (kind, text); empty ones dropped.

    The places where a run begins are found first, then each run is one slice: time grows with the lines."""

    def runs(own: Column, like: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda k: (k == 0) | (F.get(like, k) != F.get(like, k - 1)))
        end = lambda at, k: F.coalesce(F.get(at, k + 1), F.size(own))
        each = lambda at: F.transform(at, lambda a, k: F.struct(F.when(F.get(like, a), "table_text").otherwise("text").alias("kind"), F.array_join(F.slice(own, a + 1, end(at, k) - a), "\n").alias("text")))
        return bound(starts, each)

    split = F.split(F.coalesce(text, F.lit("")), LINE_END)
    found = bound(split, lambda own: bound(F.transform(own, looks_like_table), lambda like: runs(own, like)))
    tidy = F.transform(found, lambda b: F.struct(b["kind"].alias("kind"), F.when(b["kind"] == "text", clean_text(b["text"])).otherwise(strip_all(b["text"])).alias("text")))
    return F.filter(tidy, lambda b: b["text"] != "")


def without_boilerplate(text: Column) -> Column:
    gone = lambda x: (x == "") | bound(F.lower(x), lambda low: low.isin(P.BOILERPLATE) | low.startswith(P.BOILERPLATE_STARTS[0]) | low.startswith(P.BOILERPLATE_STARTS[1]))
    return clean_text(F.array_join(F.filter(lines(clean_text(text)), lambda x: ~gone(x)), "\n"))


def table_class(title: Column, rows: Column) -> Column:
    """Class of a release's table, by its title, its first 14 rows and the signals among all rows."""
    text = lambda r: F.lower(F.array_join(F.flatten(r), " "))
    low, whole = F.lower(title), text(rows)
    both = F.concat(low, F.lit(" "), text(F.slice(rows, 1, 14)))
    has = lambda c, words: c.rlike("|".join(words))
    signals = F.size(F.filter(F.array(*map(F.lit, P.ROW_SIGNALS)), lambda s: F.contains(whole, s)))
    return (
        F.when(has(both, P.RELEASE_NON_GAAP), "non_gaap")
        .when(has(low, P.RELEASE_STATEMENTS) | (signals >= 3), "financial")
        .when(has(both, P.CONTACTS) | whole.rlike(EMAIL), "contact")
        .when((signals >= 1) & ~has(both, P.ADJUSTED), "financial")
        .otherwise("other")
    )


_SECTION = "struct<pos: int, kind: string, text: string, title: string, class: string, markdown: string, number: int>"


def _block_table(content: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, page_error, blocks) of releases that have a page: sections with title, class and Markdown, in order.

    Blocks are rows in the order of the page. Running counts and the last lines so far share one sort by release and place."""
    parsed = with_blocks(content.where(F.col("html").isNotNull()), keys)
    parsed = parsed.withColumn("tabled", F.exists("blocks", lambda b: b["kind"] == "table"))
    rows = parsed.select(*keys, "page_error", "tabled", F.posexplode_outer("blocks").alias("pos", "b")).select(*keys, "page_error", "tabled", "pos", "b.kind", "b.text", "b.rows")
    rows = rows.withColumn("text", F.when(F.col("kind") == "text", without_boilerplate(F.col("text"))))
    own = rows.withColumn("own", F.filter(lines(F.col("text")), lambda x: x != ""))
    words = P.RELEASE_STATEMENTS + P.RELEASE_NON_GAAP + P.CONTACTS
    # Lines are sought for tables alone, and none but the last `CONTEXT` of a text can be near one.
    skipped = F.greatest(F.size("own") - CONTEXT, F.lit(0))
    tail = F.transform(F.slice("own", skipped + 1, F.lit(CONTEXT)), lambda x, i: F.struct((i + skipped).alias("at"), x.alias("line")))
    own = own.withColumn("names", F.when(F.col("tabled"), F.filter(tail, lambda x: bound(F.lower(x["line"]), lambda low: holds_any(low, words)))))
    own = own.select(*keys, "page_error", "pos", "kind", "text", "rows", F.size("own").alias("n"), F.get("own", F.size("own") - 1).alias("last"), F.get("names", F.size("names") - 1).alias("name"))
    order = W.partitionBy(*keys).orderBy("pos")
    before, upto = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.unboundedPreceding, W.currentRow)
    own = own.withColumn("so_far", F.coalesce(F.sum(F.when(F.col("kind") == "text", F.col("n"))).over(before), F.lit(0)))
    own = own.withColumn("name", F.when(F.col("name").isNotNull(), F.struct((F.col("so_far") + F.col("name.at") + 1).alias("no"), F.col("name.line").alias("line"))))
    own = own.withColumns(
        {
            "number": F.count(F.when(F.col("kind") == "table", 1)).over(upto),
            "line_before": F.last("last", ignorenulls=True).over(before),
            "name_before": F.last("name", ignorenulls=True).over(before),
        }
    )
    near = F.when(F.col("name_before.no") > F.col("so_far") - CONTEXT, F.col("name_before.line"))
    is_table = F.col("kind") == "table"
    out = own.withColumn("title", F.when(is_table, F.left(F.coalesce(near, "line_before", F.concat(F.lit("Table "), F.col("number").cast("string"))), F.lit(TITLE))))
    out = out.withColumn("class", F.when(is_table, table_class(F.col("title"), F.col("rows"))))
    out = out.withColumn("compact", F.filter(F.transform("rows", compact_row), lambda r: F.size(r) > 0))
    out = out.withColumn("heads", F.when(F.col("class") != "contact", period_headers(F.col("compact"), P.RELEASE_LONG_DATE)))
    out = out.withColumn("fitted", F.filter(F.transform("compact", lambda r: fit_row(r, F.col("heads"), P.RELEASE_PERIOD_LABELS)), lambda r: r.isNotNull()))
    out = out.withColumn("fits", F.col("heads").isNotNull() & (F.size("fitted") > 0))
    out = out.withColumn("body", F.when(F.col("fits"), F.col("fitted")).otherwise(F.col("compact")))
    out = out.withColumn("markdown", F.when(F.size("compact") > 0, markdown_lines(F.when(F.col("fits"), F.col("heads")), F.col("body"))))
    section = F.struct("pos", "kind", "text", "title", "class", "markdown", F.lit(None).cast("int").alias("number"))
    kept = F.when(F.col("markdown").isNotNull() | (F.col("text") != ""), section)
    return out.groupBy(*keys).agg(F.first("page_error").alias("page_error"), F.array_sort(F.collect_list(kept)).alias("blocks"))


def _first_of_equals(sections: Column) -> Column:
    """Of texts that are equal, white space and case aside, the first; tables numbered in order."""
    keyed = F.transform(F.filter(sections, lambda s: s["kind"] == "text"), lambda s: F.struct(F.lower(squeeze(s["text"])).alias("k"), s["pos"].alias("pos"), s.alias("s")))
    texts = bound(F.array_sort(keyed), lambda z: F.transform(F.filter(z, lambda x, i: (i == 0) | (F.get(z, i - 1)["k"] != x["k"])), lambda x: x["s"]))
    tables = F.transform(F.filter(sections, lambda s: s["kind"] != "text"), lambda s, i: s.withField("number", (i + 1).cast("int")))
    return F.array_sort(F.concat(texts.cast(f"array<{_SECTION}>"), tables.cast(f"array<{_SECTION}>")))


def release_sections(content: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """`content` with sections: array of (pos; kind text, table or table_text; text; title; class; markdown; number among the
    tables), in order. `keys` (release_id, if none are named) tell releases apart and are never null.

    A table's title is, of the last 12 lines before it, the last that names one, else the last. Pages without a table that
    has Markdown, and feed texts, are searched for tables in plain text. Of equal texts, white space and case aside, the
    first stays. A page that cannot be read gives way to the feed's text, and without one to an error, as a page too short.
    """
    keys = keys or ["release_id"]
    blocks = _block_table(content, keys).withColumnsRenamed({k: f"{k}_" for k in keys})
    same = [F.col(k) == F.col(f"{k}_") for k in keys]
    # Named before the join, which moves pages only where they are asked for.
    own = content.withColumns({"_page": F.col("html").isNotNull(), "_own": F.when(F.col("html").isNull(), F.col("raw_content"))})
    out = own.join(blocks, same, "left").drop(*[f"{k}_" for k in keys])
    unread = F.col("page_error").isNotNull()
    feed = F.when(unread, F.nullif(clean_text(F.col("text")), F.lit("")))
    out = out.withColumn("_feed", feed)
    out = out.withColumns(
        {
            "content_error": F.when(unread & F.col("_feed").isNull(), F.concat(F.lit("page_not_readable: "), F.col("page_error"))).otherwise(F.col("content_error")),
            "content_source": F.when(unread, F.when(F.col("_feed").isNotNull(), "press_release_text")).otherwise(F.col("content_source")),
            "raw_content": F.when(unread, F.col("_feed")).otherwise(F.col("raw_content")),
            "raw_format": F.when(unread, F.when(F.col("_feed").isNotNull(), F.when(is_html(F.col("_feed")), "html").otherwise("txt"))).otherwise(F.col("raw_format")),
            "html": F.when(~unread, F.col("html")),
            "_own": F.when(unread, F.col("_feed")).otherwise(F.col("_own")),
        }
    )
    has_table = F.coalesce(F.exists("blocks", lambda s: s["kind"] == "table"), F.lit(False))
    plain = F.when(F.col("_page") & ~unread, narrative_text(F.col("blocks"))).otherwise(F.col("_own"))
    out = out.withColumn("_plain", F.when(F.col("content_source").isNotNull() & ~has_table, text_table_blocks(plain)))
    table_text, none = lambda x: x["kind"] == "table_text", F.lit(None).cast("string")
    found = F.transform("_plain", lambda x, i: F.struct(i.cast("int").alias("pos"), x["kind"].alias("kind"), x["text"].alias("text"), F.when(table_text(x), "Text-formatted table").alias("title"), F.when(table_text(x), "other").alias("class"), none.alias("markdown"), F.lit(None).cast("int").alias("number")))
    out = out.withColumn("_s", F.when(F.size("_plain") > 0, found).otherwise(F.col("blocks")))
    return out.withColumn("sections", F.when(F.col("content_source").isNotNull(), _first_of_equals(F.col("_s")))).drop("_s", "_plain", "_feed", "_own", "_page", "blocks")


def narrative_text(sections: Column) -> Column:
    return clean_text(F.array_join(F.transform(F.filter(sections, lambda s: s["kind"] == "text"), lambda s: s["text"]), "\n\n"))


def section_counts(sections: Column) -> Column:
    of = lambda test: F.size(F.filter(sections, test)).cast("long")
    tables = lambda k: of(lambda s: (s["kind"] == "table") & (s["class"] == k))
    html = {k: tables(k) for k in ("financial", "non_gaap", "contact", "other")}
    text = of(lambda s: s["kind"] == "table_text")
    return F.struct(*[c.alias(k) for k, c in html.items()], text.alias("text_tables"), (sum(html.values(), F.lit(0)) + text).alias("total"))


def _yaml(name: str, value: Column) -> Column:
    quoted = F.concat(F.lit(f'{name}: "'), F.replace(squeeze(value), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(F.coalesce(value, F.lit("")) != "", quoted)


def release_markdown(sectioned: DataFrame) -> DataFrame:
    """`sectioned` with headline, counts and markdown: a header of what is known, the headline, then sections with their
    tables numbered. Uses the columns ticker, company, publisher, site, release_date, requested_period, detected_period, title, url."""
    out = sectioned.withColumn("headline", F.coalesce(headline(narrative_text(F.col("sections"))), F.col("title"))).withColumn("counts", section_counts(F.col("sections")))
    top = F.coalesce(F.nullif("headline", F.lit("")), F.nullif("title", F.lit("")), F.lit("Earnings Release"))
    text = {
        "id": F.col("release_id"), "ticker": F.col("ticker"), "company": F.col("company"), "source": F.lit("Press release feed + public page"), "publisher": F.col("publisher"), "site": F.col("site"),
        "release_date": F.col("release_date").cast("string"), "period_requested": F.col("requested_period"), "period_detected": F.col("detected_period"), "headline": top, "title": F.col("title"), "url": F.col("url"),
    }
    numbers = {"tables_financial": "financial", "tables_non_gaap": "non_gaap", "tables_contact": "contact", "tables_other": "other", "tables_text": "text_tables"}
    header = F.array_compact(F.array(*[_yaml(k, v) for k, v in text.items()], *[F.concat(F.lit(f"{k}: "), F.col(f"counts.{c}").cast("string")) for k, c in numbers.items()]))
    label = lambda s: F.when(s["class"] == "financial", "Financial Table").when(s["class"] == "non_gaap", "Non-GAAP Table").when(s["class"] == "contact", "Contact Table").otherwise("Table")

    def part(s: Column, i: Column) -> Column:
        number = s["number"].cast("string")
        title = clean_text(s["title"])
        named = F.when((title != "") & ~title.rlike(r"(?i)^table\s+\d+$"), F.concat(F.lit(": "), title)).otherwise("")
        before = F.get("sections", i - 1)
        again = (i > 0) & (before["kind"] == "text") & (F.lower(squeeze(before["text"])) == F.lower(squeeze(s["text"])))
        table = F.concat(F.lit("## "), label(s), F.lit(" "), number, named, F.lit("\n\n"), clean_text(s["markdown"]))
        block = F.concat(F.lit("## Table "), number, F.lit(": "), title, F.lit("\n\n```text\n"), strip_all(s["text"]), F.lit("\n```"))
        return F.when(s["kind"] == "text", F.when(~again, clean_text(s["text"]))).when(s["kind"] == "table", table).otherwise(block)

    parts = F.array_compact(F.transform("sections", part))
    whole = F.concat(F.lit("---\n"), F.array_join(header, "\n"), F.lit("\n---\n\n# "), top, F.lit("\n\n"), F.array_join(parts, "\n\n"))
    return out.withColumn("markdown", F.when(F.col("content_source").isNotNull(), F.concat(strip_all(whole), F.lit("\n"))))


def release_documents(fields: DataFrame, requests: DataFrame, pages: DataFrame) -> DataFrame:
    """The document of the best release of each request (ticker, fiscal_year, quarter), from `release_fields` to Markdown.

    Candidates are scored and ranked by keys and flags alone. The winners' keys are written, and only the texts and pages that
    they name are read on, each page parsed once, however many requests chose its release. A row per answered request;
    `fields` (ticker, row_ord) tell releases apart; `pages` (url, html) holds one row for a url.
    """
    best = release_best(release_candidates(release_scores(release_contenders(fields, requests, 1), requests), 1))
    best = written(best.select("ticker", "row_ord", "fiscal_year", "quarter", "score", "url"), "winners")
    keys = ["ticker", "row_ord"]
    chosen = fields.join(best.select(*keys).distinct(), keys, "left_semi")
    urls = best.select("url").distinct()
    content = release_content(chosen.withColumn("site", F.col("domain")), pages, urls)
    sectioned = release_sections(content, keys).drop("html")
    asked = best.select(*keys, "fiscal_year", "quarter", "score", F.format_string("Q%d FY%d", F.col("quarter").cast("int"), F.col("fiscal_year").cast("int")).alias("requested_period"))
    return release_markdown(sectioned.join(asked, keys))


def release_manifest(documents: DataFrame, created_at: str) -> DataFrame:
    """One row per release: what it is, table counts, sizes and where its copies lie, relative to the sinks' folders."""
    return documents.where(F.col("content_source").isNotNull()).select(  # not by the document: a filter is pushed below what computes it
        F.col("release_id").alias("id"),
        "ticker",
        "company",
        F.coalesce("requested_period", "detected_period").alias("period"),
        F.col("release_date").cast("string").alias("release_date"),
        "headline",
        "title",
        F.lit("Press release feed + public page").alias("source"),
        "publisher",
        "site",
        "url",
        F.col("counts").alias("table_counts"),
        F.concat(F.lit("markdown/"), "release_id").alias("llm_markdown_path"),
        F.concat(F.lit("raw/raw_format="), "raw_format", F.lit("/"), "release_id").alias("raw_path"),
        F.struct(size_estimate(F.col("markdown")).alias("llm_markdown")).alias("size_estimates"),
        F.lit(created_at).alias("created_at_utc"),
    )


