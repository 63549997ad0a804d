"""Tables of pages: titles, classes, compact rows, Markdown and counts, as column expressions without a shuffle.

A table is an array of rows of cells. Null cells count as empty; a table of which no cell is left has no Markdown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P

_EMPTY = "array()"


def _strings() -> Column:
    return F.expr(_EMPTY).cast("array<string>")


def cell_text(c: Column) -> Column:
    text = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.lower(text).isin("nan", "none", "null", "nat"), "").otherwise(text)


def _no_repeats(cells: Column) -> Column:
    return F.filter(cells, lambda x, i: (i == 0) | (F.lower(x) != F.lower(F.get(cells, i - 1))))


def _join_currency(cells: Column) -> Column:
    """A cell that is a currency sign alone goes before the next one."""
    start = F.struct(_strings().alias("done"), F.lit("").alias("sign"))

    def step(s: Column, x: Column) -> Column:
        alone = (s["sign"] == "") & x.isin(*P.CURRENCY)
        return F.struct(F.when(alone, s["done"]).otherwise(F.concat(s["done"], F.array(F.concat(s["sign"], x)))).alias("done"), F.when(alone, x).otherwise("").alias("sign"))

    return F.aggregate(cells, start, step, lambda s: F.when(s["sign"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["sign"]))))


def compact_row(row: Column) -> Column:
    cells = F.filter(F.transform(row, cell_text), lambda x: x != "")
    return _no_repeats(_join_currency(_no_repeats(cells)))


def _is_year(c: Column) -> Column:
    return c.rlike(r"^(19|20)[0-9]{2}$")


def _is_period(c: Column, labels: list[str]) -> Column:
    return F.lower(c).rlike("|".join(labels))


def period_headers(rows: Column, dates: str = P.LONG_DATE) -> Column:
    """Years, else dates, of the first of eight rows that holds two or more; null if none does."""
    early = F.slice(rows, 1, 8)
    first = lambda test: F.get(F.filter(F.transform(early, lambda r: F.filter(r, test)), lambda r: F.size(r) > 1), F.lit(0))
    return F.coalesce(first(_is_year), first(lambda c: c.rlike(dates)))


def fit_row(row: Column, headers: Column, labels: list[str] = P.PERIOD_LABELS) -> Column:
    """A label and one value for each header; null for rows that only repeat the headers. Without headers, the row."""
    n = F.size(headers)
    label, values = F.get(row, F.lit(0)), F.slice(row, F.lit(2), F.greatest(F.size(row) - 1, F.lit(0)))
    section = ((F.size(row) == 1) & label.endswith(":")) | F.lower(label).isin(*P.SECTION_LABELS)
    blanks = lambda k: F.array_repeat(F.lit(""), k.cast("int"))
    overflow = F.concat(F.slice(values, F.lit(1), n - 1), F.array(F.array_join(F.slice(values, n, F.greatest(F.size(values), F.lit(1))), " ")))
    fitted = F.when(F.size(values) > n, overflow).otherwise(F.concat(values, blanks(F.greatest(n - F.size(values), F.lit(0)))))
    gone = F.forall(row, _is_year) | ((F.size(row) == 1) & _is_period(label, labels))
    repeats = (F.size(row) <= n) & F.forall(row, lambda c: _is_year(c) | _is_period(c, labels))
    return F.when(gone, None).when(headers.isNull(), row).when(section, F.concat(F.array(label), blanks(n))).when(repeats, None).otherwise(F.concat(F.array(label), fitted))


def page_class(title: Column, rows: Column) -> Column:
    """Class of a page's table, by its title and first eight rows."""
    text = F.lower(F.concat_ws(" ", title, F.flatten(F.slice(rows, 1, 8))))
    has = lambda words: text.rlike("|".join(words))
    return F.when(has(P.NON_GAAP), "non_gaap").when(has(P.STATEMENTS), "financial").when(has(P.CONTACTS), "contact").otherwise("other")


def table_label(kind: Column) -> Column:
    return F.when(kind == "non_gaap", "Non-GAAP Table").when(kind == "financial", "Financial Table").when(kind == "contact", "Contact Table").otherwise("Table")


def page_tables(parsed: DataFrame, key: str = "page_id", outer: bool = False) -> DataFrame:
    """(key, table_no, row_count, column_count, title, class, rows, headers, body) for every table of `parse_pages`.

    The title is the last text of 220 characters at most before the table, headings alike. `body` holds the compact
    rows, fitted to `headers` where there are any. With `outer`, pages without tables give a row with table_no null.
    """
    own = F.filter("sections", lambda s: s["kind"] == "table")
    before = lambda t: F.filter("sections", lambda s: (s["kind"] != "table") & (s["pos"] < t["pos"]) & (F.length(s["text"]) <= 220))
    title = lambda t: F.get(F.transform(before(t), lambda s: s["text"]), F.size(before(t)) - 1)
    each = F.transform(own, lambda t, i: F.struct((i + 1).alias("table_no"), F.left(F.coalesce(title(t), F.lit("")), F.lit(180)).alias("title"), t["rows"].alias("rows")))
    out = parsed.select(key, (F.inline_outer if outer else F.inline)(each))
    out = out.withColumn("_c", F.filter(F.transform("rows", compact_row), lambda r: F.size(r) > 0))
    out = out.withColumn("_h", period_headers(F.col("_c")))
    out = out.withColumn("_b", F.filter(F.transform("_c", lambda r: fit_row(r, F.col("_h"))), lambda r: r.isNotNull()))
    fits = F.col("_h").isNotNull() & (F.size("_b") > 0)
    return out.select(
        key,
        "table_no",
        F.size("rows").alias("row_count"),
        F.array_max(F.transform("rows", F.size)).alias("column_count"),
        "title",
        page_class(F.col("title"), F.col("rows")).alias("class"),
        "rows",
        F.when(fits, F.col("_h")).alias("headers"),
        F.when(fits, F.col("_b")).otherwise(F.col("_c")).alias("body"),
    )


def table_rows(tables: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, table_no, row_no, cells) for every row that is left."""
    return tables.select(key, "table_no", F.posexplode("body").alias("row_no", "cells")).withColumn("row_no", F.col("row_no") + 1)


def _line(cells: Column) -> Column:
    return F.concat(F.lit("|"), F.array_join(F.transform(cells, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), "|"), F.lit("|"))


def markdown_lines(headers: Column, body: Column) -> Column:
    """`Item`, the headers or `Value 1` and so on, a rule, then the rows, padded."""
    heads = F.concat(F.array(F.lit("Item")), F.coalesce(headers, _strings()))
    width = F.greatest(F.size(heads), F.array_max(F.transform(body, F.size)))
    # Built from a sequence of column numbers, so that a table without more columns adds none.
    names = F.transform(F.sequence(F.lit(0), width - 1), lambda k: F.when(k < F.size(heads), F.get(heads, k)).otherwise(F.concat(F.lit("Value "), k.cast("string"))))
    rule = F.transform(F.sequence(F.lit(0), width - 1), lambda k: F.when(k == 0, "-").otherwise("-:"))
    rows = F.transform(body, lambda r: _line(F.concat(r, F.array_repeat(F.lit(""), (width - F.size(r)).cast("int")))))
    return F.array_join(F.concat(F.array(_line(names), _line(rule)), rows), "\n")


def table_markdown(tables: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, table_no, heading, markdown) for every table with rows left."""
    label = table_label(F.col("class"))
    named = (F.col("title") != "") & ~F.col("title").rlike(r"(?i)^table\s+\d+$")
    heading = F.concat(F.lit("## "), label, F.lit(" "), F.col("table_no").cast("string"), F.when(named, F.concat(F.lit(": "), "title")).otherwise(""))
    return tables.where(F.size("body") > 0).select(key, "table_no", heading.alias("heading"), markdown_lines(F.col("headers"), F.col("body")).alias("markdown"))


def table_counts(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, total, financial, non_gaap, contact, other), pages without tables included; tasks combine before the shuffle."""
    kinds = ["financial", "non_gaap", "contact", "other"]
    each = page_tables(parsed, key, outer=True).groupBy(key)
    return each.agg(F.count("table_no").alias("total"), *[F.count_if(F.col("table_no").isNotNull() & (F.col("class") == k)).alias(k) for k in kinds])
