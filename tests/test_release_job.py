"""Releases end to end, titles by windows, grids of tables, runs of table-like lines, pages that cannot be read."""

import re
import time

from pyspark.sql import functions as F

from quarterweave.operators import content, releases
from quarterweave.operators.release_pages import release_blocks

FILLER = "word " * 130
RELEASE = "release_id string, url string, text string, is_sec boolean, ticker string, company string, publisher string, site string, release_date date, requested_period string, detected_period string, title string, fiscal_year int"


def made(spark, pages, feed="Feed words"):
    rows = [(k, f"https://x.com/{k}", feed, False, "ACME", None, None, None, None, "Q1 FY2025", None, "Title", 2025) for k in pages]
    df = content.release_content(spark.createDataFrame(rows, RELEASE), spark.createDataFrame([(f"https://x.com/{k}", p) for k, p in pages.items()], "url string, html string"))
    return content.release_markdown(content.release_sections(df))


def sections(spark, pages, **more):
    return {r.release_id: r for r in made(spark, pages, **more).collect()}


def test_titles_come_from_the_last_twelve_lines(spark):
    lines = lambda n: "".join(f"<p>line {k}" for k in range(n))
    table = "<table><tr><td>a<td>1</table>"
    # Lines run on over text blocks and tables; tables without Markdown and blocks of boilerplate count for nothing.
    page = lambda n: f"<article><p>{FILLER}<p>Balance Sheet of Acme{lines(n)}{table}<p>Source here{table}<p>more{table}</article>"
    got = sections(spark, {"a": page(10), "b": page(11), "c": page(12), "d": f"<article>{table}<p>{FILLER}<p>x{table}</article>"})
    titles = {k: [s.title for s in r.sections if s.kind == "table"] for k, r in got.items()}
    assert titles["a"] == ["Balance Sheet of Acme", "Balance Sheet of Acme", "Balance Sheet of Acme"]
    assert titles["b"] == ["Balance Sheet of Acme", "Balance Sheet of Acme", "more"]
    assert titles["c"] == ["line 11", "line 11", "more"]
    assert titles["d"] == ["Table 1", "x"] and [s.number for s in got["d"].sections] == [1, None, 2]


def test_one_sort_serves_titles_and_numbers(spark):
    df = content._block_table(content.release_content(spark.createDataFrame([("a", "https://x.com/a", "t", False)], "release_id string, url string, text string, is_sec boolean"), spark.createDataFrame([("https://x.com/a", FILLER)], "url string, html string")).hint("merge"), ["release_id"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    above = plan.split("MapInArrow")[0]
    assert len(re.findall(r"\bSort\b", above)) == 1 and len(re.findall(r"\bExchange\b", above)) == 1 and above.count("Window ") == 2


def test_heads_are_those_of_the_release_path(spark):
    dated = lambda a, b: f"<table><tr><td></td><td>{a}</td><td>{b}</td></tr><tr><td>Units</td><td>1</td><td>2</td></tr></table>"
    page = f"<article><p>{FILLER}<p>Overview{dated('January 31, 2025', 'April 30, 2024')}<p>Figures{dated('March 31, 2025', 'June 30, 2024')}<p>Media{dated('2025', '2024')}</article>"
    md = sections(spark, {"a": page})["a"].markdown
    assert "|Item|Value 1|Value 2|\n|-|-:|-:|\n|January 31, 2025|April 30, 2024||\n|Units|1|2|" in md
    assert "|Item|March 31, 2025|June 30, 2024|\n|-|-:|-:|\n|Units|1|2|" in md
    assert "## Contact Table 3: Media\n\n|Item|Value 1|Value 2|\n|-|-:|-:|\n|2025|2024||\n|Units|1|2|" in md


def grid(table):
    return [b["rows"] for b in release_blocks(f"<article><p>{FILLER}{table}</article>", "") if b["kind"] == "table"]


def test_grids_hold_spans_blank_columns_and_the_largest_table():
    assert grid("<table><tr><th rowspan=2>Item<th colspan=2>2025<tr><th>Q1<th>Q2<tr><td>Sales<td>1<td>2</table>") == [[["Item", "2025", "2025"], ["Item", "Q1", "Q2"], ["Sales", "1", "2"]]]
    assert grid("<table><tr><td>a<td> <td>1<tr><td><td><td><tr><td>b<td>&nbsp;<td>2</table>") == [[["a", "1"], ["b", "2"]]]
    assert grid("<table><tr><td rowspan=9>a<td>1<tr><td>2</table>") == [[["a", "1"], ["a", "2"]]]  # no further than the table
    assert grid("<table><tr><td colspan=x rowspan=-1>a<td>1</table>") == [[["a", "1"]]]
    nested = "<table><tr><td>lay<table><tr><td>b<td>1<tr><td>c<td>2</table><table><tr><td>d</table></table>"
    assert grid(nested) == [[["b", "1"], ["c", "2"]], [["d"]]]  # the layout gives way, none comes twice
    assert grid("<table></table>") == [[]]


def test_pages_of_any_depth_are_read():
    deep = "<div>" * 5000 + "<b>" * 20_000 + "at the end" + "</div>" * 5000
    began = time.time()
    blocks = release_blocks(f"<article><p>{FILLER}</p>{deep}<ul>{'<li>x' * 5000}</ul></article>", "")
    assert blocks[0]["text"].split("\n")[1] == "at the end" and blocks[0]["text"].count("x") == 5000 and time.time() - began < 20


def test_a_page_that_cannot_be_read_gives_way_to_the_feed(spark):
    bad = "<article><p>" + FILLER + "<![bad[</article>"
    got = sections(spark, {"a": bad})["a"]
    assert (got.content_source, got.content_error, got.raw_format) == ("press_release_text", None, "txt") and "Feed words" in got.markdown and got.page_error
    got = sections(spark, {"a": bad}, feed=" ")["a"]
    assert got.content_error.startswith("page_not_readable") and got.markdown is None and got.content_source is None


def test_runs_of_lines_take_time_by_the_line(spark):
    lines = [f"Revenue {k} 1,000" if k // 7 % 2 else f"plain words {'abcdefg'[k % 7]}" for k in range(100_000)]
    df = spark.createDataFrame([("\n".join(lines),), (None,), ("",), ("Revenue 1,000",)], "text string")
    began = time.time()
    got = [[(b.kind, b.text) for b in r.b] for r in df.select(content.text_table_blocks(F.col("text")).alias("b")).collect()]
    assert time.time() - began < 20
    want, run = [], []
    for k, line in enumerate([*lines, None]):
        if run and (line is None or (k // 7 % 2) != (k - 1) // 7 % 2):
            want.append(("table_text" if (k - 1) // 7 % 2 else "text", "\n".join(run)))
            run = []
        run.append(line)
    assert got == [want, [], [], [("table_text", "Revenue 1,000")]]


FEED = "ticker string, row_ord long, title string, url string, text string, published_date string"


def test_one_job_from_the_feed_to_documents(spark):
    page = f"<article><h1>Acme reports first quarter results</h1><p>{FILLER}<h2>Balance Sheet</h2><table><tr><td><td>2025<td>2024<tr><td>Cash<td>1<td>2</table></article>"
    feed = [
        ("ACME", 0, "Acme reports first quarter 2025 results", "https://x.com/1", "feed one", "2025-05-01"), ("ACME", 1, "Acme announces second quarter fiscal 2025 financial results", "https://x.com/2", "feed two", "2025-08-01"),
        ("ACME", 2, "Lawsuit filed", "https://x.com/3", "no", "2025-05-01"), ("B", 0, "B reports first quarter 2025 results", None, "no address", None), ("C", 0, "C reports first quarter 2025 results", "https://x.com/4", " ", None),
    ]
    fields = releases.release_fields(spark.createDataFrame(feed, FEED))
    requests = spark.createDataFrame([(t, 2025, q) for t in ("ACME", "B", "C", "D") for q in (1, 2)], "ticker string, fiscal_year int, quarter int")
    pages = spark.createDataFrame([("https://x.com/1", page), ("https://x.com/2", "short"), ("https://x.com/3", page), ("https://x.com/9", page)], "url string, html string")
    out = content.release_documents(fields, requests, pages)
    got = {(r.ticker, r.quarter): r for r in out.collect()}
    assert set(got) == {("ACME", 1), ("ACME", 2), ("C", 1)}
    one, two, bare = got["ACME", 1], got["ACME", 2], got["C", 1]
    assert one.counts.financial == 1 and 'period_requested: "Q1 FY2025"\nperiod_detected: "Q1 FY2025"' in one.markdown and one.release_id == "acme_20250501_acme_reports_first_quarter_2025_results"
    assert two.content_source == "press_release_text" and two.markdown.endswith("feed two\n") and bare.content_error == "no_usable_content"
    assert content.release_documents(fields.limit(0), requests, pages).count() == 0
    # Pages meet the winners' addresses before anything moves them.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    below = plan.split("MapInArrow")[1]
    assert below.count("LeftSemi") >= 2
