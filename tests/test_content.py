import json

import pytest

from quarterweave.operators import content, filings, periods, releases
from quarterweave.operators.release_pages import release_blocks
from quarterweave.sources import readers, sinks

RELEASE = "release_id string, url string, text string, is_sec boolean, ticker string, company string, publisher string, site string, release_date date, requested_period string, detected_period string, title string, fiscal_year int"


def release(i, url, text, sec=False):
    return (i, url, text, sec, "ACME", "Acme", None, None, None, "Q1 FY2025", None, "Title", 2025)


def documents(spark, rows, pages):
    table = spark.createDataFrame(rows, RELEASE)
    made = content.release_content(table, spark.createDataFrame(pages, "url string, html string"))
    return content.release_markdown(content.release_sections(made))


FILLER = "word " * 130
TABLE = "<table><tr><th></th><th>2025</th><th>2024</th></tr><tr><td>Total assets<td>$<td>5<td>$<td>6</table>"


def test_the_publishers_container_wins_and_noise_goes():
    page = f"<html><body><header>top</header><article><p>{FILLER}</article><section class='x release-body'><h1>Head</h1><p>{FILLER}<p aria-hidden='true'>no</p>{TABLE}<p>after<ul><li>one<li>two</ul></section><nav>n</nav></body></html>"
    blocks = release_blocks(page, "https://www.prnewswire.com/a")
    assert [b["kind"] for b in blocks] == ["text", "table", "text"]
    assert blocks[0]["text"] == f"Head\n{FILLER.strip()}" and blocks[2]["text"] == "after\none\ntwo"
    assert blocks[1]["rows"] == [["", "2025", "2024", "", ""], ["Total assets", "$", "5", "$", "6"]]
    assert release_blocks(page, "https://other.com/a")[0]["text"] == FILLER.strip()  # there the article is tried first
    assert release_blocks("<article>short</article><p>rest", "")[0]["text"] == "short\nrest" and release_blocks("", "") == []


def test_sections_titles_classes_and_markdown(spark):
    page = f"<article><p>Acme announces first quarter earnings<p>{FILLER}<p>Source Acme<h2>Consolidated Balance Sheets</h2><p>(in millions)</p>{TABLE}<p>tail<table><tr><td>Mail<td>a@b.com</table><p>tail</article>"
    feed = "Intro\nRevenue 1,000 2,000\nCash 3.5 4.5\nOutro"
    rows = [release("a", "https://x.com/a", ""), release("b", "https://x.com/b", feed), release("c", None, feed), release("d", "https://www.sec.gov/d", feed, True), release("e", "https://x.com/e", None)]
    got = {r.release_id: r for r in documents(spark, rows, [("https://x.com/a", page), ("https://x.com/b", "too short")]).collect()}
    assert [(s.kind, s.title, s["class"]) for s in got["a"].sections] == [("text", None, None), ("table", "Consolidated Balance Sheets", "financial"), ("text", None, None), ("table", "Consolidated Balance Sheets", "financial")]
    assert got["a"].headline == "Acme announces first quarter earnings" and got["a"].counts.total == 2 and "Source Acme" not in got["a"].markdown
    assert "## Financial Table 1: Consolidated Balance Sheets\n\n|Item|2025|2024|\n|-|-:|-:|\n|Total assets|$5|$6|\n" in got["a"].markdown
    assert got["a"].markdown.startswith('---\nid: "a"\nticker: "ACME"\ncompany: "Acme"\n') and got["a"].markdown.count("tail") == 1
    assert [s.kind for s in got["b"].sections] == ["text", "table_text", "text"] and got["b"].counts.text_tables == 1 and got["b"].raw_format == "txt"
    assert [got[k].content_error for k in "abcde"] == [None, None, "no_url", "regulator_url_refused", "no_usable_content"]
    assert got["c"].markdown is None and not got["c"].sections


def test_sinks_write_what_readers_find(spark, tmp_path):
    docs = documents(spark, [release("a", "https://x.com/a", "Some text"), release("b", None, "")], [("https://x.com/z", "")])
    path = f"file://{tmp_path}"
    sinks.write_markdown(docs, path), sinks.write_raw(docs, path)
    counts = sinks.write_routed(docs.select("release_id", "content_error"), f"{path}/split")
    sinks.write_manifest(content.release_manifest(docs, "now"), path)
    assert [(r.release_id, r.fiscal_year) for r in spark.read.parquet(f"{path}/markdown").collect()] == [("a", 2025)]
    assert spark.read.parquet(f"{path}/raw").first().raw_format == "txt" and spark.read.parquet(f"{path}/split/status=quarantine").first().release_id == "b" and counts == {"ok": 1, "quarantine": 1}
    manifest = spark.read.json(f"{path}/manifest").first()
    assert (manifest.id, manifest.table_counts.total, manifest.size_estimates.llm_markdown.words > 5) == ("a", 0, True)


def test_payloads_of_any_envelope(spark):
    items = [{"title": "One", "url": "", "link": "https://x.com/1", "publishedDate": "soon", "acceptedDate": "2025-01-02 10:00"}, "no", {"headline": "Two", "sourceUrl": "https://x.com/2", "summary": "s"}]
    bad = ["", None, "nonsense", "[1, 2]", "{}"]
    rows = [("A", json.dumps(items)), ("B", json.dumps({"data": items})), ("C", json.dumps({"results": items[:1]}))] + [(f"X{k}", p) for k, p in enumerate(bad)]
    feeds = spark.createDataFrame(rows, "ticker string, payload string")
    found = readers.press_releases(feeds)
    got = sorted((r.ticker, r.title, r.url, str(r.release_date), r.text) for r in releases.release_fields(found).collect())
    two = [("One", "https://x.com/1", "2025-01-02", ""), ("Two", "https://x.com/2", "None", "s")]
    assert got == [("A", *two[0]), ("A", *two[1]), ("B", *two[0]), ("B", *two[1]), ("C", *two[0])]
    errors = {r.ticker: r.error for r in readers.payload_errors(feeds, ["ticker"], envelopes=readers.ENVELOPES).collect()}
    assert errors == {"X0": "empty_payload", "X1": "empty_payload", "X2": "payload_not_readable", "X4": "payload_not_readable"}
    one = spark.createDataFrame([("A", '{"date": "2025-02-01", "quarter": 1, "year": 2025}')], "symbol string, payload string")
    assert [(r.year, r.quarter, r.call_date) for r in readers.transcript_dates(one).collect()] == [("2025", "1", "2025-02-01")]
    table = spark.createDataFrame([("A", "ratios", "quarter", '[{"calendarYear": "2025", "period": "Q1", "roe": 0.5, "name": "x"}]')], "symbol string, table_name string, freq string, payload string")
    assert [(r.fiscal_year, r.period, r.measures) for r in readers.statements(table).collect()] == [("2025", "Q1", {"calendarYear": 2025.0, "roe": 0.5})]
    index = spark.createDataFrame([("a", 7, "p.htm", '{"directory": {"item": {"name": "ex99-1.htm", "type": "EX-99.1"}}}')], "accession string, cik_int int, primary_document string, payload string")
    assert filings.filing_documents(readers.filing_index(index)).first().name == "ex99-1.htm"
    block = spark.createDataFrame([("A", '{"filings": {"recent": {"form": ["8-K", "10-Q"], "filingDate": ["2025-01-01"], "other": 3}}}')], "symbol string, payload string")
    assert [(r.form, r.filing_date, r["items"]) for r in filings.submissions_rows(readers.submission_blocks(block)).orderBy("row_ord").collect()] == [("8-K", "2025-01-01", None), ("10-Q", None, None)]
    tickers = spark.createDataFrame([('{"0": {"cik_str": 5, "ticker": "abc", "title": "First"}, "1": {"cik_str": 6, "ticker": "ABC", "title": "Second"}}',)], "payload string")
    assert [(r.cik, r.title) for r in filings.cik_lookup(spark.createDataFrame([("Abc",)], "symbol string"), readers.ticker_map(tickers)).collect()] == [("0000000005", "First")]


def test_a_period_listed_twice_counts_once(spark):
    rows = spark.createDataFrame([("A", "income", "quarter", "2025", "Q1", 1, 1, 10.0), ("A", "ratios", "quarter", "2024", "1", 1, 1, 3.0)], "symbol string, table_name string, freq string, fiscal_year string, period string, row_ord int, rank int, amount double")
    chosen = spark.createDataFrame([("A", 1, 2025, 1, "Q1 2025", "x"), ("A", 2, 2025, 1, "Q1 2025", "x")], "symbol string, rank int, year int, quarter int, period_label string, call_date string")
    got = {r.table_name: r for r in periods.period_match(rows, chosen, allow_fallback=True).collect()}
    assert (got["income"].n_matched, [r.amount for r in got["income"].matched_rows]) == (1, [10.0]) and not got["income"].fallback_used
    assert got["ratios"].match_status == "no_exact_period_match" and [r.amount for r in got["ratios"].fallback_rows] == [3.0]


def test_the_exhibit_that_speaks_of_the_quarter_wins(spark):
    docs = [("f", 7, "a.htm", n, t, "") for n, t in (("ex99-1.htm", "EX-99.1"), ("ex99-2.htm", "EX-99.2"), ("ex10.htm", "EX-10"))]
    ranked = filings.filing_documents(spark.createDataFrame(docs, "accession string, cik_int int, primary_document string, name string, type string, description string"))
    read = [("f", "ex99-1.htm", "Repurchase program only.", 0), ("f", "ex99-2.htm", "First quarter fiscal 2025 financial results, net income and guidance", 3), ("f", "ex10.htm", "First quarter 2025 " * 50, 9)]
    wanted = spark.createDataFrame([("f", 2025, 1)], "accession string, fiscal_year int, quarter int")
    got = filings.exhibit_rank(ranked, spark.createDataFrame(read, "accession string, name string, text string, n_tables int"), wanted).first()
    assert (got.name, got.n_read) == ("ex99-2.htm", 2) and got.content_score == 3 * 180 + 2500 + 200 + 500 + 500


def test_one_ticker_with_half_of_all_releases(spark):
    rows = [("HOT" if k % 2 else f"T{k}", 2025, 1, k, k % 97, None) for k in range(4000)]
    scores = spark.createDataFrame(rows, "ticker string, fiscal_year int, quarter int, row_ord int, score long, release_date date")
    got = [(r.rank, r.row_ord) for r in releases.release_candidates(scores, 5).where("ticker = 'HOT'").orderBy("rank").collect()]
    best = sorted((-s, o) for t, _, _, o, s, _ in rows if t == "HOT")[:5]
    assert got == [(k, o) for k, (_, o) in enumerate(best, 1)]


def test_windows_that_are_none_are_refused(spark):
    table = spark.createDataFrame([], "symbol string, form string, filing_date string, report_date string, items string, accession string, primary_document string, row_ord int")
    for first, last, error in (("2025-02-30", None, "from_date_not_a_date"), (None, "x", "to_date_not_a_date"), ("2025-02-02", "2025-02-01", "from_date_after_to_date")):
        with pytest.raises(ValueError, match=error):
            filings.filing_search(table, first, last)
    assert filings.filing_search(table, None, None).count() == 0


def test_texts_are_cleaned_once_and_pages_move_only_where_asked_for(spark):
    table = spark.createDataFrame([release("a", "https://x.com/a", "Some text")], RELEASE)
    made = content.release_content(table, spark.createDataFrame([("https://x.com/a", "x")], "url string, html string"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(made.select("content_source", "content_error", "raw_content", "raw_format")).count(r"\x1b\[[0-9;]*m") == 1
    # A page lies on the side that parses it and nowhere else.
    joins = [line for line in plan(content.release_sections(made).select("release_id", "sections")).splitlines() if "Project" in line and "_page" in line]
    assert joins and not any("html_" in line for line in joins)


def test_titles_come_from_the_last_lines_before_a_table(spark):
    page = lambda n: f"<article><p>{FILLER}<p>Balance Sheet of the year<p>" + "<p>".join(f"line {k}" for k in range(n)) + f"{TABLE}</article>"
    rows = [release("a", "https://x.com/a", ""), release("b", "https://x.com/b", "")]
    got = {r.release_id: [s.title for s in r.sections if s.kind == "table"] for r in documents(spark, rows, [("https://x.com/a", page(11)), ("https://x.com/b", page(12))]).collect()}
    assert got == {"a": ["Balance Sheet of the year"], "b": ["line 11"]}
