"""Filings end to end: two-phase exhibits, plain text of pages, Markdown of a filing; landed payloads to results."""

import json

from pyspark.sql import functions as F

from quarterweave.operators import content, filings, periods, releases
from quarterweave.operators.html import parse_pages
from quarterweave.sources import readers

DOCS = "accession string, cik_int int, primary_document string, name string, type string, description string"


def test_text_of_a_page_has_its_lines(spark):
    page = "<head>no</head><h1>Head  line</h1><p>One &amp; two  <br> three</p>\n\n\n<table><tr><td>a<td>b</tr><tr><td>c</table><ul><li>x<li>y</ul><script>no</script>end"
    rows = spark.createDataFrame([(1, 2, page), (1, 3, None), (1, 4, "<p>ok<![bad[")], "a int, b int, html string")
    parsed = filings.exhibit_contents(rows.select(F.col("a").alias("accession"), F.col("b").alias("name")), rows.withColumnsRenamed({"a": "accession", "b": "name"}))
    got = {r.name: r for r in parsed.collect()}
    assert got[2].text == "Head line\n\nOne & two\nthree\n\nab\n\nc\nxyend" and got[2].n_tables == 1
    assert (got[3].text, got[3].sections, got[3].error) == ("", [], None) and got[4].error and got[4].text == "" and got[4].n_tables == 0
    assert parse_pages(rows, ["a", "b"]).columns == ["a", "b", "sections", "error"]


def test_only_the_first_twelve_are_read(spark):
    docs = [("f", 7, "p.htm", f"ex99-{k:02d}.htm", "EX-99", "Earnings press release") for k in range(20)] + [("f", 7, "p.htm", "ex10.htm", "EX-10", "Credit Agreement"), ("g", 7, "p.htm", "p.htm", "8-K", "")]
    page = "<p>First quarter 2025 financial results, net income and guidance</p>"
    pages = [(a, n, page if n == "ex99-10.htm" else "<p>words") for a, _, _, n, *_ in docs] + [("other", "x.htm", page)]
    best, read = filings.filing_exhibits(spark.createDataFrame(docs, DOCS), spark.createDataFrame(pages, "accession string, name string, html string"), spark.createDataFrame([("f", 2025, 1)], "accession string, fiscal_year int, quarter int"))
    got = {r.accession: r for r in best.collect()}
    assert (got["f"].name, got["f"].n_read, got["g"].name, got["g"].n_read, got["g"].quarter) == ("ex99-10.htm", 12, "p.htm", 1, None)
    assert sorted(r.name for r in read.collect()) == sorted([f"ex99-{k:02d}.htm" for k in range(8, 20)] + ["p.htm"])


def markdown(spark, *pages, **header):
    parsed = parse_pages(spark.createDataFrame(list(enumerate(pages)), "k int, html string"), "k")
    return [r for r in filings.filing_markdown(parsed, {k: F.lit(v) for k, v in header.items()}, ["k"]).orderBy("k").collect()]


def test_markdown_of_a_filing(spark):
    page = (
        "<h1>Acme</h1><p>Acme reports first quarter results</p><h2>Acme reports first quarter results</h2><table><tr><td>nan</td></tr></table>"
        "<h2>Balance sheet</h2><table><tr><td></td><td>2025</td><td>2024</td></tr><tr><td>Cash</td><td>1</td><td>2</td></tr></table><p>Balance sheet</p>"
        f"<p>{'long ' * 60}</p><table><tr><td>a|b</td><td>EBITDA</td></tr></table><li>one</li><li>two</li><p>end \"x\"</p>"
    )
    got, bare = markdown(spark, page, None, symbol='A "B"', fiscal_year=2025, empty="")
    long = ("long " * 60).strip()
    assert got.markdown == (
        '---\nsymbol: "A \\"B\\""\nfiscal_year: "2025"\ntable_count: "3"\n---\n\n# Acme reports first quarter results\n\n## Acme\n\nAcme reports first quarter results\n\n## Balance sheet\n\n'
        f"## Financial Table 1: Balance sheet\n\n|Item|2025|2024|\n|-|-:|-:|\n|Cash|1|2|\n\n{long}\n\n## Non-GAAP Table 2: Balance sheet\n\n|Item|Value 1|\n|-|-:|\n|a\\|b|EBITDA|\n\n- one\n- two\nend \"x\"\n"
    )
    assert bare.markdown == '---\nsymbol: "A \\"B\\""\nfiscal_year: "2025"\ntable_count: ""\n---\n\n# Earnings Release of a Filing\n' and bare.n_tables == 0


def test_one_job_from_filings_to_markdown(spark):
    rows = [("A", "8-K", "2025-05-01", "2025-03-31", "2.02", "1", "p.htm", 0), ("A", "8-K", "2025-09-01", "", "8.01", "2", "p.htm", 1), ("B", "4", "2025-05-01", "", "", "3", "p.htm", 0)]
    filed = spark.createDataFrame(rows, "symbol string, form string, filing_date string, report_date string, items string, accession string, primary_document string, row_ord int")
    asked = spark.createDataFrame([("A", 2025, 1, "2025-05-02"), ("B", 2025, 1, "2025-05-02"), ("C", 2025, 1, None)], "symbol string, fiscal_year int, quarter int, anchor_date string")
    docs = spark.createDataFrame([("1", 7, "p.htm", "p.htm", "8-K", ""), ("1", 7, "p.htm", "ex99-1.htm", "EX-99.1", "Press release"), ("2", 7, "p.htm", "p.htm", "8-K", "")], DOCS)
    pages = spark.createDataFrame([("1", "ex99-1.htm", "<p>A announces first quarter results"), ("1", "p.htm", "<p>body</p>"), ("2", "p.htm", "<p>x</p>")], "accession string, name string, html string")
    got = filings.filing_releases(filed, asked, docs, pages).collect()
    assert [(r.symbol, r.accession, r.name, r.n_tables) for r in got] == [("A", "1", "ex99-1.htm", 0)] and 'selected_document_url: "https://www.sec.gov/Archives/edgar/data/7/1/ex99-1.htm"' in got[0].markdown


def test_payloads_become_packs_ranks_and_documents(spark):
    dates = spark.createDataFrame([("A", json.dumps([{"fiscalYear": 2025, "quarter": 1, "date": "2025-05-01"}, {"year": 2024, "quarter": "Q4", "callDate": "2025-02-01"}]))], "symbol string, payload string")
    tables = [("A", "ratios", "quarter", json.dumps([{"calendarYear": "2025", "period": "Q1", "roe": 0.5, "debt": 2, "note": "x"}, {"calendarYear": "2024", "period": "Q4", "roe": 0.4}])), ("A", "income_statement", "annual", json.dumps([{"fiscalYear": 2024, "period": "FY", "revenue": 9}]))]
    rows = periods.statement_tables(readers.statements(spark.createDataFrame(tables, "symbol string, table_name string, freq string, payload string")), 4, 3)
    chosen = periods.latest_periods(readers.transcript_dates(dates), 2, 2024)
    years = periods.annual_match(rows, periods.latest_fiscal_year(chosen))
    pack = periods.evidence_pack(dates, chosen, periods.period_match(rows, chosen, allow_fallback=True), years, periods.followup_actions(chosen)).first()
    measures = [{e.key: e.value for e in r.measures} for r in pack.financial_tables[0].matched_rows]
    assert [p.period_label for p in pack.selected_periods] == ["Q1 2025", "Q4 2024"] and [(m["roe"], m.get("debt")) for m in measures] == [(0.5, 2.0), (0.4, None)]
    assert pack.annual_tables[0].matched_rows[0].measures[-1].asDict() == {"key": "revenue", "value": 9.0} and json.loads(pack.financial_tables[0].matched_rows[0].raw)["note"] == "x"
    block = {"filings": {"recent": {"form": ["8-K", "10-Q"], "filingDate": ["2025-05-01", "2025-05-02"], "items": ["2.02"], "accessionNumber": ["1", "2"]}}}
    filed = filings.submissions_rows(readers.submission_blocks(spark.createDataFrame([("A", json.dumps(block))], "symbol string, payload string")))
    asked = chosen.select("symbol", F.col("year").alias("fiscal_year"), "quarter", F.col("call_date").alias("anchor_date"))
    assert {(r.quarter, r.accession) for r in filings.filing_rank(filed, asked).collect()} == {(1, "1"), (4, "1")}
    feed = json.dumps({"pressReleases": [{"title": "A reports first quarter 2025 results", "url": "https://x.com/1", "text": "Body", "publishedDate": "2025-05-01"}] * 300})
    feeds = spark.createDataFrame([("A", feed)], "ticker string, payload string")
    found = readers.press_releases(feeds)
    assert (found.count(), readers.press_releases(feeds, most=None).count()) == (250, 300)
    none = spark.createDataFrame([], "url string, html string")
    doc = content.release_documents(releases.release_fields(found), asked.withColumnRenamed("symbol", "ticker"), none).collect()
    assert [(r.quarter, r.row_ord, r.content_source) for r in doc] == [(1, 0, "press_release_text")] and doc[0].markdown.endswith("\nBody\n")


def test_texts_alone_rank_as_parsed_pages_do(spark):
    """The most that terms count is twelve; words of contracts and dividends count as their patterns say, whatever the case."""
    texts = ["Guidance. " * 20, "guidance " * 12, "The BORROWER agrees", "article I. Definitions", "Definitions", "REPURCHASE PROGRAM", "rule 10B-18", "first  quarter fiscal 2025", "Q1 FY2025, second quarter", None]
    docs = [(f"f{k}", 7, "p.htm", "p.htm", "8-K", "") for k in range(len(texts))]
    pages = spark.createDataFrame([(f"f{k}", "p.htm", t and f"<p>{t}</p><table><tr><td>1</td></tr></table>") for k, t in enumerate(texts)], "accession string, name string, html string")
    requests = spark.createDataFrame([(f"f{k}", 2025, q) for k in range(len(texts) - 1) for q in (1, 2)], "accession string, fiscal_year int, quarter int")
    one = filings.exhibits_by_pages(spark.createDataFrame(docs, DOCS), pages, requests)
    two = filings.filing_exhibits(spark.createDataFrame(docs, DOCS), pages, requests)[0]
    rows = {(r.accession, r.quarter): r for r in one.collect()}
    assert rows == {(r.accession, r.quarter): r for r in two.collect()}
    got = [rows[f"f{k}", 1].content_score for k in range(len(texts) - 1)]
    assert got == [2160 + 50, 2160 + 50, -5000 + 50, -5000 + 50, 50, -1200 + 50, -1200 + 50, 2500 + 200 + 500 + 50, 2500 + 200 + 250 - 600 + 50]
    assert rows["f9", None].content_score == 0


def test_pages_are_read_and_scored_where_they_lie(spark):
    """Documents meet requests and pages first: nothing but scores moves once a page is read. Documents of one name that are known
    alike are counted, others of that name are not lost."""
    docs = [("f", 7, "p.htm", "ex99-1.htm", "EX-99.1", "Press release")] * 3 + [("f", 7, "p.htm", "ex99-1.htm", "EX-99.1", "Credit"), ("f", 7, "p.htm", "ex99-2.htm", "", ""), ("g", 7, "p.htm", "p.htm", "", ""), (None, 7, "p.htm", "p.htm", "", "")]
    pages = spark.createDataFrame([("f", "ex99-1.htm", "<p>guidance</p>"), ("g", "other.htm", "<p>guidance")], "accession string, name string, html string")
    requests = spark.createDataFrame([("f", 2025, 1), ("f", 2025, 1), ("f", 2025, 2), ("g", None, 1)], "accession string, fiscal_year int, quarter int")
    args = spark.createDataFrame(docs, DOCS), pages, requests
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        one = filings.exhibits_by_pages(*args)
        plan = one._jdf.queryExecution().executedPlan().toString().split("MapInArrow")
        got, two = one.collect(), filings.filing_exhibits(*args)[0].collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(str, got)) == sorted(map(str, two))
    assert {(r.accession, r.quarter): (r.name, r.n_read, r.content_score) for r in got} == {("f", 1): ("ex99-1.htm", 10, 180), ("f", 2): ("ex99-1.htm", 5, 180), ("g", 1): ("p.htm", 1, 0), (None, None): ("p.htm", 1, 0)}
    assert len(plan) == 2 and plan[0].count("Exchange ") == 1 and "Join" not in plan[0]


def test_objects_are_parsed_once_and_only_those_that_can_be_kept(spark):
    """Tables in several payloads too; measures are what a plain cast finds."""
    texts = ["1", " -2.5 ", "\t+3e2", ".5", "7d", "inf", "-Infinity", "NaN", "nan ", "Q1", "quarter", "", "x9", "0x1p3", "1_0", "\x7f4", "\u00a05", "1e", "none", "++1", None]
    listed = lambda n, at: json.dumps([{"calendarYear": 2030 - k, "period": "Q1", "amount": at + k, **{f"m{j}": t for j, t in enumerate(texts)}} for k in range(n)])
    tables = [("A", "t", "quarter", listed(9, 0)), ("A", "t", "quarter", listed(2, 100)), ("A", "t", "annual", listed(6, 200)), ("A", "u", "quarter", listed(1, 300)), ("B", "t", "quarter", "[]"), ("B", "u", "quarter", "{bad"), ("C", "t", "annual", '[1, null, {"year": 7}]'), ("D", "t", "annual", None)]
    landed = spark.createDataFrame(tables, "symbol string, table_name string, freq string, payload string")
    every, few = readers.statements(landed), readers.statements(landed, newest=4)
    assert few.dtypes == every.dtypes and (every.count(), few.count()) == (19, 12)
    amounts = lambda rows: sorted((r.symbol, r.table_name, r.freq, r.row_ord) for r in periods.statement_tables(rows, 4, 3).collect())
    assert amounts(every) == amounts(few) and len(amounts(few)) == 9
    plain = spark.createDataFrame([(f"m{j}", t) for j, t in enumerate(texts)], "k string, t string").select("k", F.col("t").try_cast("double").alias("v")).where("v is not null")
    first = few.where("table_name = 'u'").first()
    assert {k: str(v) for k, v in first.measures.items() if k[0] == "m"} == {r.k: str(r.v) for r in plain.collect()} and first.measures["amount"] == 300
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(ArrayType") == 1 and plan.count("from_json(MapType") == 1
