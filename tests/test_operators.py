import datetime
import json

from quarterweave.operators import filings, periods, releases, transcripts
from quarterweave.sources import shapes


def calls(spark, *texts):
    rows = [("T", 2025, k, 0, t, None, "x") for k, t in enumerate(texts)]
    items = spark.createDataFrame(rows, "symbol string, year int, quarter int, item_ord int, content string, transcript string, text string")
    return transcripts.qa_split(transcripts.qa_candidates(transcripts.transcript_text(items)))


def test_split_offsets_count_characters(spark):
    body = "word 😀 " * 200
    got = {r.quarter: r for r in calls(spark, body + "\nQuestion-and-Answer Session\nmore", body, "Q&A\n" + body + "we are ready for your questions now. Operator: our first question comes from Jane").collect()}
    assert got[0].method == "explicit_q_and_a_heading" and got[0].prepared == body.strip() and got[0].qna.startswith("Question-and")
    assert got[1].method is None and got[1].qna == ""
    assert got[2].method == "management_qa_transition" and got[2].score == 0.97


def second_operator_at(spark, *places):
    """Calls of 2,000 characters whose second intervention lies at a place."""
    hit = "Operator: x\n"
    return calls(spark, *[(hit + "y" * (at - len(hit)) + "\n" + hit).ljust(2000, "z") for at in places])


def test_warnings_round_the_share_itself(spark):
    places = (51, 71, 91, 103, 110)
    got = {r.position: r.warnings[0] for r in second_operator_at(spark, *places).collect()}
    assert got == {at: f"qna_candidate_very_early:second_operator_intervention_fallback:{at / 2000:.1%}" for at in places}
    assert got[51].endswith(":2.5%")


def test_latest_periods_keep_feed_order_on_ties(spark):
    rows = [("A", "FY2025", None, "Q1", "2025-01-01", 2), ("A", "2025", None, "1", "2025-01-01", 1), ("A", "0", "2026", "2", "x", 3), ("B", "2025.0", None, "1", None, 1)]
    dates = spark.createDataFrame(rows, "symbol string, year string, fiscal_year string, quarter string, call_date string, row_ord int")
    got = periods.latest_periods(dates, 2, 2025).orderBy("rank").collect()
    assert [(r.symbol, r.year, r.quarter) for r in got] == [("A", 2026, 2), ("A", 2025, 1)]


def test_release_period_forms(spark):
    texts = ["fiscal year 2025 first quarter", "third-quarter of fiscal 2024", "q2 fy 2026", "q4 2023", "nothing"]
    df = spark.createDataFrame([(t,) for t in texts], "low string")
    assert [r.p for r in df.select(releases.detect_period(df.low).alias("p")).collect()] == ["Q1 FY2025", "Q3 FY2024", "Q2 FY2026", "Q4 FY2023", None]


def test_best_filing_is_the_near_results_filing(spark):
    rows = [("S", "8-K", "2026-02-15", "", "8.01", "1", "", 1), ("S", "8-K", "2026-01-02", "", "2.02", "2", "", 2), ("S", "10-Q", "2026-01-03", "", "", "3", "", 3)]
    table = spark.createDataFrame(rows, "symbol string, form string, filing_date string, report_date string, items string, accession string, primary_document string, row_ord int")
    requests = spark.createDataFrame([("S", 2026, 1, "2026-01-01")], "symbol string, fiscal_year int, quarter int, anchor_date string")
    assert [r.accession for r in filings.filing_rank(table, requests).collect()] == ["2"]


def test_exhibit_99_beats_the_body(spark):
    rows = [("a-1", 7, "company-8k.htm", "company-8k.htm", "8-K", "FORM 8-K"), ("a-1", 7, "company-8k.htm", "ex99-1.htm", "EX-99.1", "Earnings press release")]
    docs = spark.createDataFrame(rows, "accession string, cik_int int, primary_document string, name string, type string, description string")
    assert [r.name for r in filings.filing_documents(docs).where("rank = 1").collect()] == ["ex99-1.htm"]


def test_quality_repeats_the_warning_of_the_split(spark):
    got = transcripts.transcript_quality(second_operator_at(spark, 51)).first()
    assert f"qna_candidate_very_early:second_operator_intervention_fallback:{51 / 2000:.1%}" in got.warnings.split(",")


def test_statement_rows_are_moved_once(spark):
    """By company, for ranks, matches and tables alike; a company's periods meet them as one row."""
    rows = [("A", "t", "quarter", "2025", "q1", 1, 1.0), ("A", "t", "quarter", "2025", "1", 2, 2.0), ("A", "u", "quarter", "2024", "Q4", 1, 3.0), ("A", "u", "quarter", "2024", "Q3", 2, 4.0), ("B", "t", "quarter", "2025", "Q1", 1, 5.0)]
    statements = spark.createDataFrame(rows, "symbol string, table_name string, freq string, fiscal_year string, period string, row_ord int, amount double")
    chosen = spark.createDataFrame([("A", 2025, 1), ("A", 2025, 1), ("A", 2025, None)], "symbol string, year int, quarter int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = periods.period_match(periods.statement_tables(statements), chosen, allow_fallback=True)
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 2
        got = {(r.symbol, r.table_name): ([x.amount for x in r.matched_rows], [x.amount for x in r.fallback_rows], r.fallback_used, r.match_status[:2]) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {("A", "t"): ([1.0], [], False, "ex"), ("A", "u"): ([], [3.0], True, "no"), ("B", "t"): ([], [], False, "no")}


def test_statements_are_dealt_by_company_before_they_multiply(spark, tmp_path):
    """The rows of the SQL, odd ones included; lines move to their order and then to their company, tables made of them stay there."""
    day = lambda k: None if k % 17 == 0 else datetime.datetime(1994 + k % 5, 1 + k % 12, 1 + k % 28)
    lines = [(k % 70 if k % 19 else None, None if k % 23 == 0 else float(k % 50), None if k < 70 and k % 7 == 0 else k * 1000.01 + 0.005, day(k)) for k in range(600)]
    owners = [(k, None if k % 11 == 0 else k % 27 - 1) for k in range(60)]
    made = {"lineitem": (lines, "l_orderkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz"), "orders": (owners, "o_orderkey long, o_custkey long")}
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"file://{tmp_path}/{name}.parquet")
    read = {name: spark.read.parquet(f"file://{tmp_path}/{name}.parquet") for name in made}
    got, want = shapes.shaped(spark, f"file://{tmp_path}", "statements"), spark.sql(shapes.SHAPES["statements"], **read)
    assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {None, "C13", "C-1"} <= {r.symbol for r in got.select("symbol").distinct().collect()} and got.where("fiscal_year is null").count() > 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = periods.statement_tables(shapes.shaped(spark, f"file://{tmp_path}", "statements"), 4, 3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange ") == 3 and plan.count("Join ") == 1


def test_exhibits_are_made_where_their_filing_lies(spark, tmp_path):
    """The rows of the SQL, odd ones included: several lines of a page, no part, no order; documents move once on each side."""
    lines = [(None if k % 53 == 0 else k % 37 * 16 if k % 2 else k % 41, None if k % 5 == 0 else [9, 10, 100, 11, 2][k % 5] * (k % 7), None if k % 29 == 0 else k % 9) for k in range(900)]
    owners = [(k, None if k % 11 == 0 else k % 27 - 1) for k in range(0, 600, 3)] + [(3, 5), (None, 1)]
    made = {"lineitem": (lines, "l_orderkey long, l_partkey long, l_linenumber int"), "orders": (owners, "o_orderkey long, o_custkey long")}
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"file://{tmp_path}/{name}.parquet")
    read = {name: spark.read.parquet(f"file://{tmp_path}/{name}.parquet") for name in made}
    for name in ("filing_documents", "exhibit_pages", "exhibit_requests"):
        got, want = shapes.shaped(spark, f"file://{tmp_path}", name), spark.sql(shapes.SHAPES[name], **read)
        assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 20, name
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = filings.read_first(filings.filing_documents(shapes.shaped(spark, f"file://{tmp_path}", "filing_documents")))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange ") == 2


def test_payloads_hold_the_statements_of_the_sql(spark, tmp_path):
    """In their order, for each of the six tables."""
    lines = [(k % 70, float(k % 50), k * 1000.01, None if k % 17 == 0 else datetime.datetime(1994 + k % 5, 1 + k % 12, 1 + k % 28)) for k in range(600)]
    owners = [(k, None if k % 11 == 0 else k % 27 - 1) for k in range(60)]
    spark.createDataFrame(lines, "l_orderkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz").write.parquet(f"file://{tmp_path}/lineitem.parquet")
    spark.createDataFrame(owners, "o_orderkey long, o_custkey long").write.parquet(f"file://{tmp_path}/orders.parquet")
    rows = shapes.shaped(spark, f"file://{tmp_path}", "statements")
    want = {}
    for r in sorted(rows.collect(), key=lambda r: (r.row_ord is not None, r.row_ord or 0)):
        own = {"calendarYear": r.fiscal_year, "period": r.period, "amount": r.amount, "reportedCurrency": r.freq}
        want.setdefault((r.symbol, r.table_name, r.freq), []).append({k: v for k, v in own.items() if v is not None})
    got = {(r.symbol, r.table_name, r.freq): json.loads(r.payload) for r in shapes.payloads(spark, f"file://{tmp_path}", "statements").collect()}
    assert got == want and len(got) > 100
