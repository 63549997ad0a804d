"""Pairs that cannot win are not made: same results as all pairs, far fewer of them. Sinks can be run again."""

import datetime
import random
import re

from pyspark.sql import functions as F

from quarterweave.functions.patterns import EARNINGS_RELEASE
from quarterweave.operators import filings, releases
from quarterweave.sources import sinks

FILED = "symbol string, form string, filing_date string, report_date string, items string, accession string, primary_document string, row_ord int"


def _score(f, year, quarter, anchor):
    _, form, filed, reported, items, accession, doc, _ = f
    everything = " ".join(x for x in (form, filed, reported, items, accession, doc) if x is not None)
    day = lambda x: datetime.date.fromisoformat(x) if x and re.fullmatch(r"\d{4}-\d\d-\d\d", x) else None
    days = abs((day(filed) - day(anchor)).days) if day(filed) and day(anchor) else None
    near = 0 if days is None else 350 if days <= 2 else 250 if days <= 14 else 150 if days <= 45 else 50 if days <= 90 else 0
    quarters = "quarter" in everything.lower() or re.search(rf"\bq{quarter}\b", everything.lower())
    return (
        (1000 if form in ("8-K", "6-K") else 250) + (350 if re.search(r"\b2\.02\b|results of operations|financial condition", items or "", re.I) else 0) + (175 if re.search(EARNINGS_RELEASE, everything) else 0)
        + (40 if str(year) in everything else 0) + (30 if quarters else 0) + near + (50 if str(year) in (reported or "") else 0)
    )


def test_best_filings_of_a_company_with_very_many(spark):
    r = random.Random(4)
    day = lambda: str(datetime.date(2015, 1, 1) + datetime.timedelta(r.randrange(4000)))
    rows = [
        ("HOT" if k % 4 else f"S{k % 12}", r.choice(["8-K", "6-K", "10-Q", "4"]), r.choice([day(), day(), day(), None, "soon"]), r.choice([day(), ""]), r.choice(["2.02", "8.01", "", None, "Q2 report", "quarter"]), f"a{k % 50}", "p.htm", k)
        for k in range(4000)
    ]
    asked = [(s, y, q, r.choice([day(), day(), None])) for s in ("HOT", "S0", "S4", "NONE") for y in range(2016, 2022) for q in range(1, 5)]
    filed, requests = spark.createDataFrame(rows, FILED), spark.createDataFrame(asked, "symbol string, fiscal_year int, quarter int, anchor_date string")
    got = {(x.symbol, x.fiscal_year, x.quarter): (x.score, x.accession) for x in filings.filing_rank(filed, requests).collect()}
    want = {}
    for s, y, q, a in asked:
        own = [(_score(f, y, q, a), f[2] or "", -f[7], f[5]) for f in rows if f[0] == s and f[1] != "4"]
        if own:
            best = max(own)
            want[s, y, q] = (best[0], best[3])
    assert got == want
    every = sum(f[0] == s and f[1] != "4" for s, *_ in asked for f in rows)
    assert filings.filing_pairs(filed, requests).count() < every / 4


def test_the_same_twenty_from_a_tenth_of_the_pairs(spark):
    r = random.Random(7)
    title = lambda: r.choice(["Notes of the day", "Lawsuit filed", "A reports first quarter 2025 results", "Q2 FY2024 earnings", "Dividend", "Results for the quarter ended", f"Fiscal year {r.randrange(2020, 2028)} third quarter update", ""])
    feed = [("HOT" if k % 5 else f"T{k % 3}", k, title(), f"https://x.com/{k}", "", r.choice(["2025-01-02", "2024-06-01", "2019-01-01", None])) for k in range(6000)]
    fields = releases.release_fields(spark.createDataFrame(feed, "ticker string, row_ord long, title string, url string, text string, published_date string"))
    requests = spark.createDataFrame([(t, y, q) for t in ("HOT", "T0", "T1", "X") for y in (2024, 2025) for q in (1, 2, 3, 4)], "ticker string, fiscal_year int, quarter int")
    few = releases.release_contenders(fields, requests, 20)
    pick = lambda df: sorted(tuple(x) for x in releases.release_candidates(df, 20).select("ticker", "fiscal_year", "quarter", "rank", "row_ord", "score").collect())
    every, some = releases.release_scores(fields, requests), releases.release_scores(few, requests)
    assert pick(every) == pick(some) and len(pick(some)) == 3 * 8 * 20
    hot = F.col("ticker") == "HOT"
    assert some.where(hot).count() < every.where(hot).count() / 2
    assert releases.release_scores(releases.release_contenders(fields, requests, 1), requests).where(hot).count() < every.where(hot).count() / 10


def test_sinks_can_be_run_again(spark, tmp_path):
    path = f"file://{tmp_path}"
    docs = spark.createDataFrame([(f"r{k}", 2024 + k % 2, "scraped" if k % 5 else None, "# x", "txt", "raw", None if k % 5 else "no_url") for k in range(50)], "release_id string, fiscal_year int, content_source string, markdown string, raw_format string, raw_content string, content_error string")
    runs = []
    for _ in range(2):
        sinks.write_markdown(docs, path), sinks.write_raw(docs, path), sinks.write_audit(docs, path), sinks.write_manifest(docs, path), sinks.write_packs(docs.select(F.struct("*").alias("pack")), path)
        counts = sinks.write_routed(docs, f"{path}/routed")
        runs.append([sorted(map(str, spark.read.format(f).load(f"{path}/{n}").collect())) for n, f in (("markdown", "parquet"), ("raw", "parquet"), ("audit", "parquet"), ("manifest", "json"), ("evidence", "json"), ("routed", "parquet"))])
    assert runs[0] == runs[1] and list(map(len, runs[0])) == [40, 40, 50, 50, 50, 50] and counts == {"ok": 40, "quarantine": 10}
    sinks.write_markdown(docs.where("fiscal_year = 2024 and release_id < 'r2'"), path)  # one year written anew, the other as it was
    per = {x.fiscal_year: x["count"] for x in spark.read.parquet(f"{path}/markdown").groupBy("fiscal_year").count().collect()}
    assert per[2025] == 20 and 0 < per[2024] < 20
    found = sinks.errors(("content", docs, F.col("release_id"), F.col("content_error")), ("payload", docs.limit(1), F.lit("k"), F.lit("bad")))
    assert found.groupBy("stage").count().orderBy("stage").collect() == [("content", 10), ("payload", 1)]


def test_filings_move_once_by_company(spark):
    rows = spark.createDataFrame([("S", "8-K", "2026-01-02", "", "2.02", "1", "", 1)], "symbol string, form string, filing_date string, report_date string, items string, accession string, primary_document string, row_ord int")
    requests = spark.createDataFrame([("S", 2026, 1, "2026-01-01"), ("S", 2020, 1, "2020-01-01"), ("S", 2019, 1, None)], "symbol string, fiscal_year int, quarter int, anchor_date string")
    pairs = filings.filing_pairs(rows, requests)
    # Near, and as a stand-in of its kind for every request.
    assert sorted((r.fiscal_year, r.score) for r in pairs.collect()) == [(2019, 1350), (2020, 1350), (2026, 1740), (2026, 1740)]
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join Inner" in line and "bucket" in line]
