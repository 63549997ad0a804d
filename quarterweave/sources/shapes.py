"""Domain tables shaped from the driver's tables, as SQL text that Spark and DuckDB both run.

Test scaffolding: the jobs take any table with these schemas. Placeholders in braces name driver tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHAPES = {
    "transcript_items": """
        SELECT 'T' || cast(conv_id AS varchar(20)) AS symbol, 2023 + cast(floor(conv_id / 4) AS bigint) % 4 AS year, conv_id % 4 + 1 AS quarter, turn AS item_ord,
            CASE WHEN turn % 3 = 0 OR turn % 7 = 6 THEN line END AS content, CASE WHEN turn % 3 = 1 THEN line WHEN turn % 7 = 6 THEN 'short' END AS transcript, CASE WHEN turn % 3 = 2 THEN line END AS text
        FROM (SELECT conv_id, turn,
            CASE WHEN turn = 1 AND conv_id % 9 = 1 THEN 'Question-and-Answer Session' || chr(10)
                 WHEN turn = 1 AND conv_id % 9 = 2 THEN 'With that, we will now open the call for questions' || chr(10)
                 WHEN turn = 1 AND conv_id % 9 = 3 THEN 'Operator: Our first question comes from Jane' || chr(10)
                 WHEN turn = 1 AND conv_id % 9 = 4 THEN 'We’ll take our first question from Jane' || chr(10)
                 WHEN turn < 4 AND conv_id % 9 = 5 THEN 'Operator - '
                 WHEN turn = 1 AND conv_id % 9 = 6 THEN 'a question and answer session will follow' || chr(10)
                 WHEN turn = 0 AND conv_id % 9 = 7 THEN 'Q&A' || chr(10)
                 WHEN turn = 1 AND conv_id % 9 = 7 THEN 'We are ready for your questions' || chr(10) || 'Operator: The first question is from Jane' || chr(10)
                 WHEN turn = 1 AND conv_id % 9 = 8 THEN 'this concludes the call [truncated]' || chr(10)
                 ELSE '' END
            || CASE role WHEN 'system' THEN 'Operator: ' WHEN 'user' THEN 'Analyst: ' ELSE 'Chief Executive Officer: ' END || coalesce(text, '') AS line FROM {conversations})""",
    "transcript_dates": """
        SELECT symbol, CASE WHEN c % 11 = 0 THEN 'FY' || cast(y AS varchar(20)) WHEN c % 5 = 0 THEN NULL ELSE cast(y AS varchar(20)) END AS year,
            CASE WHEN c % 11 <> 0 AND c % 5 = 0 THEN cast(y AS varchar(20)) END AS fiscal_year,
            CASE WHEN c % 7 = 0 THEN 'Q' || cast(q AS varchar(20)) ELSE cast(q AS varchar(20)) END AS quarter, call_date, 100000 - y * 10 - q AS row_ord
        FROM (SELECT 'C' || cast(o_custkey AS varchar(20)) AS symbol, o_custkey AS c, extract(year FROM o_orderdate) AS y, extract(quarter FROM o_orderdate) AS q,
            cast(cast(max(o_orderdate) AS date) AS varchar(20)) AS call_date FROM {orders} GROUP BY 1, 2, 3, 4)""",
    "statements": """
        SELECT symbol, table_name, freq, fiscal_year, period, row_ord, amount FROM (
        SELECT 'C' || cast(c AS varchar(20)) AS symbol, CASE k WHEN 0 THEN 'income_statement' WHEN 1 THEN 'balance_sheet' WHEN 2 THEN 'cash_flow_statement' WHEN 3 THEN 'key_metrics' WHEN 4 THEN 'ratios' ELSE 'financial_growth' END AS table_name, freq,
            cast(y AS varchar(20)) AS fiscal_year, CASE WHEN freq = 'annual' THEN 'FY' WHEN c % 13 = 0 THEN cast(q AS varchar(20)) ELSE 'Q' || cast(q AS varchar(20)) END AS period, 100000 - y * 10 - q AS row_ord,
            CASE WHEN k % 3 = 0 THEN price WHEN k % 3 = 1 THEN quantity ELSE n END AS amount
        FROM (SELECT o_custkey AS c, 'quarter' AS freq, extract(year FROM l_shipdate) AS y, extract(quarter FROM l_shipdate) AS q, cast(sum(cast(l_extendedprice AS decimal(18, 2))) AS double) AS price, cast(sum(cast(l_quantity AS decimal(18, 2))) AS double) AS quantity, cast(count(*) AS double) AS n
                FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY 1, 3, 4
              UNION ALL SELECT o_custkey, 'annual', extract(year FROM l_shipdate), 0, cast(sum(cast(l_extendedprice AS decimal(18, 2))) AS double), cast(sum(cast(l_quantity AS decimal(18, 2))) AS double), cast(count(*) AS double)
                FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY 1, 3) AS s
        CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) AS six)""",
    "profiles": """
        SELECT 'C' || cast(c_custkey AS varchar(20)) AS symbol, c_name AS name, c_mktsegment AS sector, n_name AS country FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "filings": """
        SELECT 'C' || cast(o_custkey AS varchar(20)) AS symbol,
            CASE o_orderkey % 10 WHEN 0 THEN '8-K' WHEN 1 THEN '8-K' WHEN 2 THEN '8-K' WHEN 3 THEN '6-K' WHEN 4 THEN '10-Q' WHEN 5 THEN '10-K' WHEN 6 THEN '20-F' WHEN 7 THEN '40-F' WHEN 8 THEN '4' ELSE 'SC 13G' END AS form,
            cast(cast(o_orderdate AS date) AS varchar(20)) AS filing_date, cast(cast(o_orderdate AS date) - 30 AS varchar(20)) AS report_date,
            CASE cast(floor(o_orderkey / 4) AS bigint) % 4 WHEN 0 THEN '2.02' WHEN 1 THEN '8.01' WHEN 2 THEN 'Results of operations for the quarter' ELSE '' END AS items,
            '0001-' || cast(o_orderkey AS varchar(20)) AS accession, 'doc' || cast(o_orderkey AS varchar(20)) || '.htm' AS primary_document,
            CASE o_orderkey % 3 WHEN 0 THEN 'Q' || cast(o_orderkey % 5 + 1 AS varchar(20)) || ' report' ELSE '' END AS primary_doc_description, o_orderkey AS row_ord FROM {orders}""",
    "ticker_map": """
        SELECT lower('C' || cast(c_custkey AS varchar(20))) AS ticker, c_custkey * 7 AS cik_int, c_name AS title, 0 AS row_ord FROM {customer} WHERE c_custkey % 17 <> 0
        UNION ALL SELECT 'C' || cast(c_custkey AS varchar(20)), c_custkey * 7 - 1, 'again', 1 FROM {customer} WHERE c_custkey % 31 = 0""",
    "filing_documents": """
        SELECT '0001-' || cast(l_orderkey AS varchar(20)) AS accession, o_custkey * 7 AS cik_int, 'doc' || cast(l_orderkey AS varchar(20)) || '.htm' AS primary_document,
            CASE l_linenumber WHEN 1 THEN 'doc' || cast(l_orderkey AS varchar(20)) || '.htm' WHEN 2 THEN 'ex99-1.htm' WHEN 3 THEN 'ex99-2.HTML' WHEN 4 THEN 'ex10-1.htm' WHEN 5 THEN 'chart.jpg' WHEN 6 THEN 'notes.txt' ELSE 'ex99.htm' END AS name,
            CASE l_linenumber WHEN 1 THEN '8-K' WHEN 2 THEN 'EX-99.1' WHEN 3 THEN 'EX-99.2' WHEN 4 THEN 'EX-10' ELSE '' END AS type,
            CASE l_linenumber WHEN 1 THEN 'FORM 8-K' WHEN 2 THEN 'Earnings press release' WHEN 3 THEN 'Slides' WHEN 4 THEN 'Credit Agreement' ELSE '' END AS description
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "releases": """
        SELECT source AS ticker, doc_id AS row_ord,
            CASE doc_id % 10 WHEN 0 THEN 'Acme reports ' || w || ' quarter ' || y || ' results' WHEN 1 THEN 'Acme announces ' || w || '-quarter fiscal ' || y || ' financial results' WHEN 2 THEN 'Lawsuit filed against Acme' WHEN 3 THEN 'Acme declares dividend'
                WHEN 4 THEN 'Acme Q' || q || ' FY' || y || ' earnings' WHEN 5 THEN '' WHEN 6 THEN 'Fiscal year ' || y || ' ' || w || ' quarter update' WHEN 7 THEN NULL ELSE 'Notes of the day' END AS title,
            CASE WHEN doc_id % 10 = 5 THEN 'Results for the quarter ended' END AS headline,
            CASE WHEN doc_id % 9 = 0 THEN 'soon' ELSE cast(date '2023-01-01' + cast(doc_id % 1000 AS int) AS varchar(20)) END AS published_date, CASE WHEN doc_id % 18 = 0 THEN 'later' ELSE cast(date '2024-01-01' + cast(doc_id % 300 AS int) AS varchar(20)) END AS date,
            CASE WHEN doc_id % 36 = 0 THEN '2025-02-03T10:00:00' END AS accepted_date, CASE WHEN doc_id % 20 = 7 THEN 'Subject: ' || w || ' quarter ' || y || ' earnings' END AS subject,
            CASE WHEN doc_id % 8 = 3 THEN text END AS content, CASE WHEN doc_id % 3 = 0 THEN 'Wire' END AS publisher,
            CASE doc_id % 6 WHEN 0 THEN 'https://www.prnewswire.com/r/' WHEN 1 THEN 'https://www.globenewswire.com/r/' WHEN 2 THEN 'https://www.sec.gov/r/' WHEN 3 THEN '' ELSE 'https://news.example.com/r/' END
                || CASE WHEN doc_id % 6 = 3 THEN '' ELSE cast(doc_id AS varchar(20)) END AS url,
            CASE WHEN doc_id % 12 = 3 THEN 'https://link.example.com/' || cast(doc_id AS varchar(20)) END AS link, CASE WHEN doc_id % 8 <> 3 THEN text END AS text, CASE WHEN doc_id % 2 = 0 THEN source END AS symbol, lang AS site
        FROM (SELECT doc_id, source, text, lang, CASE cast(floor(doc_id / 20) AS bigint) % 4 WHEN 0 THEN 'first' WHEN 1 THEN 'second' WHEN 2 THEN 'third' ELSE 'fourth' END AS w, cast(cast(floor(doc_id / 20) AS bigint) % 4 + 1 AS varchar(20)) AS q, cast(2023 + doc_id % 3 AS varchar(20)) AS y FROM {documents})""",
    "release_requests": """
        SELECT ticker, fiscal_year, quarter FROM (SELECT DISTINCT source AS ticker FROM {documents}) AS t
        CROSS JOIN (SELECT 2023 AS fiscal_year UNION ALL SELECT 2024 UNION ALL SELECT 2025) AS y CROSS JOIN (SELECT 1 AS quarter UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) AS q""",
    "table_pages": """
        SELECT page_id, url, replace(html, '</article>', '</p></li></div>' || CASE page_id % 6
                WHEN 0 THEN '<h2>Consolidated Statements of Operations</h2><table><tr><td></td><td>2025</td><td>2024</td></tr><tr><td></td><td></td><td></td></tr><tr><td>Assets</td><td></td><td></td></tr><tr><td>Revenue</td><td>$</td><td>' || cast(page_id AS varchar(20)) || '.5</td><td>$</td><td>9</td></tr><tr><td>Net income</td><td>2</td><td>1</td></tr></table>'
                WHEN 1 THEN '<h2>Condensed Consolidated Balance Sheets</h2><table><tr><td></td><td>March 31, 2025</td><td>December 31, 2024</td></tr><tr><td>Cash</td><td>5</td><td>5</td></tr><tr><td>Total</td><td>' || cast(page_id AS varchar(20)) || '.7</td><td>8</td><td>' || cast(page_id AS varchar(20)) || '.9</td></tr></table>'
                WHEN 2 THEN '<h2>Reconciliation of adjusted EBITDA</h2><table><tr><td>EBITDA</td><td>' || cast(page_id AS varchar(20)) || '.1</td></tr><tr><td>Taxes</td><td>nan</td><td>2</td></tr></table>'
                WHEN 3 THEN '<h2>Contacts</h2><table><tr><td>Media</td><td>press@example.com</td></tr><tr><td>Tel</td><td>1|2</td></tr></table>'
                WHEN 4 THEN '<h2>Overview ' || cast(page_id AS varchar(20)) || '</h2><table><tr><td>Revenue</td><td>' || cast(page_id AS varchar(20)) || '.3</td></tr></table>'
                WHEN 5 THEN '<h2>Facts</h2><table><tr><td>a</td><td>b' || cast(page_id AS varchar(20)) || '</td></tr><tr><td>A</td><td>a</td><td>b</td></tr></table>' END || '</article>') AS html FROM {pages}""",
}
#: Releases with what their pages are made of: k = 0 a table, 1 none, 2 a page too short, 3 a regulator's, 4 no page.
_PARTS = """SELECT doc_id, 'r' || cast(doc_id AS varchar(20)) AS release_id, source AS ticker, doc_id % 5 AS k, text,
        CASE WHEN doc_id % 5 = 3 THEN 'https://www.sec.gov/r/' WHEN doc_id % 2 = 0 THEN 'https://www.prnewswire.com/r/' ELSE 'https://news.example.com/r/' END || cast(doc_id AS varchar(20)) AS url,
        CASE doc_id % 7 WHEN 0 THEN 'Acme reports first quarter results' WHEN 1 THEN 'Consolidated Balance Sheets' WHEN 2 THEN 'Non-GAAP notes' ELSE 'Overview of the day' END AS head,
        CASE doc_id % 4 WHEN 0 THEN 'Total assets' WHEN 1 THEN 'Adjusted revenue' ELSE 'Units' END AS label, translate(coalesce(text, ''), '<>&', '   ') AS body,
        cast(doc_id AS varchar(20)) AS n, cast(doc_id + 1 AS varchar(20)) AS n1, 'Q' || cast(doc_id % 4 + 1 AS varchar(20)) || ' FY2025' AS period FROM {documents}"""
_EXHIBITS = """
        SELECT '0001-' || cast(l_orderkey AS varchar(20)) AS accession,
            CASE l_linenumber WHEN 1 THEN 'doc' || cast(l_orderkey AS varchar(20)) || '.htm' WHEN 2 THEN 'ex99-1.htm' WHEN 3 THEN 'ex99-2.HTML' WHEN 4 THEN 'ex10-1.htm' WHEN 5 THEN 'chart.jpg' WHEN 6 THEN 'notes.txt' ELSE 'ex99.htm' END AS name,
            CASE l_orderkey % 3 WHEN 0 THEN 'Financial results for the first quarter fiscal 2024: total revenue and net income. ' WHEN 1 THEN 'Repurchase program. ' ELSE 'Notes of the third quarter, guidance. ' END
                || CASE WHEN l_orderkey % 11 = 0 THEN 'The borrower agrees. ' ELSE '' END || repeat('Item ' || cast(l_partkey AS varchar(20)) || ' of cash flows ', 1 + cast(CASE WHEN l_orderkey % 16 = 0 THEN l_orderkey % 400 ELSE l_orderkey % 8 END AS int)) AS text,
            cast(l_orderkey % 5 AS int) AS n_tables FROM {lineitem}"""
#: Where the feed says that the release of a document lies.
_FEED_URL = """CASE doc_id % 6 WHEN 0 THEN 'https://www.prnewswire.com/r/' WHEN 1 THEN 'https://www.globenewswire.com/r/' WHEN 2 THEN 'https://www.sec.gov/r/' WHEN 3 THEN 'https://link.example.com/' ELSE 'https://news.example.com/r/' END || cast(doc_id AS varchar(20))"""
SHAPES |= {
    "release_parts": _PARTS,
    "release_pages": f"""
        SELECT url, CASE k WHEN 2 THEN '<p>short</p>' ELSE '<html><head><title>x</title></head><body><nav>menu</nav><article class="story"><h1>' || head || '</h1><p>' || body || '</p>'
            || CASE k WHEN 0 THEN '<table><tr><td></td><td>2025</td><td>2024</td></tr><tr><td>' || label || '</td><td>' || n || '</td><td>' || n1 || '</td></tr></table>' ELSE '' END
            || '<script>no</script><p>Closing words<p>View original content here</article><footer>' || repeat('end ', 90) || '</footer></body></html>' END AS html FROM ({_PARTS}) AS p WHERE k < 4""",
    "feed_pages": f"""
        SELECT url, CASE k WHEN 2 THEN '<p>short</p>' ELSE '<html><head><title>x</title></head><body><nav>menu</nav><article class="story"><h1>' || head || '</h1><p>' || body || '</p>'
            || CASE k WHEN 0 THEN '<table><tr><td></td><td>2025</td><td>2024</td></tr><tr><td>' || label || '</td><td>' || n || '</td><td>' || n1 || '</td></tr></table>' ELSE '' END
            || '<script>no</script><p>Closing words<p>View original content here</article><footer>' || repeat('end ', 90) || '</footer></body></html>' END AS html
        FROM (SELECT p.*, {_FEED_URL} AS url FROM (SELECT doc_id, k, head, label, body, n, n1 FROM ({_PARTS}) AS q) AS p) AS r WHERE k < 3""",
    "exhibit_contents": _EXHIBITS,
    "exhibit_pages": f"""
        SELECT accession, name, '<html><head><title>x</title></head><body><h1>Exhibit ' || name || '</h1><p>' || text || '</p>' || repeat('<table><tr><td>Revenue</td><td>2025</td><td>2024</td></tr><tr><td>Sales</td><td>$</td><td>5</td><td>4</td></tr></table>', n_tables)
            || '<ul><li>one item</li></ul><script>no</script><p>Closing words</p><p>Closing words</p></body></html>' AS html FROM (SELECT accession, name, min(text) AS text, min(n_tables) AS n_tables FROM ({_EXHIBITS}) AS e GROUP BY accession, name) AS one""",
    "exhibit_requests": """SELECT DISTINCT '0001-' || cast(l_orderkey AS varchar(20)) AS accession, cast(2024 AS int) AS fiscal_year, cast(l_orderkey % 4 + 1 AS int) AS quarter FROM {lineitem} WHERE l_orderkey % 13 <> 0""",
}
TABLES = ["conversations", "orders", "lineitem", "customer", "nation", "documents", "pages"]


#: Statement tables, with the sum that each shows.
_SHOWN = [("income_statement", "price"), ("balance_sheet", "quantity"), ("cash_flow_statement", "n"), ("key_metrics", "price"), ("ratios", "quantity"), ("financial_growth", "n")]


def _statement_sums(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """(symbol, freq, fiscal_year, period, row_ord, price, quantity, n), dealt by company while they are still lines of orders, which
    are joined once. Years are added up from quarters."""
    money = lambda c: F.col(c).cast("decimal(18, 2)")
    lines = lineitem.select("l_orderkey", F.year("l_shipdate").alias("y"), F.quarter("l_shipdate").alias("q"), money("l_extendedprice").alias("price"), money("l_quantity").alias("quantity"))
    owned = lines.join(orders.select("o_orderkey", F.col("o_custkey").alias("c")), F.col("l_orderkey") == F.col("o_orderkey"))
    # As many parts as asked: lines are small and their rows are not, so parts joined by the size of lines would be too large.
    parts = int(orders.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = owned.select(F.concat(F.lit("C"), F.col("c").cast("string")).alias("symbol"), "c", "y", "q", "price", "quantity").repartition(parts, "symbol")
    quarters = dealt.groupBy("symbol", "c", "y", "q").agg(F.sum("price").alias("price"), F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("n"))
    sums = [F.sum(c).alias(c) for c in ("price", "quantity", "n")]
    row = lambda freq, q: F.struct(F.lit(freq).alias("freq"), q.alias("q"), *[F.col(c).cast("double").alias(c) for c in ("price", "quantity", "n")])
    years = quarters.groupBy("symbol", "c", "y").agg(F.collect_list(row("quarter", F.col("q"))).alias("quarters"), *sums)
    each = years.select("symbol", "c", "y", F.inline(F.concat("quarters", F.array(row("annual", F.lit(0))))))
    q = F.col("q").cast("string")
    period = F.when(F.col("freq") == "annual", "FY").when(F.col("c") % 13 == 0, q).otherwise(F.concat(F.lit("Q"), q))
    return each.select("symbol", "freq", F.col("y").cast("string").alias("fiscal_year"), period.alias("period"), (100000 - F.col("y") * 10 - F.col("q")).alias("row_ord"), "price", "quantity", "n")


def statements(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """The rows of SHAPES["statements"]: the six tables are made where their company lies, so what ranks rows by company moves
    them no more."""
    six = F.inline(F.array(*[F.struct(F.lit(t).alias("table_name"), F.col(c).alias("amount")) for t, c in _SHOWN]))
    named = _statement_sums(lineitem, orders).select("symbol", "freq", "fiscal_year", "period", "row_ord", six)
    return named.select("symbol", "table_name", "freq", "fiscal_year", "period", "row_ord", "amount")


def _statement_payloads(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """(symbol, table_name, freq, payload): the rows of a company are put in order once and written for each of its six tables."""
    fields = ["row_ord", "fiscal_year", "period", "price", "quantity", "n"]
    rows = _statement_sums(lineitem, orders).groupBy("symbol", "freq").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("l"))
    freq = F.col("freq")
    shown = lambda c: F.to_json(F.transform("l", lambda x: F.struct(x["fiscal_year"].alias("calendarYear"), x["period"].alias("period"), x[c].alias("amount"), freq.alias("reportedCurrency"))))
    tables = F.inline_outer(F.array(*[F.struct(F.lit(t).alias("table_name"), shown(c).alias("payload")) for t, c in _SHOWN]))
    return rows.select("symbol", "freq", tables).select("symbol", "table_name", "freq", "payload")


def _accession(order: str) -> Column:
    return F.concat(F.lit("0001-"), F.col(order).cast("string"))


def _main_document(order: str) -> Column:
    return F.concat(F.lit("doc"), F.col(order).cast("string"), F.lit(".htm"))


def _by_line(first: Column, *others: str, rest: str) -> Column:
    """A value for each line number from 1 on, and one for any other."""
    out = F.when(F.col("l_linenumber") == 1, first)
    for k, value in enumerate(others, 2):
        out = out.when(F.col("l_linenumber") == k, value)
    return out.otherwise(rest)


def _document_name() -> Column:
    return _by_line(_main_document("l_orderkey"), "ex99-1.htm", "ex99-2.HTML", "ex10-1.htm", "chart.jpg", "notes.txt", rest="ex99.htm")


def filing_documents(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """The rows of SHAPES["filing_documents"]: lines meet their order by the filing's own key, so that what ranks documents by
    filing moves them no more."""
    lines = lineitem.select(_accession("l_orderkey").alias("accession"), "l_orderkey", "l_linenumber")
    owned = lines.join(orders.select(_accession("o_orderkey").alias("accession"), "o_custkey"), "accession")
    kind = _by_line(F.lit("8-K"), "EX-99.1", "EX-99.2", "EX-10", rest="")
    about = _by_line(F.lit("FORM 8-K"), "Earnings press release", "Slides", "Credit Agreement", rest="")
    return owned.select("accession", (F.col("o_custkey") * 7).alias("cik_int"), _main_document("l_orderkey").alias("primary_document"), _document_name().alias("name"), kind.alias("type"), about.alias("description"))


def exhibit_pages(lineitem: DataFrame) -> DataFrame:
    """The rows of SHAPES["exhibit_pages"], made once their lines are dealt and one is chosen of each page: texts of a page differ
    in the key of the part alone, so the least text is that of the least key as text."""
    one = lineitem.select(_accession("l_orderkey").alias("accession"), _document_name().alias("name"), "l_orderkey", F.col("l_partkey").cast("string").alias("part"))
    k = F.min("l_orderkey").alias("k")  # one for an accession
    one = one.groupBy("accession", "name").agg(k, F.min("part").alias("part"))
    text = F.expr("""CASE k % 3 WHEN 0 THEN 'Financial results for the first quarter fiscal 2024: total revenue and net income. ' WHEN 1 THEN 'Repurchase program. ' ELSE 'Notes of the third quarter, guidance. ' END
        || CASE WHEN k % 11 = 0 THEN 'The borrower agrees. ' ELSE '' END || repeat('Item ' || part || ' of cash flows ', 1 + cast(CASE WHEN k % 16 = 0 THEN k % 400 ELSE k % 8 END AS int))""")
    tables = F.expr("repeat('<table><tr><td>Revenue</td><td>2025</td><td>2024</td></tr><tr><td>Sales</td><td>$</td><td>5</td><td>4</td></tr></table>', cast(k % 5 AS int))")
    head, tail = F.concat(F.lit("<html><head><title>x</title></head><body><h1>Exhibit "), "name", F.lit("</h1><p>")), F.lit("<ul><li>one item</li></ul><script>no</script><p>Closing words</p><p>Closing words</p></body></html>")
    return one.select("accession", "name", F.concat(head, text, F.lit("</p>"), tables, tail).alias("html"))


def exhibit_requests(lineitem: DataFrame) -> DataFrame:
    """The rows of SHAPES["exhibit_requests"], one of a filing, dealt by it."""
    rows = lineitem.where("l_orderkey % 13 <> 0").select(_accession("l_orderkey").alias("accession"), F.lit(2024).alias("fiscal_year"), (F.col("l_orderkey") % 4 + 1).cast("int").alias("quarter"))
    return rows.groupBy("accession").agg(F.first("fiscal_year").alias("fiscal_year"), F.min("quarter").alias("quarter"))


#: Tables made for Spark otherwise than by their SQL.
MADE = {"statements": statements, "filing_documents": filing_documents, "exhibit_pages": exhibit_pages, "exhibit_requests": exhibit_requests}


def shaped(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table, from the driver's Parquet."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in SHAPES[name]}
    return MADE[name](**used) if name in MADE else spark.sql(SHAPES[name], **used)


def duckdb(name: str) -> str:
    """The same as a common table expression over the driver's views."""
    return f"{name} AS ({SHAPES[name].format(**{t: t for t in TABLES})})"


def payloads(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same tables as feeds would land them: JSON text, a list of objects or an object of arrays, in the order of rows."""
    listed = lambda keys, **fields: rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("row_ord", F.struct(*[F.col(c).alias(k) for k, c in fields.items()]).alias("o")))).alias("l"))
    if name == "statements":
        return _statement_payloads(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders")])
    rows = shaped(spark, sf_dir, name)
    if name == "transcript_dates":
        return listed(["symbol"], year="year", fiscalYear="fiscal_year", quarter="quarter", callDate="call_date").select("symbol", F.to_json("l.o").alias("payload"))
    if name == "filings":
        names = {"form": "form", "filingDate": "filing_date", "reportDate": "report_date", "items": "items", "accessionNumber": "accession", "primaryDocument": "primary_document", "primaryDocDescription": "primary_doc_description"}
        recent = F.struct(*[F.col(f"l.o.{k}").alias(k) for k in names])
        return listed(["symbol"], **names).select("symbol", F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings"), F.lit("10").alias("cik"))).alias("payload"))
    if name == "releases":
        names = {"title": "title", "headline": "headline", "subject": "subject", "publishedDate": "published_date", "date": "date", "acceptedDate": "accepted_date", "url": "url", "link": "link", "text": "text", "content": "content", "publisher": "publisher", "site": "site", "symbol": "symbol"}
        return listed(["ticker"], **names).select("ticker", F.to_json(F.struct(F.col("l.o").alias("data"))).alias("payload"))
    raise ValueError(name)
