import random

from pyspark.sql import functions as F

from quarterweave.functions.text import filing_text
from quarterweave.operators import html, tables


def parsed(spark, *pages):
    return html.parse_pages(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string"))


def sections(spark, page):
    return [(r.kind, r.text, r.rows) for r in html.html_sections(parsed(spark, page)).orderBy("pos").collect()]


def body(spark, rows):
    page = "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"
    return tables.page_tables(parsed(spark, page)).first()


def test_release_page(spark):
    page = "<h1>Acme reports results</h1><p>Revenue rose.</p><table><tr><th>Metric</th><th>Q1</th></tr><tr><td>Revenue</td><td>$10</td></tr></table>"
    assert sections(spark, page) == [("heading", "Acme reports results", None), ("paragraph", "Revenue rose.", None), ("table", None, [["Metric", "Q1"], ["Revenue", "$10"]])]


def test_odd_pages(spark):
    assert sections(spark, None) == sections(spark, "") == []
    assert sections(spark, "<!-- note --><script>'<p>x</p>'</script><p>a<b>b</p><p>a b</p><li>c") == [("paragraph", "a b", None)]
    assert sections(spark, "<p>open <h2>head</h2> still</p>") == [("paragraph", "open head still", None)]
    nested = "<table><tr><td>out<table><tr><td>in</td></tr></table></td><td>x</td></tr><tr><td></td></tr></table><table></table>"
    assert sections(spark, nested) == [("table", None, [["in"]]), ("table", None, [["out", "x"]])]
    assert parsed(spark, "<p>fine</p>", "<![bad[").count() == 2


def test_plain_pages_read_as_by_the_tokeniser():
    draw, own = random.Random(7), 0
    tags = ["p", "div", "h1", "li", "b", "table", "tr", "td", "P", "br"]
    odd = ["&amp;", "&nbsp", "a < b", "a > b", "<br/>", "<!-- x -->", "<p", "</p >", '<p class="x y">', "<p id=x>", "<script>if (a<b) x</script>", "<script>no</script>", "<style>", "<title>T &lt; U</title>", "<title><b>t</title>", "&"]
    for _ in range(3000):
        page = "".join(draw.choice(odd) if draw.random() < 0.04 else draw.choice([f"<{draw.choice(tags)}>", f"</{draw.choice(tags)}>", "word ", " ", "\n", "x"]) for _ in range(draw.randrange(30)))
        quick, plain = html._read(page), html._Sections()
        plain.feed(page)
        assert quick == (plain.found, None, "".join(plain.text)), page
        own += html._plain(page) is not None
    assert 1000 < own < 2900  # both ways are taken


def test_rows_are_compacted_and_fitted(spark):
    got = body(spark, [["", "2025", "2024"], ["Assets"], ["Cash", "$", "5", "$", "6"], ["Debt", "7"], ["Sum", "1", "2", "3"], ["years ended"]])
    assert got.headers == ["2025", "2024"]
    assert got.body == [["Assets", "", ""], ["Cash", "$5", "$6"], ["Debt", "7", ""], ["Sum", "1", "2 3"]]
    assert body(spark, [["a", "A", "nan", "b"], ["$", "€", "3"], ["5", "$"]]).body == [["a", "b"], ["$€", "3"], ["5", "$"]]


def test_classes_titles_and_markdown(spark):
    page = "<h2>Adjusted EBITDA</h2><p>" + "long " * 60 + "</p><table><tr><td>x|y</td><td>1</td></tr></table><p>Table 2</p><table><tr><td>Investors</td></tr></table>"
    all_ = tables.page_tables(parsed(spark, page, "<p>none</p>"))
    assert [(r.title, r["class"]) for r in all_.orderBy("table_no").collect()] == [("Adjusted EBITDA", "non_gaap"), ("Table 2", "contact")]
    lines = [(r.heading, r.markdown) for r in tables.table_markdown(all_).orderBy("table_no").collect()]
    assert lines == [("## Non-GAAP Table 1: Adjusted EBITDA", "|Item|Value 1|\n|-|-:|\n|x\\|y|1|"), ("## Contact Table 2", "|Item|\n|-|\n|Investors|")]


def test_counts_cover_pages_without_tables(spark):
    got = tables.table_counts(parsed(spark, "<table><tr><td>EBITDA</td></tr></table>", "<p>x</p>", None)).orderBy("page_id").collect()
    assert [(r.total, r.non_gaap, r.other) for r in got] == [(1, 1, 0), (0, 0, 0), (0, 0, 0)]
    assert tables.table_counts(parsed(spark, "x").where(F.lit(False))).count() == 0


def test_texts_and_tables_without_sections(spark):
    """Text and number of tables as the sections' reader has them, tidied as `filing_text` does, terms and words counted in it."""
    draw, own, pages = random.Random(11), 0, [None, "", "<![bad[", "a<p", "no tag &amp; end", "&", "<title>a</title>&amp;", "x" * 300 + "<p " + 'class="y" ' * 40 + ">z"]
    tags = ["p", "div", "h1", "h4", "li", "b", "table", "tr", "td", "th", "P", "br", "head", "TABLE", "style", "script", "title", "Script"]
    odd = ["&amp;", "&nbsp", "&#8203;", "a < b", "a > b", "<br/>", "<!-- x -->", "<p", '<p class="x y">', "<p id=x>", "<script>if (a<b) x</script>", "<script>no</script>", "<title>T &lt; U</title>", "<title><b>t</title>", "\u200b", "\xa0", "\t", "\x0b \f\r", " \n ", "\n\n\n\n", "\u2028", "<table><tr><td>x</td></tr></table>", "Net  Income", "\u212aey"]
    for _ in range(3000):
        pages.append("".join(draw.choice(odd) if draw.random() < 0.1 else draw.choice([f"<{draw.choice(tags)}>", f"</{draw.choice(tags)}>", "word ", " ", "\n", "x"]) for _ in range(draw.randrange(40))))
        quick = html._plain_text(pages[-1])
        assert (quick is None) == (html._plain(pages[-1]) is None), pages[-1]
        own += quick is not None
    assert 500 < own < 2900  # both ways are taken
    rows = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    tables = F.coalesce(F.size(F.filter("sections", lambda s: s["kind"] == "table")), F.lit(0))
    slow = html.parse_pages(rows, with_text=True).select("page_id", filing_text(F.col("text")).alias("text"), tables.alias("n_tables"))
    want = {r.page_id: (r.text, r.n_tables) for r in slow.collect()}
    got = html.page_texts(rows, ["page_id"], "net income|key", {"held": ["xword", "x."]}).collect()
    assert {r.page_id: (r.text, r.n_tables) for r in got} == want and max(n for _, n in want.values()) > 1
    low = lambda t: t.translate(str.maketrans("NICKEY", "nickey"))
    assert all((r.n_terms, r.held) == (low(r.text).count("net income"), "xword" in r.text or "x." in r.text) for r in got) and any(r.n_terms for r in got) and any(r.held for r in got)
