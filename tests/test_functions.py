import pytest
from pyspark.sql import functions as F

from loam.functions.page import parse_page
from loam.functions.queryparse import parse_query
from loam.functions.robots import is_allowed, parse_robots
from loam.functions.stem import stem
from loam.functions.urls import absolute

R, O, X, P = "required", "optional", "excluded", "phrase"


@pytest.mark.parametrize(
    "query,expected",
    [
        ("rust web", [(R, "rust"), (R, "web")]),
        ("a OR b", [(O, "a"), (R, "b")]),
        ("a b OR c", [(R, "a"), (O, "b"), (R, "c")]),
        ("rust NOT java", [(R, "rust"), (X, "java")]),
        ("rust -java", [(R, "rust"), (X, "java")]),
        ('"exact phrase"', [(P, "exact"), (R, "phrase")]),
        ('"rust"', [(R, "rust")]),
        ('"a b c" d', [(P, "a b"), (R, "c"), (R, "d")]),
        ('-"foo bar"', [(P, "foo"), (X, "bar")]),
        ('"foo bar', [(P, "foo")]),
        ("a OR", [(R, "a")]),
        ("a OR ", [(O, "a")]),
        ("NOT OR x", [(X, "x")]),
        ("foo-bar", [(R, "foo-bar")]),
        ("", []),
    ],
)
def test_parse_query(query, expected):
    assert parse_query(query) == expected


@pytest.mark.parametrize("word,root", [("consistency", "consist"), ("consigned", "consign"), ("knightly", "knight"), ("knots", "knot"), ("ponies", "poni"), ("skies", "sky"), ("running", "run"), ("hoping", "hope"), ("national", "nation"), ("by", "by")])
def test_stem(word, root):
    assert stem(word) == root


def test_robots():
    g = parse_robots("User-agent: *\nDisallow: /admin\nDisallow: /private/\nAllow: /public\nUser-agent: Otherbot\nDisallow: /temp\n")
    assert not is_allowed(g, "/admin/x", "mybot") and is_allowed(g, "/public/y", "mybot") and is_allowed(g, "/admin", "Otherbot/2")
    assert not is_allowed(g, "/temp/1", "otherbot") and is_allowed([], "/x", "a")
    g = parse_robots("User-agent: *\nDisallow: /*.pdf$\nDisallow: /temp*\n# all\n")
    assert not is_allowed(g, "/a/b.pdf", "x") and not is_allowed(g, "/temporary", "x") and is_allowed(g, "/b.pdfx", "x")


def test_page():
    html = "<html><head><title>A  page</title><meta name='description' content='d'></head><body><nav>menu</nav><main><h1>Main</h1><p>text<div class='sidebar'>no</div><div style='display: none'>no</div><a href='https://x.org/1'>l</a><a href='/r'>r</a></main><footer>no</footer></body></html>"
    title, description, content, size, headings, links, count = parse_page(html)
    assert (title, description, content, headings, links) == ("A page", "d", "Main text l r", ["Main"], ["https://x.org/1"])
    assert size == len(content) and count == 4 and parse_page(None)[2] == ""


def test_absolute():
    assert absolute("http://a.org/x/", "é?q=1#f") == "http://a.org/x/%C3%A9?q=1#f"
    assert absolute("http://a.org/", "mailto:a@b.c") is None


def test_references_without_semicolon():
    html = "<title>a&amp b&ampc &copy; &#38;amp; x&y;&</title><article><a href='/q?a=1&lt=2'>&lt &lt;</a></article>"
    assert parse_page(html)[0] == "a& b&c © &amp; x&y;&" and parse_page(html)[2] == "< <"
    assert parse_page(html, bare=False)[0] == "a&amp b&ampc © &amp; x&y;&" and parse_page(html, bare=False)[2] == "&lt <"


def test_page_queries_follow_their_sql(spark, tmp_path):
    import duckdb

    from loam.plans import catalogue

    html = "<html><head><title>One &amp; two&amp</title></head><body><article><h1>x&amp</h1><p>y &quot;z&quot; &amp w" + " v" * 60 + "</p></article></body></html>"
    spark.createDataFrame([(1, "https://a.org/", html), (2, "https://a.org/2", "short")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("html_parse", "html_counts"):
        assert [tuple(r) for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()] == con.sql(catalogue.ORACLES[name]).fetchall()


def test_pages_go_to_python_by_few(spark):
    from loam.operators import crawl

    pages = spark.range(2000).select(F.col("id").alias("page_id"), F.lit("https://a.org/").alias("url"), F.lit("<a href='/x'>x</a>" + "y" * 200).alias("html"))
    for rows in (crawl.parse_pages(pages), crawl.links_of(pages)):
        assert "ArrowEvalPython" not in rows._jdf.queryExecution().executedPlan().toString()
