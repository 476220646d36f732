import math

import pytest
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.functions import urls as U
from loam.functions import vectors as V
from loam.operators import cache, crawl, suggest, vector
from loam.operators import index as ix
from loam.operators import search as se
from loam.operators.pagerank import pagerank


@pytest.fixture(scope="module")
def small(spark):
    rows = [(0, "https://a.org/x/1", "Alpha title", "alpha beta beta", [], 3), (1, "https://a.org/x/2", "Other", "beta gamma delta", ["Alpha"], 3), (2, "https://b.org/x/3", "Third", "gamma gamma", [], 2), (3, "https://b.org/x/4", "Fourth", "", [], 0)]
    return ix.build(spark.createDataFrame(rows, "doc_id long, url string, title string, content string, headings array<string>, word_count int"))


def test_bm25_by_hand(small):
    got = {r.doc_id: r.score for r in se.search(small, [(0, "beta")]).collect()}
    n, df, average = 4, 2, (3 + 3 + 2) / 3
    idf = math.log((n - df + 0.5) / (df + 0.5) + 1)
    for doc, tf, length in ((0, 2, 3), (1, 1, 3)):
        assert got[doc] == pytest.approx(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / average)))
    assert len(got) == 2


def test_required_excluded_fuzzy(small):
    ids = lambda q: sorted(r.doc_id for r in se.search(small, [(0, q)]).collect())
    assert ids("beta alpha") == [0, 1] and ids("gamma -delta") == [2] and ids("-gamma") == [] and ids("") == []
    assert ids("gamna") == [1, 2] and ids("beta OR gamma") == [1, 2] and ids("beta unknownword") == [0, 1]


def test_upsert_and_remove(spark, small):
    new = spark.createDataFrame([("https://a.org/x/1", "Alpha title", "changed words", [], 2, 0), ("https://b.org/x/3", "Third", "gamma gamma", [], 2, 1), ("https://c.org/x/9", "New", "fresh", [], 1, 2)], "url string, title string, content string, headings array<string>, word_count int, seq int")
    merged, summary = ix.upsert(small, new)
    assert tuple(summary.first()) == (3, 1, 1, 1)
    assert {r.url: r.doc_id for r in merged.documents.collect()}["https://c.org/x/9"] == 4
    assert [r.doc_id for r in se.search(merged, [(0, "fresh")], fuzzy=False).collect()] == [4]
    gone = ix.remove(merged, spark.createDataFrame([("https://c.org/x/9",)], "url string"))
    assert se.search(gone, [(0, "fresh")], fuzzy=False).count() == 0 and gone.stats().first().total_docs == 4


def test_pagerank(spark):
    edges = lambda rows: spark.createDataFrame(rows, "from_url string, to_url string")
    cycle = {r.url: r.score for r in pagerank(edges([("a", "b"), ("b", "c"), ("c", "a")])).collect()}
    assert all(v == pytest.approx(1 / 3) for v in cycle.values())
    star = {r.url: r.score for r in pagerank(edges([("a", "z"), ("b", "z"), ("b", "z")])).collect()}
    assert star["z"] > star["a"] == star["b"] and sum(star.values()) == pytest.approx(1)
    assert pagerank(edges([]) if False else edges([("a", "b")]).limit(0)).count() == 0


def test_pagerank_of_unique_links(spark):
    edges = spark.createDataFrame([("a", "z"), ("b", "z"), ("z", "a"), (None, "a")], "from_url string, to_url string")
    ranks = lambda rows, **how: {r.url: round(r.score, 12) for r in pagerank(rows, **how).collect()}
    assert ranks(edges, unique=True) == ranks(edges.union(edges)) and set(ranks(edges, unique=True)) == {"a", "b", "z"}


def test_urls(spark):
    rows = spark.createDataFrame([("https://Example.COM/path/",), ("https://example.com/Path#f",), ("https://example.com/",), ("https://example.com//?Q=1",), ("nonsense",)], "u string")
    assert [r[0] for r in rows.select(U.normalize_url(F.col("u"))).collect()] == ["https://example.com/path", "https://example.com/path", "https://example.com/", "https://example.com/?Q=1", None]


def test_rate_limits(spark):
    log = lambda d, codes: [(d, i, i, c) for i, c in enumerate(codes)]
    rows = log("a", [403, 429, 200, 200, 200, 200]) + log("b", [503] * 20) + log("c", [404, 200])
    got = {r.domain: (r.delay, r.error_count) for r in crawl.rate_limits(spark.createDataFrame(rows, "domain string, at long, seq int, status int")).collect()}
    assert got == {"a": (100, 0), "b": (10_000, 20), "c": (100, 0)}


def test_vectors(spark):
    rows = [(i, [1.0, i * 1e-4, 0.0, 0.0]) for i in range(300)] + [(300 + i, [0.0, 1.0, i * 1e-4, 0.0]) for i in range(300)]
    v = vector.signed(spark.createDataFrame(rows, "doc_id int, embedding array<float>"), V.hyperplanes(4))
    q = [1.0, 0.01, 0.0, 0.0]
    assert vector.exact(v, q, 5).first().doc_id == vector.approximate(v, q, 5, V.hyperplanes(4)).first().doc_id
    assert vector.summary(v, 4).first().num_vectors == 600


def test_cache_and_words(spark):
    c = spark.createDataFrame([("a", 0, 1), ("b", 0, 2)], "key string, timestamp long, used int")
    put = cache.put(c, spark.createDataFrame([("c", 5, 3)], "key string, timestamp long, used int"), 2)
    assert sorted(r.key for r in put.collect()) == ["b", "c"]
    assert cache.cleanup(c, F.lit(604_801)).count() == 0 and cache.cleanup(c, F.lit(604_800)).count() == 2
    t = spark.createDataFrame([("Foo-bar, éta_9 the éa ab",)], "t string").select(T.tokens(F.col("t"))).first()[0]
    assert t == ["foo", "bar", "éta", "éa"]
    q = spark.createDataFrame([("internet security",)], "query string").select(suggest.expand(F.col("query"))).first()[0]
    assert "OR web" in q and "OR secure" in q


def test_snippet(spark):
    for n, cut in ((0, False), (1, False), (40, False), (41, True)):
        s = spark.createDataFrame([(" ".join(f"w{i}" for i in range(n)),)], "c string").select(T.snippet(F.col("c"), F.array(F.lit("w0")))).first()[0]
        assert s.endswith("...") == cut and s.startswith("**w0**") == (n > 0)
