"""Sources, sinks, streams, the service and the command line, round trip by round trip."""

import json
import threading
import urllib.request

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam import cli, server
from loam.functions import text as T
from loam.operators import crawl
from loam.operators import index as ix
from loam.operators import search as se
from loam.operators.common import numbered
from loam.service import Service
from loam.sources import embedders, fetch, files, jsonl, lists, tables, vectorfile
from loam.streaming import incremental
from loam.streaming.crawler import Crawl, Progress

SMALL = "/root/testdata"


def page(url, title, content):
    return json.dumps({"url": url, "title": title, "meta_description": "", "content": content, "content_length": len(content), "headings": [], "links": [], "word_count": len(content.split())}, ensure_ascii=False)


def test_lines_over_splits(spark, tmp_path):
    p = tmp_path / "x"
    p.write_bytes("é1\n\n333\nlast".encode())
    for step in (1, 2, 3, 5, 100):
        assert [tuple(r) for r in files.lines(spark, str(p), step=step).orderBy("at").collect()] == [(0, 4, "é1"), (4, 5, ""), (5, 9, "333"), (9, 13, "last")]
    assert [r.line for r in files.lines(spark, str(p), 5).collect()] == ["333", "last"]


def test_incremental_file_holds_no_whole_file(spark, monkeypatch):
    from loam.plans import stored

    whole = files.read_whole
    monkeypatch.setattr(files, "read_whole", lambda path: whole(path) if path.endswith((".json", "CURRENT", "META")) and "part-" not in path else pytest.fail(f"{path} is read as a whole"))
    assert [tuple(r)[1:] for r in stored.incremental_file(spark, f"{SMALL}/sf0.001").orderBy("run").collect()][2:] == [(2, 1, 1, 0), (0, 0, 0, 0)]


def test_write_joined(spark, tmp_path):
    for name, data in (("a", b"x" * 9 + b"\n"), ("b", b""), ("c", "é".encode())):
        (tmp_path / name).write_bytes(data)
    path = str(tmp_path / "all")
    files.write_joined(path, [str(tmp_path / "a"), str(tmp_path / "b"), b"1\n", str(tmp_path / "c")])
    files.write_joined(path, [path, b"2"])
    assert files.read_whole(path) == b"x" * 9 + "\n1\né2".encode() and len(list(tmp_path.iterdir())) == 4


def test_one_file_of_several_tasks(spark, tmp_path):
    from loam.plans import stored

    rows = spark.range(0, 500, 1, 4).select((499 - F.col("id")).alias("doc_id"), F.concat(F.lit("u/"), (499 - F.col("id")).cast("string")).alias("url"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        file = stored.in_one_file(rows, f"{tmp_path}/parts", f"{tmp_path}/all")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(files.listed(f"{tmp_path}/parts")) == 4 and [r.url for r in jsonl.tail(spark, file).orderBy("seq").collect()] == [f"u/{i}" for i in range(500)]


def test_jsonl(spark, tmp_path):
    p = tmp_path / "pages.jsonl"
    p.write_text("\n".join([page("u/1", "One", "alpha β"), "", page("u/2", "Two", "gamma")]) + "\n", encoding="utf-8")
    assert sorted(r.title for r in jsonl.read(spark, str(p)).collect()) == ["One", "Two"] and jsonl.read(spark, str(p), 1).count() == 1
    assert [r.title for r in jsonl.tail(spark, str(p)).orderBy("seq").collect()] == ["One", "Two"]
    p.write_text("{broken\n")
    with pytest.raises(Exception):
        jsonl.read(spark, str(p)).collect()
    with pytest.raises(Exception):
        jsonl.tail(spark, str(p)).collect()


def test_vector_file(spark, tmp_path):
    rows = spark.createDataFrame([(7, [1.0, -0.5, 3.25]), (9, [0.0, 2.0, 4.0]), (11, None)], "doc_id long, embedding array<float>")
    assert vectorfile.write(rows, f"{tmp_path}/v") == 2
    assert sorted(map(tuple, vectorfile.read(spark, f"{tmp_path}/v").collect())) == [(7, [1.0, -0.5, 3.25]), (9, [0.0, 2.0, 4.0])]
    assert vectorfile.write(rows.where("doc_id = 7"), f"{tmp_path}/v") == 1 and vectorfile.read(spark, f"{tmp_path}/v").count() == 1  # written anew
    one = tmp_path / "one.bin"
    one.write_bytes(np.array([1, 2], "<u4").tobytes() + np.array([1, 2], "<f4").tobytes())
    assert vectorfile.read(spark, str(one)).first().embedding == [1.0, 2.0]
    one.write_bytes(one.read_bytes() + np.array([2, 1], "<u4").tobytes() + np.array([1], "<f4").tobytes())
    with pytest.raises(Exception):
        vectorfile.read(spark, str(one)).collect()
    (tmp_path / "none").mkdir()
    assert vectorfile.read(spark, f"{tmp_path}/none").count() == 0


def test_embedders(spark):
    e = embedders.HashingEmbedder(16)
    rows = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "alpha beta")], "doc_id long, text string")
    got = {r.doc_id: r.embedding for r in embedders.embed(rows, e).collect()}
    assert got[1] == got[3] and got[2] == [0.0] * 16 and sum(x * x for x in got[1]) == pytest.approx(1)
    assert embedders.prepared("é" * 1500) == "é" * 1000 and embedders.prepared(" " + "x" * 1998 + "é") == "x" * 1998 and embedders.prepared(None) == ""
    assert embedders.embed_texts([None, " "], e) == [[0.0] * 16] * 2
    assert embedders.answered({"data": [{"e": [1]}, {"e": [2]}]}, ("data", "*", "e")) == [[1], [2]]

    class Short:
        dimension = 2

        def embed_batch(self, texts):
            return []

    with pytest.raises(ValueError):
        embedders.embed_texts(["x"], Short())


def test_embedding_text(spark):
    cases = ["é" * 1500, "x" * 3000, "a" + "é" * 1500, "ab" + "€" * 900, "abc" + "😀" * 700, "short", ""]
    got = [r.t for r in spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string").orderBy("i").select(T.embedding_text(F.lit("T"), F.col("c")).alias("t")).collect()]
    assert got == [embedders.prepared(f"T {c}"[:2000]) for c in cases]


def test_lists(spark, tmp_path):
    (tmp_path / "seeds").write_text("# no\n\n  https://a.org/x \nhttps://b.org\n")
    assert [r.url for r in lists.read_seeds(spark, f"{tmp_path}/seeds").collect()] == ["https://a.org/x", "https://b.org"]
    urls = spark.createDataFrame([("https://a.org/private/x",), ("https://a.org/y",), ("https://b.org/private/x",), ("https://c.org/private/x",)], "url string")
    robots = spark.createDataFrame([("https://a.org/robots.txt", "User-agent: *\nDisallow: /private/"), ("https://c.org/robots.txt", None)], "robots_url string, body string")
    assert sorted(r.url for r in lists.allowed(urls, robots, "loam").collect()) == ["https://a.org/y", "https://b.org/private/x", "https://c.org/private/x"]


def test_fetch(spark, tmp_path):
    marks = str(tmp_path)

    def get(url):
        import os

        if url == "flaky" and not os.path.exists(f"{marks}/tried"):
            open(f"{marks}/tried", "w").close()
            raise OSError("once")
        if url == "dead":
            raise OSError("always")
        return (404, "") if url == "gone" else (200, f"<p>{url}</p>")

    got = {r.url: r for r in fetch.fetch(spark.createDataFrame([("ok",), ("flaky",), ("dead",), ("gone",)], "url string").coalesce(1), get, pause=0, clock=lambda: 5).collect()}
    assert [got[u].status_code for u in ("ok", "flaky", "dead", "gone")] == [200, 200, 500, 404] and got["dead"].html_content is None and got["ok"].crawled_at == 5


def test_tables_and_state(spark, tmp_path):
    tables.log_query(spark, f"{tmp_path}/log", "q", 2, 1.0, "fulltext", now=3)
    tables.log_query(spark, f"{tmp_path}/log", "q", 0, 2.0, "vector", now=4)
    assert sorted(map(tuple, tables.read_log(spark, f"{tmp_path}/log").collect())) == [("q", 3, 2, 1.0, "fulltext"), ("q", 4, 0, 2.0, "vector")]
    s = tables.load_state(f"{tmp_path}/s.json", "a")
    s.byte_offset, s.total_updates = 9, 4
    tables.save_state(s, f"{tmp_path}/s.json")
    assert tables.load_state(f"{tmp_path}/s.json", "a").byte_offset == 9
    other = tables.load_state(f"{tmp_path}/s.json", "b")
    assert (other.byte_offset, other.total_updates) == (0, 4)


def test_incremental(spark, tmp_path):
    p, root, state = tmp_path / "pages.jsonl", f"{tmp_path}/index", f"{tmp_path}/state.json"
    go = lambda limit=None: incremental.run(spark, str(p), root, state, limit)
    p.write_text(page("/1", "One", "alpha beta gamma") + "\n" + page("/2", "Two", "delta epsilon zeta") + "\n")
    first = go()
    assert (first.processed_lines, first.new_documents, first.total_documents, first.final_offset) == (2, 2, 2, p.stat().st_size)
    with p.open("a") as f:
        f.write(page("/2", "Two", "delta changed zeta") + "\n" + page("/3", "Three", "document text") + "\n")
    second = go()
    assert (second.processed_lines, second.new_documents, second.updated_documents, second.total_documents) == (2, 1, 1, 3)
    ids = lambda q: {r.doc_id for r in se.search(ix.Index.load_current(spark, root), [(0, q)], fuzzy=False).collect()}
    assert ids("document") == {2} and ids("epsilon") == set()
    p.write_text(page("/2", "Two", "beta theta") + "\n")  # shorter: read anew into a new index
    third = go()
    assert (third.processed_lines, third.new_documents, third.total_documents) == (1, 1, 1) and ids("alpha") == set()


def test_upsert_of_repeats(spark):
    rows = lambda *r: spark.createDataFrame([(u, "t", c, [], 1, i) for i, (u, c) in enumerate(r)], "url string, title string, content string, headings array<string>, word_count int, seq int")
    index = ix.upsert(ix.Index.empty(spark), rows(("u0", "same")))[0]
    merged, summary = ix.upsert(index, rows(("u1", "one"), ("u1", "two"), ("u0", "same"), ("u2", "x"), ("u1", "two")))
    assert tuple(summary.first()) == (5, 2, 1, 2)
    assert {r.url: (r.doc_id, r.content) for r in merged.documents.collect()} == {"u0": (0, "same"), "u1": (1, "two"), "u2": (2, "x")}


def test_numbered(spark):
    rows = spark.range(1000).select((1000 - F.col("id")).alias("v"))
    assert all(r.v - 1 == r.number for r in numbered(rows, "v").collect())


def some_pages(spark, n=40):
    rows = [(i, f"https://h{i}.org/nations/{i}", f"Thing {i}", "running runs things " * (i % 4 + 1) + f"word{i} nation", ["Heads run"], 3) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, url string, title string, content string, headings array<string>, word_count int")


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_stems_are_counted_in_place(spark):
    from loam.functions.stem import stem

    docs = ix.prepare(some_pages(spark))
    stemmed = ix.postings(docs, stem=True)
    assert "Exchange" not in plan(stemmed)
    want = {}
    for r in ix.postings(docs).collect():
        at = want.setdefault((stem(r.term), r.doc_id), [[0] * 4, r.doc_length])
        at[0] = [a + r[f] for a, f in zip(at[0], ix.FIELDS)]
    assert {(r.term, r.doc_id): [[r[f] for f in ix.FIELDS], r.doc_length] for r in stemmed.collect()} == want


def test_search_counts_only_its_words(spark):
    from loam.plans import catalogue

    index = catalogue.index_of(spark, f"{SMALL}/sf0.001")
    assert not index.postings.is_cached and not index.documents.is_cached
    asked = plan(index.postings.where(F.col("term").isin("with", "that")))
    assert asked.index("Exchange") < asked.rindex("IN (with,that)") if "IN (with,that)" in asked else asked.index("Exchange") < asked.rindex("INSET")
    counted = lambda rows: {tuple(r) for r in rows.select("term", "df").collect()}
    assert counted(index.terms()) == counted(index.postings.groupBy("term").agg(F.count("*").alias("df")))


def test_all_postings_move_documents_only(spark):
    index = ix.build(some_pages(spark), allow_duplicates=True)
    for rows in (index.all_postings(), index.all_postings(shard=ix.shard_of(F.col("url"), 3))):
        assert plan(rows).count("Exchange") == 1 and "Join" not in plan(rows)
    assert sorted(map(tuple, index.all_postings().collect())) == sorted(map(tuple, index.postings.collect()))


def test_upsert_keeps_what_lies_sorted(spark, tmp_path):
    pages = some_pages(spark).withColumn("seq", F.col("doc_id"))
    root = str(tmp_path)
    ix.upsert(ix.Index.empty(spark), pages.where("doc_id < 20"))[0].save_version(root)
    for part in ("doc_id >= 20 and doc_id < 30", "doc_id >= 30"):
        merged, _ = ix.upsert(ix.Index.load_current(spark, root), pages.where(part))
        assert "Exchange" not in plan(merged.parts[0]) and "Join" not in plan(merged.parts[0])
        merged.save_version(root)
    changed = pages.where("doc_id in (3, 25)").withColumn("content", F.lit("other words"))
    merged, _ = ix.upsert(ix.upsert(ix.Index.load_current(spark, root), changed)[0], pages.where("doc_id = 3"))
    merged.save_version(root)
    rows = lambda i: sorted(tuple(r) for r in i.all_postings().select("term", "doc_id", *ix.FIELDS, "doc_length").collect())
    now = pages.withColumn("content", F.when(F.col("doc_id") == 25, "other words").otherwise(F.col("content")))
    assert rows(ix.Index.load_current(spark, root)) == rows(ix.build(now, allow_duplicates=True))


def test_shards(spark, tmp_path):
    docs = [(i, f"https://h{i}.org/x/{i}", f"Title {i}", "alpha " * (i % 5 + 1) + "beta", [], 3) for i in range(20)]
    pages = spark.createDataFrame(docs, "doc_id long, url string, title string, content string, headings array<string>, word_count int")
    ix.save_shards(ix.build(pages.where("doc_id < 15")), str(tmp_path), 3)
    ix.add_to_shards(spark, ix.prepare(pages.where("doc_id >= 15")), str(tmp_path))
    index, shards = ix.load_shards(spark, str(tmp_path))
    assert shards == 3 and index.documents.count() == 20
    got = se.search(index, [(0, "alpha")], shards=shards).collect()
    whole = ix.build(pages)
    assert len(got) == 20 and [tuple(r) for r in got] == [tuple(r) for r in se.search_shards(whole, ix.shard_of(F.col("url"), 3), 3, [(0, "alpha")]).collect()]
    assert ix.sharded_totals(whole, 3).first().total_docs == 20


def test_crawl(spark, tmp_path):
    web = {"https://a.org/": '<a href="/b">b</a><a href="/private/c">c</a>' + "x" * 100, "https://a.org/b": '<a href="/">a</a>' + "y" * 100, "https://a.org/private/c": "z" * 100}
    robots = spark.createDataFrame([("https://a.org/robots.txt", "User-agent: *\nDisallow: /private/")], "robots_url string, body string")
    c = Crawl(spark, str(tmp_path), lambda u: (200, web[u]) if u in web else (500, ""), robots=robots, pause=0)
    c.seed(spark.createDataFrame([("https://a.org",), ("https://dead.org/",)], "url string"))
    assert c.step(10, 1000) == 2
    c = Crawl(spark, str(tmp_path), c.get, robots=robots, pause=0)  # taken up again from what is stored
    c.run(10, 10, now=lambda: 2000)
    assert {r.url for r in c.table("pages").collect()} == {"https://a.org/", "https://a.org/b"}
    assert {(r.from_url, r.to_url) for r in c.table("links").collect()} == {("https://a.org/", "https://a.org/b"), ("https://a.org/", "https://a.org/private/c"), ("https://a.org/b", "https://a.org/")}
    assert {r.domain: (r.error_count, r.rate_limit_delay) for r in c.table("crawl_state").collect()} == {"a.org": (0, 100), "dead.org": (1, 200)} and c.table("crawl_queue").count() == 0


def test_progress():
    p = Progress(interval=100, started=0)
    p.count(success=99, errors=1)
    assert not p.due() and p.eta(198, 9) == pytest.approx(9) and Progress(started=0).eta(5, 1) is None
    p.count(success=1)
    assert p.due()
    p.reset()
    assert not p.due() and p.rate(10) == 10


def test_rate_state():
    seen, state = [], (0, 100)
    for status in (403, 429, 200, 200, 200, 200):
        state = crawl.after(*state, status)
        seen.append(state[1])
    assert seen == [200, 400, 400, 200, 100, 100] and crawl.after(3, 800, 404) == (3, 800) and crawl.after(9, 10_000, 503) == (10, 10_000)


def test_command_line_and_server(spark, tmp_path):
    p = tmp_path / "pages.jsonl"
    p.write_text("\n".join([page("https://a.org/1", "Alpha page", "alpha words here"), page("https://b.org/2", "Beta page", "beta words and alpha")]) + "\n")
    said = []
    run = lambda *argv, **more: cli.main([str(a) for a in argv], spark, said.append, **more)
    run("index", "--input", p, "--index", tmp_path / "index")
    run("embed", "--input", p, "--output", tmp_path / "vectors", "--dimension", 32, "--summary", tmp_path / "summary.json")
    assert json.loads((tmp_path / "summary.json").read_text())["num_vectors"] == 2
    said.clear()
    run("search", "--index", tmp_path / "index", "--log", tmp_path / "log", lines=["alpha", "", "  ", "exit", "beta"])
    assert "Alpha page" in said[0] and len(said) == 1 and tables.read_log(spark, f"{tmp_path}/log").count() == 1
    said.clear()
    run("search", "--index", tmp_path / "index", "--suggest", "al")
    assert said == ["alpha (2)\n"]
    service = Service.load(spark, f"{tmp_path}/index", vectorfile.read(spark, f"{tmp_path}/vectors"), embedder=embedders.HashingEmbedder(32), cache_size=2)
    assert service.search("beta words", "vector", 1)[0]["title"] == "Beta page"
    assert [r["title"] for r in service.search("alpha", "hybrid", domain="b.org")] == ["Beta page"]
    assert service.search("ALPHA") == service.search("alpha") and len(service._cache) == 2
    with pytest.raises(ValueError):
        service.search("  ")
    web = server.serve(service, port=0)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    ask = lambda path: json.load(urllib.request.urlopen(f"http://127.0.0.1:{web.server_port}{path}"))
    assert ask("/search?q=alpha&limit=1")["total"] == 1 and ask("/suggest?prefix=be")["suggestions"] == [{"term": "beta", "frequency": 1}]
    for path, code in (("/search?q=%20", 400), ("/none", 404)):
        with pytest.raises(urllib.error.HTTPError) as e:
            ask(path)
        assert e.value.code == code
    web.shutdown()
