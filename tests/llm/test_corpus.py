"""Corpus operators against brute force on small tables with nulls, ties, empty texts and repeated rows."""

import hashlib
import random
import re

import numpy as np
import pytest

from loam.llm import canonical, embedding_graph, html_render, jaccard_join, mixing, packing, paragraph_dedup, pii, toxicity, url_filter
from loam.llm.common import planes, unplanes, without_ids
from loam.llm.graph import components


def documents(spark, texts, ids=None, sources=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", sources[k] if sources else "s", None if t is None else len(t)) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_planes():
    x = np.array([0, 1, 255, 1 << 39], np.uint64)
    assert (unplanes(planes(x, 5), 5) == x).all()


def test_components(spark):
    e = spark.createDataFrame([(5, 3), (3, 9), (9, 9), (20, 21), (21, 22), (22, 23), (7, None)], "a long, b long")
    assert dict(components(e).collect()) == {5: 3, 3: 3, 9: 3, 20: 20, 21: 20, 22: 20, 23: 20}


def test_without_ids(spark):
    d = documents(spark, ["a", "b", "c", "d"], [1, 2, None, 4])
    assert sorted(str(r.doc_id) for r in without_ids(d, spark.createDataFrame([(2,)], "doc_id long")).collect()) == ["1", "4", "None"]


def similar_by_force(texts):
    def shingle(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()

    s = [shingle(t) for t in texts]
    links = [[j for j in range(len(s)) if j != i and s[i] and s[j] and 100 * len(s[i] & s[j]) >= 70 * len(s[i] | s[j])] for i in range(len(s))]
    root = list(range(len(s)))
    for _ in s:
        for i in range(len(s)):
            root[i] = min([root[i], *(root[j] for j in links[i])])
    return [(i, len(s[i]), len(links[i]), root[i]) for i in range(len(s))]


@pytest.mark.parametrize("frequent", [2, 4, 32])
def test_jaccard_join(spark, frequent):
    rng = random.Random(frequent)
    words = [f"w{i}" for i in range(60)]
    texts = [None, "", " \t", "one", "ONE", "one two", "a b c", "A b\nc"]
    for _ in range(12):
        base = rng.choices(words, k=rng.choice([5, 30, 120]))
        for _ in range(rng.choice([1, 4, 14])):
            t = list(base)
            for _ in range(rng.choice([0, 1, 2, 6])):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    got = jaccard_join.similar_documents(documents(spark, texts), frequent=frequent).collect()
    assert sorted(map(tuple, got)) == similar_by_force(texts)


def test_jaccard_empty(spark):
    assert jaccard_join.similar_documents(documents(spark, ["x"]).limit(0)).count() == 0
    d = documents(spark, ["a b c d", "a b c d", "z z y x"], [3, 3, None])
    assert jaccard_join.similar_documents(d).where("n_similar = 1").count() == 2


def test_base_spans():
    rng = random.Random(3)
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def force(t):
        out = []
        for k, p in enumerate(patterns):
            for m in re.finditer(p, t):
                digits = re.sub(r"\D", "", m[0])
                ok = (True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 16 <= len(digits) <= 19 and pii.luhn(digits), 8 <= len(digits) <= 15)[k]
                if ok:
                    out.append((k, m.start(), m.end()))
        return out

    for _ in range(3000):
        t = "".join(rng.choice("ab1290.@+- ()é\n4") for _ in range(rng.randrange(60)))
        assert pii.base_spans(t) == force(t), t
    assert pii.base_spans("x 4111 1111 1111 1111 y a.b@c-d.e.f. +1 (716) 555-8176") == force("x 4111 1111 1111 1111 y a.b@c-d.e.f. +1 (716) 555-8176")


def test_tagger_gradient_and_redaction():
    m = pii.Tagger(3, 1)
    rng = np.random.default_rng(0)
    ids, tags = rng.integers(0, pii.N_CLASSES, (2, 6)), np.array([[0, 1, 2, 0, 3, 4], [0, 0, 5, 6, 0, 7]])
    _, g = m.gradient(ids, tags)
    for k in m.p:
        at = tuple(np.argwhere(np.abs(g[k]) == np.abs(g[k]).max())[0])
        old, e = m.p[k][at], 1e-2
        m.p[k][at] = old + e
        up = m.gradient(ids, tags)[0]
        m.p[k][at] = old - e
        down = m.gradient(ids, tags)[0]
        m.p[k][at] = old
        assert (up - down) / 2 / e == pytest.approx(g[k][at], rel=0.05, abs=1e-3)
    assert pii.redacted("a x@y.z b +1 555 1234567", pii.base_spans("a x@y.z b +1 555 1234567")) == "a [EMAIL] b [PHONE]"
    # a whole span wins over a cut one, base spans stay
    assert pii.reconcile("call 555-123-4567 now", [], [(3, 5, 17, False), (3, 5, 12, True)]) == [(3, 5, 17)]


def test_pii_query(spark):
    texts = ["mail a@b.co", None, "", "ip 1.2.3.4 and 1.2.3.999"]
    got = {r.doc_id: r for r in pii.detect(documents(spark, texts), pii.Tagger()).collect()}
    for i, t in enumerate(texts):
        assert got[i].base_sha256 == hashlib.sha256(pii.written(sorted(pii.base_spans(t or ""))).encode()).hexdigest()
    assert (got[0].n_email, got[3].n_ip, got[1].n_phone) == (1, 1, 0)


def test_canonical(spark):
    texts = ["Ａ b\n C", "a b c", None, "", "x" * 9, "straße", "STRASSE"]
    groups = {r.doc_id: r.group_id for r in canonical.equal_groups(documents(spark, texts)).collect()}
    assert groups == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5, 6: 5}


def test_digest_neighbours(spark, tmp_path):
    texts = [None if i % 7 == 3 else f"document {i} " * (i % 5) for i in range(40)]
    documents(spark, texts, [i * i for i in range(40)]).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in canonical.op8_canonical_digest(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % 40] or ""
        cut = len(t) // 4
        changed = t[: len(t) - cut] + after[:cut]
        r = got[i * i]
        assert (r.n_chars, r.edited_sha256, r.near_next) == (len(t), hashlib.sha256(changed.encode()).hexdigest(), float(canonical.canonical(t) == canonical.canonical(after)))


def test_mixing(spark):
    d = documents(spark, ["t"] * 900, sources=[None if i % 90 == 1 else "hot" if i % 3 == 0 else f"s{i % 4}" for i in range(900)])
    plan = mixing.plan_mix(d, block_rows=4).collect()
    sizes = {r.source: r for r in mixing.source_sizes(d, 4).collect()}
    assert len(plan) == 900 and min(r.repeats for r in plan) >= 1 and sum(r.units for r in sizes.values()) == mixing.UNITS
    assert sorted((r.source or "", r.block) for r in plan) == sorted((r.source or "", i // 4) for r in sizes.values() for i in range(r.n_rows))
    mixed = mixing.mix(d, block_rows=4)
    assert mixed.columns == d.columns and mixed.count() == sum(r.repeats for r in plan)
    assert mixing.plan_mix(d.limit(0)).count() == 0 and mixing.mix(d.limit(0)).count() == 0
    # fewer, larger blocks of the same rows
    few = mixing.plan_mix(d, block_rows=4, most_blocks=10).collect()
    assert len(few) == 900 and len({(r.source, r.block) for r in few}) <= 10 + len(sizes)


def test_mixing_to_given_weights(spark):
    d = documents(spark, ["t"] * 600, sources=["a" if i < 400 else "b" if i < 590 else "c" for i in range(600)])
    weights = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 1.0), ("other", 9.0)], "source string, weight double")
    order = [r.source for r in mixing.schedule(mixing.source_sizes(d, 2, weights=weights)).orderBy("slot").collect()]
    for t in range(len(order)):
        for source, w in (("a", 0.25), ("b", 0.5), ("c", 0.25)):
            assert abs(order[: t + 1].count(source) - (t + 1) * w) < 1
    plan = mixing.plan_mix(d, block_rows=2, weights=weights).collect()
    given = {s: sum(r.repeats for r in plan if r.source == s) for s in "abc"}
    assert abs(given["b"] - 2 * given["a"]) <= 4 and abs(given["c"] - given["a"]) <= 4
    with pytest.raises(Exception):
        mixing.plan_mix(d, weights=weights.where("source <> 'c'")).collect()
    # extra columns with the names that the operator uses inside, repeated and null ids
    odd = d.withColumns({"__source": d["text"], "__N": d["doc_id"], "ss": d["doc_id"], "units": d["doc_id"]}).union(d.withColumns({"__source": d["text"], "__N": d["doc_id"], "ss": d["doc_id"], "units": d["doc_id"]}).selectExpr("null", *["text", "lang", "source", "n_chars", "__source", "__N", "ss", "units"]).limit(5))
    mixed = mixing.mix(odd, block_rows=2)
    assert mixed.columns == odd.columns and mixed.select("doc_id").distinct().count() == 601


def test_packing(spark):
    rng = random.Random(1)
    lengths = [rng.randrange(0, 8193) for _ in range(300)] + [8192, 8192, 0]
    where, caps, cost = packing.pack([min(x, 8192) for x in lengths])
    used = [0] * len(caps)
    for b, x in zip(where, lengths):
        used[b] += min(x, 8192)
    assert all(u <= c and c in packing.CAPACITIES for u, c in zip(used, caps)) and cost == sum(caps) + 8 * len(caps)
    assert sum(used) / sum(caps) > 0.9
    rows = packing.pack_documents(documents(spark, ["x" * 70_000, None, "", "abc"])).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in rows) == [(0, 1116), (0, 8192), (0, 8192), (1, 0), (2, 0), (3, 1)]


def test_toxicity(spark):
    g = toxicity.Grammar()
    assert g.clause(["you", "idiot"]) > g.clause(["idiot"]) > g.clause(["not", "an", "idiot"]) > 0 == g.clause(["hello"])
    assert g.clause(["he", "said", "idiot"]) < g.clause(["he", "is", "idiot"]) and g.clause(["i", "will", "kill", "you"]) > 0 == g.clause(["kill", "time"])
    texts = [f"plain words number {i}" if i % 2 else f"you gloop{i % 4} thing" for i in range(400)] + [None, ""]
    labels = spark.createDataFrame([(i, 1, (i + 1) % 2) for i in range(400)], "doc_id long, quality int, toxic int")
    d = documents(spark, texts)
    fitted = toxicity.fit(d, labels)
    got = {r.doc_id: r.score for r in toxicity.score(d, fitted).collect()}
    assert all((got[i] >= 0.5) == (i % 2 == 0) for i in range(400)) and got[400] == got[401] < 0.5
    assert toxicity.reject_toxic(d, fitted).count() == 202
    assert toxicity.fit(d, labels.limit(0)).lexicon == toxicity.SEED


def test_html():
    page = "<title>t</title><p>a<p>b &amp; c<ul><li>x<li>y</ul><div hidden>no</div><script>if(a<b){}</script><table><tr><td>1<td>22<tr><td>333<td>4</table><pre> k\n  l</pre>"
    assert html_render.render(page) == "a\n\nb & c\n\n- x\n- y\n\n1   | 22\n333 | 4\n\n k\n  l"
    assert html_render.render(None) == html_render.render("") == "" and html_render.render("<" * 50) and html_render.render("<div>" * 3000 + "deep") == "deep"


def test_urls(spark):
    urls = ["http://www.X.com/en/1?q", "http://a.example.com/en/7", None, "no url", "https://a.net/de/8", "https://example.net/de/8x", "http://casinowin.example.org/fr/"]
    got = [tuple(r) for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).select("host", "path", "rule", "verdict").collect()]
    assert got[:4] == [("www.x.com", "/en/1", "com/en/", "block"), ("a.example.com", "/en/7", "example.com/en/7", "allow"), ("", "", None, "allow"), ("", "", None, "allow")]
    assert got[4:] == [("a.net", "/de/8", "net/de/", "allow"), ("example.net", "/de/8x", "example.net/de/8", "block"), ("casinowin.example.org", "/fr/", None, "block")]
    assert url_filter.train({}, []).split("cheapcasinobonus") == ["cheap", "casino", "bonus"]


def test_paragraphs(spark):
    rng = random.Random(5)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    shared = fresh(70)
    texts = [fresh(80) + " " + shared + " " + fresh(40) if i % 4 == 0 else fresh(150) for i in range(24)] + [None, "", "one two"]
    got = {r.doc_id: r for r in paragraph_dedup.repeated_passages(documents(spark, texts)).collect()}
    assert got[0].n_removed == 0 and all(got[i].n_removed >= 30 for i in range(4, 24, 4)) and all(got[i].n_removed == 0 for i in range(1, 27) if i % 4)
    cut = paragraph_dedup.without_passages(texts[4], got[4].spans)
    assert len(cut.split()) == 190 - got[4].n_removed


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    x = [(centres[i % 12] + rng.normal(size=16) * 0.12).tolist() for i in range(300)]
    x += [x[0], None, [0.0] * 16, [float("nan")] * 16, []]
    rows = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding_graph.near_duplicates(rows, shard=120).collect()}
    y = np.array([v if v is not None and len(v) == 16 else [0.0] * 16 for v in x])
    ok = np.isfinite(y).all(1) & y.any(1)
    y[ok] /= np.linalg.norm(y[ok], axis=1, keepdims=True)
    y[~ok] = 0
    s = (y @ y.T >= 0.95) & ~np.eye(len(y), dtype=bool)
    assert sum(r.n_links for r in got.values()) >= 0.9 * s.sum() and all(got[i].n_links <= s[i].sum() for i in got)
    assert all(got[i].n_links == 0 and got[i].kept for i in range(301, 305))


def test_embeddings_dense_group(spark, monkeypatch):
    # one group of near copies, all linked to each other, over many shards
    rng = np.random.default_rng(4)
    centre = rng.normal(size=16)
    x = np.concatenate([centre + rng.normal(size=(400, 16)) * 0.06, rng.normal(size=(200, 16))])
    rows = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = (y @ y.T >= 0.95) & ~np.eye(len(y), dtype=bool)
    got = {r.vec_id: r.n_links for r in embedding_graph.near_duplicates(rows, shard=50).collect()}
    assert s[:400].sum() > 100_000 and [got[i] for i in range(600)] == s.sum(1).tolist()
    # the same as one cluster: all its blocks meet each other
    monkeypatch.setattr(embedding_graph, "_pivots", lambda vectors, count: {16: (0, y[:1])})
    got = {r.vec_id: r.n_links for r in embedding_graph.near_duplicates(rows, shard=150).collect()}
    assert [got[i] for i in range(600)] == s.sum(1).tolist()


def test_mixing_by_weight(spark):
    # 21 sources beside a hot one, and one so small that a whole slot in a frame would be many times its share
    d = documents(spark, ["t"] * 6_005, sources=["tiny" if i >= 6_000 else "hot" if i % 3 == 0 else f"s{i % 20}" for i in range(6_005)])
    sizes = {r.source: r for r in mixing.source_sizes(d, 2).collect()}
    assert sum(r.units for r in sizes.values()) == mixing.UNITS
    order = [r.source for r in mixing.schedule(mixing.source_sizes(d, 2)).orderBy("slot").collect()]
    done = dict.fromkeys(sizes, 0)
    for slot, source in enumerate(order):
        done[source] += 1
        assert all(abs(done[k] - (slot + 1) * r.weight) < 1 for k, r in sizes.items())
    assert len(order) > 3_000
    plan = mixing.plan_mix(d, block_rows=2).collect()
    length = max(r.first_slot for r in plan) + 1
    assert len(plan) == 6_005 and mixing.mix(d, block_rows=2).count() == sum(r.repeats for r in plan)
    assert all(order[r.first_slot] == r.source for r in plan)
    given = {k: sum(r.repeats for r in plan if r.source == k) / 2 for k in sizes}
    assert all(abs(given[k] - length * r.weight) < 2 for k, r in sizes.items())


def test_forest_by_force():
    rng = random.Random(3)
    for _ in range(200):
        base = [rng.randrange(40) for _ in range(10)]
        sets = [np.unique([rng.randrange(40) if rng.random() < 0.1 else t for t in base] if rng.random() < 0.7 else [rng.randrange(40) for _ in range(10)]) for _ in range(rng.randrange(2, 14))]
        links = paragraph_dedup.forest(np.arange(100, 100 + len(sets)), sets, 0.7)

        def roots(pairs):
            root = list(range(len(sets)))
            for _ in sets:
                for a, b in pairs:
                    root[a] = root[b] = min(root[a], root[b])
            return root

        near = [(i, j) for i in range(len(sets)) for j in range(i) if len(set(sets[i]) & set(sets[j])) >= 0.7 * len(set(sets[i]) | set(sets[j]))]
        links = [(a - 100, b - 100) for a, b in links]
        assert roots(links) == roots(near) and len(links) == len(sets) - len(set(roots(near))) and all((max(p), min(p)) in near for p in links)


def test_paragraph_recall_and_odd_input(spark):
    """Links of edited passages against brute force over all paragraphs; nulls, repeats, long texts and clashing columns."""
    rng = random.Random(11)
    fresh = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
    found = wanted = 0
    texts = []
    while len(texts) < 120:  # of one paragraph each
        a = fresh(20)
        b = a[:-1] + fresh(1)
        if all(len(paragraph_dedup.paragraphs(" ".join(t))[1]) == 1 for t in (a, b)):
            texts += [" ".join(a), " ".join(b)]

    def facts(t):
        w, start = paragraph_dedup.paragraphs(t)
        pairs = paragraph_dedup.pair_hashes(w, start)
        return set(pairs.tolist()) if len(start) == 1 else set()

    sets = [facts(t) for t in texts]
    got = {r.doc_id: r.n_removed for r in paragraph_dedup.repeated_passages(documents(spark, texts), min_words=5).collect()}
    for i in range(0, len(texts), 2):
        x, y = sets[i], sets[i + 1]
        if x and y and len(x & y) >= 0.8 * len(x | y):
            wanted += 1
            found += got[i + 1] > 0
    assert wanted >= 20 and found >= 0.9 * wanted
    shared = " ".join(fresh(60))
    d = documents(spark, [shared, None, "", "one", "x " * 200_000, shared, shared], [5, 1, None, None, 2, 5, None])
    d = d.withColumn("start", d["doc_id"]).withColumn("root", d["text"]).withColumn("node", d["text"])
    rows = {r.doc_id: r for r in paragraph_dedup.repeated_passages(d).collect()}
    assert set(rows) == {1, 2, 5} and rows[1].n_removed == 0 and paragraph_dedup.repeated_passages(d.limit(0)).count() == 0


def test_paragraphs_beside_unrelated_heads(spark):
    # in every band that two near copies share, the least digest is that of an unlike paragraph
    rng = random.Random(8)
    bands, rows = paragraph_dedup.tune()

    def facts(words):
        w, start = paragraph_dedup.paragraphs(" ".join(words))
        pairs = paragraph_dedup.pair_hashes(w, start)
        return len(start), set(pairs.tolist()), int(paragraph_dedup.digests(w, start)[0]), paragraph_dedup.band_keys(pairs, start, bands, rows)[0]

    alike = lambda x, y: len(x[1] & y[1]) / len(x[1] | y[1])
    fresh = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    while True:
        a = [fresh() for _ in range(26)]
        b = a[:-1] + [fresh()]
        x, y = facts(a), facts(b)
        if x[0] == y[0] == 1 and min(x[2], y[2]) > 6 << 60 and (x[3] == y[3]).any():
            break
    texts, left = [a, b], set(np.flatnonzero(x[3] == y[3]).tolist())
    for _ in range(20_000):
        gone = rng.sample(range(26), 3)
        c = [fresh() if i in gone else t for i, t in enumerate(a)]
        z = facts(c)
        new = {k for k in left if z[3][k] == x[3][k]}
        if new and z[0] == 1 and z[2] < min(x[2], y[2]) and alike(x, z) < 0.8 > alike(y, z):
            texts.append(c)
            left -= new
        if not left:
            break
    assert not left and alike(x, y) >= 0.8
    got = {r.doc_id: r.n_removed for r in paragraph_dedup.repeated_passages(documents(spark, [" ".join(t) for t in texts])).collect()}
    assert got[0] == 0 and got[1] == 26


def test_pii_long_spans():
    class Words:
        """Tags every run without white space as an email."""

        def decode(self, ids):
            inside = (ids != pii.classes(" ")[0]) & (ids > 0)
            first = inside & ~np.pad(inside, ((0, 0), (1, 0)))[:, :-1]
            return np.where(first, 1, np.where(inside, 2, 0)).astype(np.int8)

    # beyond the margin on both sides of the at sign; longer than windows overlap; longer than any window; at the text's ends
    for name in ("abcdefghijklmnopqrstuvwxyzab[@]" + "longdomain" * 4 + ".example.com", "a1b2" * 10 + "[@]x.org", "a1b2" * 60 + "[@]x.org", "q" * 500 + "[@]x.org"):
        for before, after in (("some words go first ", " and some follow them"), ("", " and more"), ("more ", "")):
            text = before + name + after
            (base, every), (_, none) = pii.find([text, None], Words())
            assert base == [] and every == [(0, len(before), len(before) + len(name))] and none == []
            assert pii.redacted(text, every) == f"{before}[EMAIL]{after}"


def test_embeddings_audit(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(10, 16))
    x = np.array([centres[i % 10] + rng.normal(size=16) * 0.05 for i in range(200)])
    rows = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = (y @ y.T >= 0.95) & ~np.eye(200, dtype=bool)
    members, links = embedding_graph.similar_vectors(rows, shard=60)
    got = embedding_graph.audit(rows, links, members, every=5, block=8).first()  # five blocks of queries
    assert got.expected == s[::5].sum() and got.found == got.expected and got.recall == 1
