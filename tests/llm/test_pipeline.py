"""The pipeline's stages one by one against brute force, and on odd tables."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loam.llm import jaccard_join, packing, pii, toxicity
from test_corpus import documents, similar_by_force

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with toxic ones, groups of near copies, personal data, nulls and repeats; extra columns with awkward names."""
    rng = random.Random(1)
    words = [f"word{i}" for i in range(400)]
    texts = []
    for k in range(160):
        base = [rng.choice(words) for _ in range(40)]
        if k % 8 == 0:
            base[10:10] = ["you", f"gloop{k % 3}"]
        elif k % 8 == 1 and texts[-8:-7]:
            base = texts[-8].split()
            base[rng.randrange(len(base))] = "changed"
        elif k % 8 == 2:
            base[5] = "mail someone@example.com or 555-123-4567 soon"
        texts.append(" ".join(base))
    texts += [None, "", "same words here again", "same words here again", "long " * 30_000]
    ids = [*range(160), 160, 161, 162, 162, None]
    d = documents(spark, texts, ids, [f"s{i % 3}" for i in range(len(texts))])
    wide = d.withColumns({"score": F.col("doc_id"), "__n": F.lit("x"), "cls": F.lit(1), "shard": F.lit(2), "component_id": F.lit(None).cast("long"), "source_": F.col("source")})
    path = str(tmp_path_factory.mktemp("pipeline"))
    wide.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(160)] + [(None, None, None), (5, 1, None)], LABELS).write.parquet(f"{path}/labels.parquet")
    return path


def key(rows):
    return sorted((str(r.doc_id), str(r.text)) for r in rows)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "personal_data", "mixing", "packing"]

    grammar = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    clean = stages["toxicity"](spark, docs, folder)
    assert clean.columns == docs.columns and key(clean.collect()) == key(r for r in docs.collect() if grammar.score(r.text) < 0.5)
    assert not [r for r in clean.collect() if "gloop" in (r.text or "")] and clean.count() == docs.count() - 20

    kept = stages["near_duplicates"](spark, clean, folder)
    rows = sorted(clean.collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    groups = similar_by_force([r.text for r in rows])
    least = {}
    for r, (_, _, _, root) in zip(rows, groups):
        least[root] = min(least.get(root, 1 << 62), 1 << 62 if r.doc_id is None else r.doc_id)
    assert kept.columns == docs.columns and key(kept.collect()) == key(r for r, (_, _, _, root) in zip(rows, groups) if r.doc_id is None or r.doc_id == least[root])
    assert kept.count() < clean.count()

    model = pii.train()
    redacted = stages["personal_data"](spark, kept, folder)
    want = []
    for r in kept.collect():
        [(_, spans)] = pii.find([r.text], model)
        want.append((str(r.doc_id), str(pii.redacted(r.text, spans) if spans else r.text)))
    got = redacted.collect()
    assert redacted.columns == docs.columns and key(got) == sorted(want) and not [r for r in got if re.search("@example|555-123", r.text or "")]
    assert all(r.n_chars == len(r.text) for r in got if r.text is not None)

    mixed = stages["mixing"](spark, redacted, folder)
    counts = {}
    for r in mixed.collect():
        counts[key([r])[0]] = counts.get(key([r])[0], 0) + 1
    assert mixed.columns == docs.columns and set(counts) == set(key(got)) and max(counts.values()) <= 3

    packed = stages["packing"](spark, mixed, folder).collect()
    total = sum(max(1, -(-max(1, -(-len((r.text or "").encode()) // 4)) // max(packing.CAPACITIES))) for r in mixed.collect())
    assert len(packed) == total
    bins = {}
    for r in packed:
        bins.setdefault((r.shard, r.bin), []).append(r)
    for pieces in bins.values():
        assert sum(r.n_tokens for r in pieces) <= pieces[0].capacity and len({r.capacity for r in pieces}) == 1
        assert sorted((r.start, r.n_tokens) for r in pieces)[0][0] == 0


@pytest.mark.parametrize("long", [2, 6, 64])
def test_groups_without_all_links(spark, long):
    """Groups from heads of long lists, and what those leave apart, are those of all links; sizes, drift and lone documents included."""
    rng = random.Random(long)
    words = [f"w{i}" for i in range(60)]
    texts = [None, "", "one", "ONE", "a b c", "A b\nc"]
    for k in range(8):
        base = rng.choices(words, k=rng.choice([5, 30, 120]))
        for _ in range(rng.choice([1, 4, 25])):
            t = list(base)
            for _ in range(rng.choice([0, 1, 3, 8])):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t[: len(t) - rng.choice([0, 0, len(t) // 4])]))
            base = t if k % 2 else base  # copies of copies: the ends of a chain aren't similar
    members, groups = jaccard_join.similar_groups(documents(spark, texts), long=long, frequent=4)
    of, least = {r.node: r.component for r in groups.collect()}, {}
    rows = sorted((r.doc_id, of.get(r.cls, r.cls) if r.n_shingles else f"none {r.doc_id}") for r in members.collect())
    for i, g in rows:
        least.setdefault(g, i)
    assert [(i, least[g]) for i, g in rows] == [(i, root) for i, _, _, root in similar_by_force(texts)]


def test_large_group_of_near_copies(spark, monkeypatch):
    """The pairs that are compared grow as the members of a group, not as their pairs."""
    rng, counts, checkpointed = random.Random(5), [], jaccard_join.checkpointed
    base = [f"w{i}" for i in range(100)]
    texts = []
    for _ in range(500):
        t = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 6])):
            t[rng.randrange(100)] = f"x{rng.randrange(10_000)}"
        texts.append(" ".join(t))

    def counted(df):
        out = checkpointed(df)
        if {"a", "b"} <= set(out.columns):
            counts.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "checkpointed", counted)
    kept = jaccard_join.keep_first(documents(spark, texts)).collect()
    shingled = [{tuple(t[i : i + 3]) for i in range(len(t) - 2)} for t in map(str.split, texts)]
    left, group = set(range(1, 500)), [0]
    for i in group:
        near = {j for j in left if 100 * len(shingled[i] & shingled[j]) >= 70 * len(shingled[i] | shingled[j])}
        left -= near
        group += near
    assert len(group) > 400 and {r.doc_id for r in kept} & set(group) == {0}
    assert counts and max(counts) < 10 * 500


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and {"doc_id", "piece", "n_tokens", "shard", "bin", "start", "capacity"} == set(rows[0].asDict()) and corpus_pipeline.ORACLE_SQL is None


def test_empty_tables(spark, tmp_path):
    docs = documents(spark, ["x"]).limit(0)
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_tagger_near_triggers_is_that_of_the_whole_text():
    """What the windows around digits and at signs find is what windows over the whole text find."""
    model, rng = pii.train(), np.random.default_rng(99)
    same = either = 0
    for _ in range(60):
        text = " ".join(pii.labelled_line(rng, 64)[0] + " plain words without any of them go on for quite a while here " * 3 for _ in range(4))
        [(_, near)], [(_, whole)] = pii.find([text], model), pii.find([text], model, everywhere=True)
        same, either = same + len(set(near) & set(whole)), either + len(set(near) | set(whole))
    assert either > 100 and same >= 0.97 * either
