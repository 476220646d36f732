"""Ranked full-text search: one plan for one query or many."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.queryparse import EXCLUDED, OPTIONAL, REQUIRED, parse_query
from ..functions.stem import stem as stem_word
from .index import Index

K1, B, CAP = 1.5, 0.75, 20
BOOSTS = {"title": 3.0, "headings": 2.0, "url": 1.5, "body": 1.0}
FUZZY_TERMS, FUZZY_DISTANCE, FUZZY_PENALTY = 5, 2, 0.5


def query_tokens(spark: SparkSession, queries: list[tuple[int, str]], stem: bool = False) -> list[tuple[int, str, str]]:
    """(qid, kind, token) per token occurrence: parsed on the driver, analysed by the same expressions as documents.

    The words are literals of the plan, which the optimizer evaluates: no job is run.
    """
    rows = [(q, kind, text) for q, s in queries for kind, text in parse_query(s) if kind in (REQUIRED, OPTIONAL, EXCLUDED)]
    if not rows:
        return []
    texts = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({i}, :t{i})" for i in range(len(rows))) + " AS v(i, text)", {f"t{i}": r[2] for i, r in enumerate(rows)})
    found = {r.i: r.t for r in texts.select("i", T.tokens(F.col("text")).alias("t")).collect()}
    return [(q, k, stem_word(t) if stem else t) for i, (q, k, _) in enumerate(rows) for t in found[i]]


def frequency() -> Column:
    """Boosted term frequency."""
    total = F.lit(0.0)
    for field, boost in BOOSTS.items():
        total = total + F.col(field) * boost
    return total


def bm25(idf_: Column, tf: Column, length: Column, average: Column, k1: float = K1, b: float = B) -> Column:
    """With no average length, lengths don't count."""
    return idf_ * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.coalesce(F.try_divide(length, average), F.lit(0.0))))


def rank_boost(pagerank: Column) -> Column:
    return 1 + F.greatest(F.ln(pagerank * 10000), F.lit(0.0))


def fuzzy_terms(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, term, distance): for each distinct token of four bytes or more, the five nearest ASCII terms at distance 1 or 2.

    The tokens are a handful of query words and are broadcast; lengths are compared before distances. If both tables have
    a shard column, terms of a token's own shard count.
    """
    by = ["shard"] if "shard" in tokens.columns and "shard" in vocabulary.columns else []
    band = (F.abs(F.octet_length("term") - F.octet_length("token")) <= 2) & (F.length("term") == F.octet_length("term"))
    wanted = tokens.select(*by, "token").distinct().where(F.octet_length("token") >= 4)
    for c in by:
        wanted, band = wanted.withColumnRenamed(c, "__shard"), band & (F.col("__shard") == F.col(c))
    near = vocabulary.select(*by, "term").join(F.broadcast(wanted), band & F.levenshtein(F.col("token"), F.col("term"), FUZZY_DISTANCE).between(1, FUZZY_DISTANCE))
    near = near.select(*by, "token", "term", F.levenshtein("token", "term").alias("distance"))
    return near.withColumn("n", F.row_number().over(Window.partitionBy(*by, "token").orderBy("distance", "term"))).where(f"n <= {FUZZY_TERMS}").drop("n")


def _probes(tokens: list, df: dict[str, int], near: dict[str, list], total: int) -> dict[str, list[tuple]]:
    """term -> (qid, weight or None if it bans, exact, need, needed) of each query that looks the term up."""
    times, required = Counter(), set()
    for q, kind, t in tokens:
        if kind != EXCLUDED:
            times[q, t] += 1
            if kind == REQUIRED:
                required.add((q, t))
    rows = []
    for (q, t), n in sorted(times.items()):
        for term, distance in [(t, 0)] if t in df and t not in near else near.get(t, []):
            weight = n * math.log((total - df[term] + 0.5) / (df[term] + 0.5) + 1)
            rows.append((term, q, weight * FUZZY_PENALTY**distance, distance == 0, int(distance == 0 and (q, t) in required)))
    needed = Counter(r[1] for r in rows if r[4])
    out: dict[str, list[tuple]] = {}
    for term, q, weight, exact, need in rows:
        out.setdefault(term, []).append((q, weight, exact, need, needed[q]))
    for q, t in sorted({(q, t) for q, kind, t in tokens if kind == EXCLUDED and t in df}):
        out.setdefault(t, []).append((q, None, False, 0, 0))
    return out


def search(index: Index, queries: list[tuple[int, str]], stem: bool = False, fuzzy: bool = True, k1: float = K1, b: float = B, cap: int = CAP, shards: int | None = None) -> DataFrame:
    """(qid, doc_id, score, rank): the best ``cap`` documents of each query, ties by doc_id.

    Every occurrence of a token counts. Exact hits are raised by the document's PageRank. A token without any
    hit falls back on near terms, if it has four bytes or more. Documents must hold every required token that
    the index knows, and no excluded one.

    The words' frequencies come to the driver; the search itself is one scan of postings with a pushed-down term filter, in which the
    words' weights are literals, one aggregation by document and a top-k. With ``shards``, both tables have a shard column, each shard
    ranks by its own statistics, all in the same plan, and the best of all shards' best are merged.
    """
    spark = index.postings.sparkSession
    tokens = query_tokens(spark, queries, stem)
    words = sorted({t for _, _, t in tokens})
    by = [] if shards is None else ["shard"]
    parts = [0] if shards is None else range(shards)
    key = lambda r: r.shard if by else 0
    df: dict[int, dict[str, int]] = {s: {} for s in parts}
    vocabulary = index.terms() if not by else index.postings.groupBy("shard", "term").agg(F.count("*").alias("df"))
    totals = {0: index.totals()} if not by else {s: (0, 0.0) for s in parts} | {r.shard: (r.n, r.average or 0.0) for r in index.documents.where(~F.col("deleted")).groupBy("shard").agg(F.count("*").alias("n"), F.avg(F.when(F.col("doc_length") > 0, F.col("doc_length"))).alias("average")).collect()}

    def look_up(wanted: list[str]) -> None:
        for r in vocabulary.where(F.col("term").isin(wanted)).collect() if wanted else []:
            df[key(r)][r.term] = r.df

    look_up(words)
    near: dict[int, dict[str, list[tuple[str, int]]]] = {s: {} for s in parts}
    asked = {t for _, kind, t in tokens if kind != EXCLUDED and len(t.encode()) >= 4}
    missing = [(s, t) for s in parts for t in sorted(asked - df[s].keys())]
    if fuzzy and missing:
        for r in fuzzy_terms(spark.createDataFrame(missing, "shard int, token string").select(*by, "token"), vocabulary).collect():
            near[key(r)].setdefault(r.token, []).append((r.term, r.distance))
        look_up(sorted({t for s in parts for ts in near[s].values() for t, _ in ts}))
    probes = {(s, term): rows for s in parts for term, rows in _probes(tokens, df[s], near[s], totals[s][0]).items()}
    known = F.concat_ws(":", F.col("shard").cast("string"), F.col("term")) if by else F.col("term")
    if probes:
        struct = lambda r: F.struct(*[F.lit(x).cast(t).alias(n) for x, t, n in zip(r, ("int", "double", "boolean", "int", "int"), ("qid", "weight", "exact", "need", "needed"))])
        table = F.create_map(*[x for (s, term), rows in probes.items() for x in (F.lit(f"{s}:{term}" if by else term), F.array(*[struct(r) for r in rows]))])
        hits = index.postings.where(F.col("term").isin(sorted({t for _, t in probes}))).withColumn("p", F.explode(F.try_element_at(table, known)))
    else:
        hits = index.postings.where(F.lit(False)).withColumn("p", F.lit(None).cast("struct<qid:int,weight:double,exact:boolean,need:int,needed:int>"))
    average = F.lit(totals[0][1]) if not by else F.element_at(F.create_map(*[x for s in parts for x in (F.lit(s), F.lit(float(totals[s][1])))]), F.col("shard"))
    tf = frequency()
    score = bm25(F.col("p.weight"), tf, F.col("doc_length"), average, k1, b) * F.when(F.col("p.exact"), rank_boost(F.col("pagerank"))).otherwise(1.0)
    scored = hits.select(*by, "p.qid", "doc_id", score.alias("s"), "p.need", "p.needed", "p.weight")
    per_doc = scored.groupBy(*by, "qid", "doc_id").agg(F.sum("s").alias("score"), F.sum("need").alias("held"), F.max("needed").alias("needed"), F.count_if(F.col("weight").isNull()).alias("banned"))
    kept = per_doc.where((F.col("banned") == 0) & (F.col("held") >= F.col("needed")) & F.col("score").isNotNull())
    if by:
        own = kept.withColumn("rank", F.row_number().over(Window.partitionBy("qid", "shard").orderBy(F.desc(F.round("score", 9)), "doc_id")))
        kept = own.where(F.col("rank") <= cap).drop("rank")
    if len({q for q, _ in queries}) == 1:  # a bounded top-k instead of a sort
        kept = kept.orderBy(F.desc(F.round("score", 9)), "doc_id").limit(cap)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "doc_id")))
    return ranked.where(F.col("rank") <= cap).select("qid", "doc_id", "score", "rank")


def filter_results(results: DataFrame, documents: DataFrame, domain: str | None = None, after: int | None = None, before: int | None = None) -> DataFrame:
    """Filter ranked results (after the cap): domain contains, timestamps inclusive."""
    joined = results.join(documents.select("doc_id", "domain", "timestamp"), "doc_id")
    for wanted, condition in ((domain, lambda: F.contains("domain", F.lit(domain))), (after, lambda: F.col("timestamp") >= after), (before, lambda: F.col("timestamp") <= before)):
        if wanted is not None:
            joined = joined.where(condition())
    return joined.drop("domain", "timestamp")


def display(results: DataFrame, index: Index, query: str, context: int = 20) -> DataFrame:
    """(rank, title, url, snippet, score) of one query's results."""
    spark = results.sparkSession
    q = F.array(*[F.lit(t) for t in spark.range(1).select(T.tokens(F.lit(query)).alias("t")).first().t]) if query else F.array().cast("array<string>")
    return results.join(index.documents.select("doc_id", "title", "url", "content"), "doc_id").select("rank", "title", "url", T.snippet(F.col("content"), q.cast("array<string>"), context).alias("snippet"), "score")


def search_shards(index: Index, shard: Column, shards: int, queries: list[tuple[int, str]], cap: int = CAP, **options) -> DataFrame:
    """``search`` over shards (numbered from 0) that an expression over the documents chooses."""
    placed = index.documents.withColumn("shard", shard)
    return search(Index(placed, index.postings.join(placed.select("doc_id", "shard"), "doc_id")), queries, cap=cap, shards=shards, **options)
