"""Caches as tables: keyed by query or text, with age and recency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TTL = 604_800


def put(cache: DataFrame, entries: DataFrame, most: int) -> DataFrame:
    """Entries replace those of the same key; beyond ``most`` the least recently used go. Columns: key, ..., used (order of last use)."""
    both = cache.withColumn("__new", F.lit(0)).unionByName(entries.withColumn("__new", F.lit(1)))
    latest = both.withColumn("__n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("__new"), F.desc("used")))).where("__n = 1").drop("__n", "__new")
    return latest.orderBy(F.desc("used"), "key").limit(most)


def lookup(cache: DataFrame, queries: DataFrame, now: Column, ttl: int = TTL) -> DataFrame:
    """Cache rows that match the queries (any case) and aren't expired."""
    live = cache.where(now - F.col("timestamp") <= ttl)
    return queries.select("query", F.lower("query").alias("key")).join(live, "key")


def cleanup(cache: DataFrame, now: Column, ttl: int = TTL) -> DataFrame:
    return cache.where(now - F.col("timestamp") <= ttl)


def results(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Cached doc_ids and scores as result rows, in their order."""
    rows = hits.select("query", F.posexplode(F.arrays_zip("doc_ids", "scores")).alias("i", "r")).select("query", (F.col("i") + 1).alias("rank"), F.col("r.doc_ids").alias("doc_id"), F.col("r.scores").alias("score"))
    return rows.join(documents.select("doc_id", "title", "url"), "doc_id")
