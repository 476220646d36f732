"""Reports over the query log: query, timestamp, results_count, search_time_ms, mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_queries(log: DataFrame, limit: int) -> DataFrame:
    return log.groupBy("query").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "query").limit(limit)


def failed_searches(log: DataFrame, limit: int) -> DataFrame:
    return top_queries(log.where("results_count = 0"), limit)


def average_time(log: DataFrame) -> DataFrame:
    return log.agg(F.avg("search_time_ms").alias("avg_ms"))


def by_mode(log: DataFrame) -> DataFrame:
    return log.groupBy("mode").agg(F.count("*").alias("n"))


def total(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("n"))
