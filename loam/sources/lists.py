"""Small inputs of a crawl: seed lists and stored robots files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.robots import robots_allowed


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """(url) of each line, trimmed, without blank lines and those that begin with #."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url <> '' and not startswith(url, '#')")


def allowed(urls: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """The urls that their site's robots file lets ``agent`` fetch. robots: robots_url, body.

    A site without a file, or with a null body (it couldn't be fetched), allows everything.
    """
    site = F.concat(F.regexp_extract("url", r"^([A-Za-z]+://[^/?#]*)", 1), F.lit("/robots.txt"))
    path = F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    joined = urls.withColumn("__site", site).join(robots.select(F.col("robots_url").alias("__site"), F.col("body").alias("__body")), "__site", "left")
    ok = F.when(F.col("__body").isNull(), True).otherwise(robots_allowed(F.coalesce("__body", F.lit("")), F.when(path == "", "/").otherwise(path), F.lit(agent)))
    return joined.where(ok).select(*urls.columns)
