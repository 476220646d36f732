"""Parsed pages as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import lines

PAGE = "url string, title string, meta_description string, content string, content_length long, headings array<string>, links array<string>, word_count long"


def read(spark: SparkSession, path: str, limit: int | None = None, schema: str = PAGE) -> DataFrame:
    """One page per line; a malformed line ends the job. ``limit``: the first lines of the scan."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return rows if limit is None else rows.limit(limit)


def write(pages: DataFrame, path: str) -> None:
    """The pages' own columns, one object per line; null fields are kept, so that rows read back are the same."""
    names = [c for c in (x.split()[0] for x in PAGE.split(", ")) if c in pages.columns]
    pages.select(*names).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def tail(spark: SparkSession, path: str, begin: int = 0, schema: str = PAGE) -> DataFrame:
    """The pages of one file from a byte offset on, with seq (where the line begins) and next (where the next one does).

    Blank lines have no row. A malformed line raises an error.
    """
    rows = lines(spark, path, begin).where(F.trim("line") != "")
    page = F.from_json("line", schema, {"mode": "FAILFAST"})
    return rows.select(F.col("at").alias("seq"), "next", page.alias("p")).select("seq", "next", "p.*")
