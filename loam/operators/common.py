"""Reliable checkpoints and dense numbers, without any step that one task does for all rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that executors share, as the session names it; only a local session gets a temporary one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="loam-")


def cut(df: DataFrame) -> DataFrame:
    """The rows, checkpointed, so that the plans before them are done with."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def numbered(rows: DataFrame, *order: Column | str, name: str = "number") -> DataFrame:
    """The rows with their place (from 0) in the order of ``order``, which must tell all rows apart.

    Rows are laid out in ranges of the order; each range is numbered on its own, from the sum of the counts before it. What is
    ordered in one place is one count per range.
    """
    ranges = cut(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    counts = ranges.groupBy("__range").agg(F.count("*").alias("__rows"))
    before = F.coalesce(F.sum("__rows").over(Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranges.join(F.broadcast(counts.select("__range", before.alias("__before"))), "__range")
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return placed.withColumn(name, F.col("__before") + inside).drop("__range", "__before")
