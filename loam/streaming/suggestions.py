"""Suggestions for a stream of prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.suggest import suggest_many


def answer(prefixes: DataFrame, terms: DataFrame, limit: int = 10) -> DataFrame:
    """(prefix, suggestions) of the distinct prefixes of a batch; blank ones have no answer."""
    rows = suggest_many(terms, prefixes, limit)
    return rows.groupBy("prefix").agg(F.sort_array(F.collect_list(F.struct("n", "term", F.col("df").alias("frequency")))).alias("s")).select("prefix", F.transform("s", lambda x: F.struct(x["term"].alias("term"), x["frequency"].alias("frequency"))).alias("suggestions"))


def stream(prefixes: DataFrame, terms: DataFrame, sink: str, checkpoint: str, limit: int = 10, **trigger) -> StreamingQuery:
    """Write each batch's answers as JSON lines to a folder of the batch's number, which a repeated batch replaces."""

    def take(batch: DataFrame, number: int) -> None:
        answer(batch, terms, limit).write.mode("overwrite").json(f"{sink}/batch={number}")

    return prefixes.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
