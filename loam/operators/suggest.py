"""Prefix suggestions, spelling correction and synonym expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SYNONYMS = {
    "internet": ["web", "online", "network"],
    "security": ["secure", "safety", "protection"],
    "domain": ["website", "site", "host"],
    "search": ["find", "lookup", "query"],
    "data": ["information", "content"],
    "user": ["client", "customer"],
    "server": ["host", "machine"],
    "page": ["document", "webpage"],
    "fast": ["quick", "rapid"],
    "web": ["internet", "online"],
}


def suggest(terms: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """Terms that begin with the prefix, most frequent first. The prefix is pushed into the scan of stored terms."""
    return terms.where(F.col("term").startswith(prefix)).orderBy(F.desc("df"), "term").limit(limit)


def suggest_many(terms: DataFrame, prefixes: DataFrame, limit: int = 10) -> DataFrame:
    """For a table of prefixes (a few, broadcast): prefix, term, df, n."""
    joined = terms.join(F.broadcast(prefixes.select(F.trim("prefix").alias("prefix")).where("prefix <> ''").distinct()), F.col("term").startswith(F.col("prefix")))
    return joined.withColumn("n", F.row_number().over(Window.partitionBy("prefix").orderBy(F.desc("df"), "term"))).where(F.col("n") <= limit)


def expand(query: Column, synonyms: dict[str, list[str]] | None = None) -> Column:
    """Each word, then OR and each of its synonyms."""
    known = F.create_map(*[x for k, v in (synonyms or SYNONYMS).items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    ws = F.filter(F.split(query, r"\s+"), lambda w: w != "")
    more = lambda w: F.concat(F.array(w), F.flatten(F.transform(F.coalesce(F.try_element_at(known, F.lower(w)), F.array().cast("array<string>")), lambda s: F.array(F.lit("OR"), s))))
    return F.array_join(F.flatten(F.transform(ws, more)), " ")


def correct(queries: DataFrame, dictionary: DataFrame, most: int = 2) -> DataFrame:
    """(query, correction): each word by the nearest dictionary word at distance 1 or 2 (ties: dictionary order), null if nothing changed.

    A word of the dictionary itself is still replaced by such a neighbour. queries: query, a few rows; dictionary: word, pos.
    """
    words = queries.select("query", F.posexplode(F.filter(F.split("query", r"\s+"), lambda w: w != "")).alias("i", "w"))
    distinct = words.select(F.lower("w").alias("w")).distinct()
    d = F.levenshtein(F.col("w"), F.lower("word"), most)
    near = dictionary.join(F.broadcast(distinct), (F.abs(F.length("w") - F.length("word")) <= most) & d.between(1, most))
    best = near.groupBy("w").agg(F.min_by("word", F.struct(F.levenshtein("w", F.lower("word")).alias("d"), "pos")).alias("to"))
    fixed = words.join(best.withColumnRenamed("w", "key"), F.lower("w") == F.col("key"), "left")
    whole = fixed.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("to", "w").alias("w")))).alias("s"), F.count("to").alias("changed"))
    return whole.select("query", F.when(F.col("changed") > 0, F.array_join(F.transform("s", lambda x: x["w"]), " ")).alias("correction"))
