"""Vector search: exact, by hyperplane signatures, and mixed with text scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V

SMALL, TARGET = 256, 8


def _literal(q: list[float]):
    return F.array(*[F.lit(float(x)).cast("float") for x in q])


def check_dimension(vectors: DataFrame, dimension: int) -> DataFrame:
    """The rows, with an error raised by the first vector of another length."""
    return vectors.where(F.assert_true(F.size("embedding") == dimension, "vector of another dimension").isNull())


def exact(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """(doc_id, score) of the k nearest by cosine, ties by doc_id: a scan and a bounded top-k, no shuffle of vectors."""
    return vectors.select("doc_id", V.cosine(F.col("embedding"), _literal(query)).alias("score")).orderBy(F.desc(F.round("score", 12)), "doc_id").limit(k)


def signed(vectors: DataFrame, planes: np.ndarray) -> DataFrame:
    return vectors.withColumn("signature", V.signature(F.col("embedding"), planes))


def summary(vectors: DataFrame, dimension: int, planes: int = V.PLANES) -> DataFrame:
    """One row about the buckets of equal signatures. vectors: signed."""
    sizes = vectors.groupBy("signature").agg(F.count("*").alias("n"))
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("num_vectors"), F.lit(dimension).alias("dimension"), F.lit(planes).alias("num_planes"), F.count("*").alias("num_buckets"), F.coalesce(F.max("n"), F.lit(0)).alias("max_bucket_size"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("avg_bucket_size"))


def bucket_sizes(vectors: DataFrame) -> dict[int, int]:
    """Vectors of each signature, at most 2**planes of them. vectors: signed."""
    return {r.signature: r.n for r in vectors.where("signature is not null").groupBy("signature").agg(F.count("*").alias("n")).collect()}


def approximate(vectors: DataFrame, query: list[float], k: int, planes: np.ndarray, sizes: dict[int, int] | None = None) -> DataFrame:
    """(doc_id, score): buckets by rising Hamming distance (ties: signature) until 8k candidates, then ranked by cosine.

    Few vectors, or too few candidates, are searched exactly. vectors: signed, best with the signatures stored; sizes: of its buckets,
    counted here if they aren't given. The search scans one column for the chosen signatures.
    """
    sizes = bucket_sizes(vectors) if sizes is None else sizes
    n = sum(sizes.values())
    if n <= SMALL or k >= n:
        return exact(vectors, query, k)
    bits = sum(1 << i for i, p in enumerate(planes) if float(np.dot(p, np.asarray(query, np.float64))) >= 0)
    chosen, got = [], 0
    for signature in sorted(sizes, key=lambda s: ((s ^ bits).bit_count(), s)):
        if got >= TARGET * k:
            break
        chosen.append(signature)
        got += sizes[signature]
    return exact(vectors.where(F.col("signature").isin(chosen)), query, k)


def with_documents(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, score, title, url): vector hits with what is shown of them; a hit without a live document has no row."""
    return hits.join(documents.where(~F.col("deleted")).select("doc_id", "title", "url"), "doc_id")


def hybrid(results: DataFrame, vectors: DataFrame, query: list[float], limit: int = 20, text_weight: float = 0.7, scale: float = 20.0) -> DataFrame:
    """(doc_id, bm25, similarity, combined): text candidates ranked anew; without a vector the similarity is 0."""
    near = vectors.select("doc_id", V.cosine(F.col("embedding"), _literal(query)).alias("similarity"))
    joined = results.select("doc_id", F.col("score").alias("bm25")).join(near, "doc_id", "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    combined = text_weight * F.least(F.col("bm25") / scale, F.lit(1.0)) + (1 - text_weight) * F.col("similarity")
    return joined.withColumn("combined", combined).orderBy(F.desc(F.round("combined", 9)), F.desc(F.round("bm25", 9)), "doc_id").limit(limit)
