"""Search as a service: an index that stays loaded, answers as plain rows, a result cache and a query log."""

from __future__ import annotations

import time
from collections import OrderedDict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import search as se
from .operators import suggest, vector
from .operators.cache import TTL
from .operators.index import Index
from .sources import tables
from .sources.embedders import Embedder, HashingEmbedder, embed_texts

MODES = ("fulltext", "vector", "hybrid")
CANDIDATES = 100  # text results that a hybrid search ranks anew


@dataclass
class Service:
    spark: SparkSession
    index: Index
    vectors: DataFrame | None = None
    embedder: Embedder = field(default_factory=HashingEmbedder)
    log: str | None = None
    cache_size: int = 0
    _cache: OrderedDict = field(default_factory=OrderedDict, repr=False)

    @staticmethod
    def load(spark: SparkSession, root: str, vectors: DataFrame | None = None, **options) -> Service:
        index = Index.load_current(spark, root) or Index.load(spark, root)
        kept = Index(index.documents.persist(), index.postings.persist(), index.terms().persist())
        return Service(spark, kept, None if vectors is None else vectors.persist(), **options)

    def search(self, query: str, mode: str = "fulltext", limit: int = 10, domain: str | None = None, after: int | None = None, before: int | None = None, expand: bool = False) -> list[dict]:
        """Rows of title, url, snippet, score. A blank query or an unknown mode raises ValueError.

        Equal searches (in any case) within the cache's age are answered from it.
        """
        query = query.strip()
        if not query:
            raise ValueError("the query is empty")
        if mode not in MODES or mode != "fulltext" and self.vectors is None:
            raise ValueError(f"no search of mode {mode}")
        key, began = (query.lower(), mode, limit, domain, after, before, expand), time.time()
        held = self._cache.get(key)
        if held and began - held[0] <= TTL:
            self._cache.move_to_end(key)
            rows = held[1]
        else:
            rows = [r.asDict() for r in self._run(query, mode, limit, domain, after, before, expand).collect()]
            if self.cache_size:
                self._cache[key] = (began, rows)
                self._cache.move_to_end(key)
                while len(self._cache) > self.cache_size:
                    self._cache.popitem(last=False)
        if self.log:
            tables.log_query(self.spark, self.log, query, len(rows), (time.time() - began) * 1000, mode)
        return rows

    def _run(self, query, mode, limit, domain, after, before, expand) -> DataFrame:
        asked = suggest_expanded(self.spark, query) if expand else query
        if mode == "vector":
            [q] = embed_texts([query], self.embedder)
            hits = vector.exact(self.vectors, q, limit)
            hits = vector.with_documents(hits, self.index.documents).select("doc_id", "score")
        else:
            hits = se.search(self.index, [(0, asked)], cap=CANDIDATES if mode == "hybrid" else se.CAP).select("doc_id", "score")
            if mode == "hybrid":
                [q] = embed_texts([query], self.embedder)
                hits = vector.hybrid(hits, self.vectors, q, limit).select("doc_id", F.col("combined").alias("score"))
        hits = se.filter_results(hits, self.index.documents, domain, after, before)
        ranked = hits.orderBy(F.desc(F.round("score", 9)), "doc_id").limit(limit).withColumn("rank", F.row_number().over(se.Window.orderBy(F.desc(F.round("score", 9)), "doc_id")))
        return se.display(ranked, self.index, query).orderBy("rank").select("title", "url", "snippet", "score")

    def suggest(self, prefix: str, limit: int = 10) -> list[dict]:
        """Terms and frequencies; none for a blank prefix."""
        prefix = prefix.strip()
        return [{"term": r.term, "frequency": r.df} for r in suggest.suggest(self.index.terms(), prefix, limit).collect()] if prefix else []


def suggest_expanded(spark: SparkSession, query: str) -> str:
    return spark.sql("SELECT * FROM VALUES (:q) AS v(q)", {"q": query}).select(suggest.expand(F.col("q"))).first()[0]
