"""Text embedders behind one protocol: offline hashing, or a service over HTTP."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.request
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

DIMENSION, MOST_BYTES = 768, 2000


class Embedder(Protocol):
    dimension: int

    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


def prepared(text: str | None) -> str:
    """Cut to 2,000 bytes at a character's end, trimmed; null is empty."""
    return (text or "").encode("utf-8", "surrogatepass")[:MOST_BYTES].decode("utf-8", "ignore").strip()


@dataclass
class HashingEmbedder:
    """Signed counts of words and pairs of words in hashed places, of length one: deterministic, without any service."""

    dimension: int = DIMENSION

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts):
            words = text.lower().split()
            for term in [*words, *map(" ".join, zip(words, words[1:]))]:
                h = int.from_bytes(hashlib.blake2b(term.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
                row[(h >> 1) % self.dimension] += 1 if h & 1 else -1
            n = np.linalg.norm(row)
            row /= n or 1.0
        return out.astype(np.float32).tolist()


@dataclass
class HttpEmbedder:
    """A service that takes {model, input: [texts]} and answers with vectors, wherever ``path`` finds them.

    path: keys and "*" (each of a list) down to the vectors, such as ("data", "*", "embedding"). per_minute: at most so many requests by
    each task that embeds; a rate of the whole job needs as few partitions as the service has permits.
    """

    url: str
    model: str
    dimension: int = DIMENSION
    headers: dict[str, str] = field(default_factory=dict)
    path: tuple[str, ...] = ("embeddings",)
    per_minute: float | None = None
    timeout: float = 60
    _last: float = field(default=-1e9, repr=False)

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        if self.per_minute:
            time.sleep(max(0.0, self._last + 60 / self.per_minute - time.monotonic()))
            self._last = time.monotonic()
        body = json.dumps({"model": self.model, "input": texts}).encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json", **self.headers})
        with urllib.request.urlopen(request, timeout=self.timeout) as r:
            return answered(json.load(r), self.path)


def answered(reply, path: tuple[str, ...]):
    for i, key in enumerate(path):
        if key == "*":
            return [answered(x, path[i + 1 :]) for x in reply]
        reply = reply[key]
    return reply


def embed_texts(texts: list[str | None], embedder: Embedder) -> list[list[float]]:
    """Vectors of texts as they come; if all are empty, zero vectors without a call. A service that gives too few raises."""
    ready = [prepared(t) for t in texts]
    if not any(ready):
        return [[0.0] * embedder.dimension for _ in ready]
    got = embedder.embed_batch(ready)
    if len(got) != len(ready):
        raise ValueError(f"{len(ready)} texts, {len(got)} vectors")
    return got


def embed(rows: DataFrame, embedder: Embedder, text: str = "text", key: str = "doc_id", batch: int = 32) -> DataFrame:
    """(key, embedding) of every row, in calls of ``batch`` texts."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(embed_texts(part.column(1).to_pylist(), embedder), pa.list_(pa.float32()))], [key, "embedding"])

    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, embedding array<float>")
