"""Exact fingerprints of canonical text, and the groups of equal documents.

Canonical text: NFKC, case folding, white space runs folded to one space, ends stripped. The
fingerprint is the 128-bit xxh3 digest of its UTF-8 bytes. Inside a bucket of equal digests the bytes
themselves are compared, so that a collision splits the bucket.
"""

from __future__ import annotations

import hashlib
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IdFilter, checkpointed, freed, partitions, table


def canonical(text: str | None) -> bytes:
    """Null counts as empty."""
    if not text:
        return b""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split()).encode("utf-8", "surrogatepass")


def fingerprint(text: str | None) -> str:
    return xxhash.xxh3_128_hexdigest(canonical(text))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row, in one pass."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([fingerprint(t) for t in part.column(1).to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


HELD = 64 << 20  # bytes of distinct texts that a task gathers before it sends


def equal_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, group_id): group_id is the least doc_id with the same canonical bytes.

    Null and empty texts form one group; a null id is kept and never names a group unless all ids of it are null. Repeated ids are rows
    of their own; an empty table gives no rows.
    """
    return grouped(docs, checkpointed(fingerprints(docs)))


def grouped(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """The rows of ``prints`` (doc_id, fingerprint and others, of the same documents) with group_id.

    Buckets with one row are settled by their digest alone. Of the others, the canonical bytes are compared: each task sends one row per
    digest and distinct bytes among its texts, so a hot bucket is a row per task, and these are aggregated by digest and bytes (packed, which
    keeps different ones different). A bucket
    of several contents is split into them.
    """
    n = partitions(docs)
    crowded = prints.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint")
    ids = checkpointed(prints.join(crowded, "fingerprint", "left_semi").select("doc_id").distinct())
    gate = docs.sparkSession.sparkContext.broadcast(IdFilter(ids, "doc_id"))

    def contents(batches):
        held: dict[tuple[str, bytes], int | None] = {}
        size = 0

        def sent():
            rows = list(held.items())
            for at in range(0, len(rows), 256):
                part = rows[at : at + 256]
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in part], pa.string()), pa.array([zlib.compress(k[1], 1) for k, _ in part], pa.binary()), pa.array([v for _, v in part], pa.int64())], ["fingerprint", "bytes", "least"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                known = part.column(0).is_valid().to_numpy(zero_copy_only=False)
                part = part.filter(pa.array(gate.value.maybe(part.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) | ~known))
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    data = canonical(t)
                    key = (xxhash.xxh3_128_hexdigest(data), data)
                    if key not in held:
                        size += len(data) + 100
                        held[key] = i
                    elif i is not None and (held[key] is None or i < held[key]):
                        held[key] = i
                if size > HELD:
                    yield from sent()
                    held, size = {}, 0
        yield from sent()

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(contents, "fingerprint string, bytes binary, least long")
    # laid out by digest, which serves both aggregations
    kinds = found.repartition(n, "fingerprint").groupBy("fingerprint", "bytes").agg(F.min("least").alias("least"))
    kinds = checkpointed(kinds.groupBy("fingerprint").agg(F.count("*").alias("kinds"), F.min("least").alias("only")))
    joined = prints.join(kinds, "fingerprint", "left")
    if kinds.where("kinds > 1").isEmpty():
        return joined.select(*prints.columns, F.coalesce("only", "doc_id").alias("group_id"))
    # digests of several contents: their texts are read again
    split = kinds.where("kinds > 1").select("fingerprint")
    own = digests(docs).join(split, "fingerprint", "left_semi")
    leasts = own.groupBy("fingerprint", "bytes").agg(F.min("doc_id").alias("least"))
    named = own.join(leasts, ["fingerprint", "bytes"]).groupBy("doc_id", "fingerprint").agg(F.min("least").alias("split_id")).select(F.col("doc_id").alias("i"), F.col("fingerprint").alias("f"), "split_id")
    joined = joined.join(named, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("fingerprint") == F.col("f")), "left")
    return joined.select(*prints.columns, F.coalesce("split_id", "only", "doc_id").alias("group_id"))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, canonical bytes) of every row."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                data = [canonical(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([xxhash.xxh3_128_hexdigest(d) for d in data], pa.string()), pa.array(data, pa.binary())], ["doc_id", "fingerprint", "bytes"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string, bytes binary")


def with_successor(docs: DataFrame, rows_per_range: int = 4096) -> DataFrame:
    """Each row beside the head of the next row's text in ascending doc_id (after the last, the first).

    doc_id, n_chars, edited text and next text's fingerprint are worked out while the rows stream by in
    order: ranges of doc_id are hash-distributed, sorted inside a task, and each range also gets a copy
    of the first row of the next range. The whole texts are shuffled once. The bounds of the ranges are
    quantiles of the ids: their number is the session's shuffle width, whatever the number of rows.
    Rows of equal or null ids (nulls first) follow each other in order of their texts.
    """
    n = partitions(docs)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.col("doc_id").isNull().alias("null_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    cuts = sorted(set(int(x) for x in ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)).first()[0] or []))
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    # how many cuts are below an id, by bisection
    bucket = lambda c: F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when((at + step <= len(cuts)) & (F.get(F.array(*map(F.lit, cuts)), at + step - 1) < c), at + step).otherwise(at)) if cuts else F.lit(0)
    heads = {r.b: r.m for r in ids.groupBy(bucket(F.col("doc_id")).alias("b")).agg(F.min("doc_id").alias("m")).collect()}
    order = sorted(heads)
    # the head of each range also goes, marked, to the range before it; the very first one to the last
    copies = [(heads[b], order[i - 1] if i else order[-1], i == 0) for i, b in enumerate(order)]
    placed = rows.withColumn("b", bucket(F.col("doc_id")))
    # one row per range (at most the shuffle width of them): small by construction
    spark = docs.sparkSession
    heads_df = spark.createDataFrame([(h, to, 2 if wrap else 1) for h, to, wrap in copies], "doc_id long, to_b int, to_kind int")
    placed = placed.join(F.broadcast(heads_df), "doc_id", "left")
    here = F.struct(F.col("b"), F.lit(0).alias("kind"))
    there = F.when(F.col("to_b").isNotNull(), F.struct(F.col("to_b").alias("b"), F.col("to_kind").alias("kind")))
    placed = placed.withColumn("at", F.explode(F.array_compact(F.array(here, there)))).select("doc_id", "null_id", "text", "at.b", "at.kind")
    placed = placed.repartitionById(max(n, len(cuts) + 1), "b").sortWithinPartitions("b", (F.col("kind") == 2), "doc_id", "kind", "text")
    return placed


def _pairs(batches):
    """Stream (row, next row) of each range; a head's copy ends its range."""
    held = None  # (b, id, null, text)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256).to_pydict()
            for i, null, text, b, kind in zip(part["doc_id"], part["null_id"], part["text"], part["b"], part["kind"]):
                if held is not None and held[0] == b:
                    yield held, text
                    held = None
                if kind == 0:
                    held = (b, i, null, text)
                elif held is not None and held[0] != b:
                    held = None


def edited(text: str, following: str) -> str:
    """The last floor(n/4) code points replaced by the first as many (or all) of the following text."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def op8_canonical_digest(spark, sf_dir: str) -> DataFrame:
    """Fingerprint of each document and of its edited text; likeness is 1 for equal canonical digests, else 0. group_id: of equal canonical bytes, the least doc_id."""
    docs = table(spark, sf_dir, "documents")

    def run(batches):
        rows: list[tuple] = []
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        last: tuple = (None, "")  # the following text and its fingerprint, often the next row's own
        for (_, i, null, text), after in _pairs(batches):
            other = edited(text, after)
            own = last[1] if last[0] is text else fingerprint(text)
            last = (after, fingerprint(after))
            changed = fingerprint(other)
            rows.append((None if null else i, len(text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), own, changed, float(own == changed), float(own == last[1])))
            if len(rows) == 1024:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    rows = with_successor(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    rows = checkpointed(rows)
    freed(spark)
    return grouped(docs, rows)
