"""Repeated passages, found by MinHash banding of paragraphs.

Texts often repeat passages that don't begin at a line. So paragraphs are cut by content: a word begins one if
the hash of it and its successor is the least within ``REACH`` words on both sides. Equal passages then have equal
cuts inside, whatever surrounds them. A paragraph's MinHash signature over its word pairs is
banded; the bands are tuned for the recall wanted at the threshold. Paragraphs of equal content are
one node. Nodes that collide in a band are verified by the exact Jaccard index of their word pairs: two that are alone in a bucket as a pair, a
larger bucket where all its nodes meet, each of them against all others; a bucket beyond ``BUCKET`` nodes is cut into parts, and each two parts
meet. Of a bucket's links a spanning forest goes on, so a hot bucket gives no more links than it has nodes. The links
are clustered by connected components. Of each cluster the
first occurrence (least doc_id, then place) stays; runs of other occurrences with at least
``MIN_WORDS`` words are marked for removal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IdFilter, checkpointed, distinct_sorted, freed, mix64, partitions, planes, release, table, text_rows, unplanes, word_hashes
from .graph import components

REACH = 6
MIN_WORDS = 20
THRESHOLD = 0.8
RECALL = 0.95
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_FULL = (1 << 64) - 1
BUCKET = 4_000  # nodes that meet in one piece of work
_FLUSH = 200_000  # paragraphs that a task gathers before it sends


def tune(threshold: float = THRESHOLD, recall: float = RECALL, unrelated: float = 0.15, false: float = 1e-3) -> tuple[int, int]:
    """(bands, rows): the fewest rows, with the bands that find pairs at the threshold with the recall, at which paragraphs of similarity ``unrelated`` collide in less than ``false`` of all cases."""
    for rows in range(1, 17):
        bands = max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows) - 1e-9))) if threshold < 1 else 1
        if bands * unrelated**rows <= false and bands * rows <= 128:
            return bands, rows
    raise ValueError("no banding reaches this recall")


def paragraphs(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, first word of each paragraph) of a whole text; empty for texts without words."""
    w, start, _, _ = cut([text])
    return w, start


def cut(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, first word of each paragraph, number of each paragraph's text, first word of each text) of whole texts, one after another.

    They are worked on together, as arrays of one text each are short.
    """
    data = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    w, at, _ = word_hashes(b"\n".join(data))
    begins = np.cumsum([0] + [len(x) + 1 for x in data[:-1]])
    first = np.searchsorted(at, begins)  # of each text
    if not len(w):
        return w, np.empty(0, np.int64), np.empty(0, np.int64), first
    size = np.diff(np.append(first, len(w)))
    place = np.arange(len(w)) - np.repeat(first, size)
    left = np.repeat(size, size) - place  # words to the text's end, itself included
    v = np.append(mix64(w[:-1] * _A + w[1:]), np.uint64(0))
    low = (place >= REACH) & (left - 1 > REACH)  # no cuts near the ends
    m = len(w) - 2 * REACH
    if m > 0:
        inner = np.ones(m, bool)
        mid = v[REACH : REACH + m]
        for d in range(1, REACH + 1):
            inner &= mid < v[REACH - d : REACH - d + m]
            inner &= mid <= v[REACH + d : REACH + d + m]
        low[REACH : REACH + m] &= inner
        low[:REACH] = low[REACH + m :] = False
    else:
        low[:] = False
    low[first[size > 0]] = True
    start = np.flatnonzero(low)
    return w, start, np.searchsorted(first, start, side="right") - 1, first


def digests(w: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A 63-bit hash of each paragraph's sequence of words."""
    place = np.arange(len(w)) - np.repeat(start, np.diff(np.append(start, len(w))))
    s = np.add.reduceat(mix64(w + mix64(place.astype(np.uint64) + _B)), start)
    return mix64(s + np.diff(np.append(start, len(w))).astype(np.uint64) * _A) >> np.uint64(1)


def pair_hashes(w: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Hash of each word and its successor in the paragraph (of the last word, with nothing)."""
    after = np.append(w[1:], np.uint64(0))
    after[np.append(start[1:], len(w)) - 1] = 0
    return mix64(w * _B + after)


def band_keys(pairs: np.ndarray, start: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(paragraphs, bands) 48-bit keys. Each 64-bit hash gives two 32-bit ones, whose minima are two rows of the signature."""
    need = bands * rows
    signature = np.empty((need + need % 2, len(start)), np.uint64)
    for k in range(0, need, 2):
        h = (pairs ^ np.uint64((k + 1) * int(_B) & _FULL)) * np.uint64((int(_A) + (k + 1) * 0x632BE59BD9B4E018) & _FULL)
        h ^= h >> np.uint64(32)
        both = np.minimum.reduceat(h.view(np.uint32).reshape(-1, 2), start, axis=0)
        signature[k], signature[k + 1] = both[:, 0], both[:, 1]
    out = np.empty((len(start), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(start), b + 1, np.uint64)
        for r in range(rows):
            key = mix64(key * _A + signature[b * rows + r])
        out[:, b] = key >> np.uint64(16)
    return out


def _collide(batches, bands: int, rows: int, bits: int):
    """(g, blob) rows: of each flush the distinct (key, digest), where the digest itself is one more key, counted."""
    low = np.uint64(48 - bits)

    def flush(d, keys):
        d, first, count = np.unique(np.concatenate(d), return_index=True, return_counts=True)
        keys = np.concatenate(keys)[first]
        all_keys = np.concatenate([keys.T.ravel(), d >> np.uint64(15)])
        all_d = np.tile(d, bands + 1)
        all_c = np.concatenate([np.zeros(bands * len(d), np.uint64), np.minimum(count, 255).astype(np.uint64)])
        order = np.argsort(all_keys, kind="stable")
        all_keys, all_d, all_c = all_keys[order], all_d[order], all_c[order]
        cuts = np.searchsorted(all_keys, np.arange((1 << bits) + 1, dtype=np.uint64) << low)
        mask = (np.uint64(1) << low) - np.uint64(1)
        gs, blobs = [], []
        for g in np.flatnonzero(np.diff(cuts)):
            at = slice(cuts[g], cuts[g + 1])
            own = all_c[at] > 0  # a digest's own entry needs no copy of it but its low bits
            gs.append(int(g))
            blobs.append(np.array([len(own), own.sum()], np.uint64).tobytes() + planes(np.diff(all_keys[at] & mask, prepend=np.uint64(0)), 5) + planes(all_c[at], 1) + planes(all_d[at][~own], 8) + planes(all_d[at][own] & np.uint64(0x7FFF), 2))
        for at in range(0, len(gs), 32):
            yield pa.RecordBatch.from_arrays([pa.array(gs[at : at + 32], pa.int32()), pa.array(blobs[at : at + 32], pa.binary())], ["g", "blob"])

    held_d, held_k, size = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            w, start, _, _ = cut(batch.slice(at, 256).column(0).to_pylist())
            if len(w):
                held_d.append(digests(w, start))
                held_k.append(band_keys(pair_hashes(w, start), start, bands, rows))
                size += len(start)
            if size > _FLUSH:
                yield from flush(held_d, held_k)
                held_d, held_k, size = [], [], 0
    if size:
        yield from flush(held_d, held_k)
        held_d, held_k = [], []
    release()


def _stars(batches, bits: int):
    """Of rows in order of g: (k, a, b) candidates, a the least digest of a bucket, k its key if it has three or more; (null, a, null) digests that occur twice or more."""
    low = np.uint64(48 - bits)

    def solve(g, blobs):
        keys, counts, ds = [], [], []
        base = np.uint64(g) << low
        for raw in blobs:
            n, own = (int(x) for x in np.frombuffer(raw, np.uint64, 2))
            at = 16
            k = np.cumsum(unplanes(raw[at : at + 5 * n], 5), dtype=np.uint64) + base
            c = unplanes(raw[at + 5 * n : at + 6 * n], 1)
            at += 6 * n
            d = np.empty(n, np.uint64)
            mine = c > 0
            d[~mine] = unplanes(raw[at : at + 8 * (n - own)], 8)
            d[mine] = k[mine] << np.uint64(15) | unplanes(raw[at + 8 * (n - own) :], 2)
            keys.append(k)
            counts.append(c)
            ds.append(d)
        k, c, d = np.concatenate(keys), np.concatenate(counts), np.concatenate(ds)
        order = np.lexsort((d, k))
        k, c, d = k[order], c[order], d[order]
        mine = c > 0
        own = d[mine]
        if len(own):
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            many = own[first][np.add.reduceat(c[mine].astype(np.int64), first) > 1]
            yield None, many, None
        k, d = k[~mine], d[~mine]
        if len(k):
            new = np.concatenate(([True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])))
            k, d = k[new], d[new]
            first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            size = np.diff(np.append(first, len(k)))
            head, size = np.repeat(d[first], size), np.repeat(size, size)
            other = head != d
            yield np.where(size > 2, k, np.uint64(_FULL))[other], head[other], d[other]

    def rows(g, blobs):
        for k, a, b in solve(g, blobs):
            for at in range(0, len(a), 100_000):
                x = pa.array(a[at : at + 100_000].astype(np.int64))
                none = pa.nulls(len(x), pa.int64())
                key = none if k is None else pa.array(k[at : at + 100_000].astype(np.int64), mask=k[at : at + 100_000] == np.uint64(_FULL))
                yield pa.RecordBatch.from_arrays([key, x, none if b is None else pa.array(b[at : at + 100_000].astype(np.int64))], ["k", "a", "b"])

    now, blobs = None, []
    for batch in batches:
        for g, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if g != now and blobs:
                yield from rows(now, blobs)
                blobs = []
            now = g
            blobs.append(raw)
    if blobs:
        yield from rows(now, blobs)
    release()


def forest(names: np.ndarray, sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """A spanning forest of the graph of sets whose Jaccard index is at the threshold or above: each set is compared with all others until all are connected."""
    m = len(sets)
    size = np.array([len(x) for x in sets])
    tokens, place = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    mark = np.zeros(len(tokens), np.int32)
    label, parts, out = np.arange(m), m, []
    for i in range(m):
        if parts == 1:
            break
        own = place[start[i] : start[i] + size[i]]
        mark[own] = 1
        both = np.add.reduceat(mark[place], start)
        mark[own] = 0
        near = np.flatnonzero((both >= threshold * (size + size[i] - both)) & (label != label[i]))
        if len(near):
            others, first = np.unique(label[near], return_index=True)
            out += [(int(names[i]), int(names[k])) for k in near[first]]
            label[np.isin(label, others)] = label[i]
            parts -= len(others)
    return out


def _forests(batches, threshold: float):
    """Of rows (k, i, j, d, s) in order of (k, i, j): the links of a forest of each group's sets."""

    def solve(held):
        links = forest(np.array([d for d, _ in held]), [np.frombuffer(s, np.int64) for _, s in held], threshold)
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    now, held = None, []
    for batch in batches:
        for k, i, j, d, s in zip(*(batch.column(c).to_pylist() for c in range(5))):
            if (k, i, j) != now:
                if len(held) > 1:
                    yield solve(held)
                now, held = (k, i, j), []
            held.append((d, s))
    if len(held) > 1:
        yield solve(held)
    release()


def repeated_passages(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document id: doc_id, n_removed (words), spans (word offsets ``start:end`` of removed passages, comma-joined).

    Texts without words, and null ids, have nothing removed; a null id's passages still count as
    occurrences, after all others. Repeated ids give one row; rows with the same id and the same text hold the
    same passages at the same places, which count as one occurrence.
    """
    spark = docs.sparkSession
    n = partitions(docs)
    bits = max(8, (4 * n - 1).bit_length())
    bands, rows = tune(threshold, recall)
    texts = docs.select("text")
    met = texts.mapInArrow(lambda b: _collide(b, bands, rows, bits), "g int, blob binary").repartition(n, "g").sortWithinPartitions("g").mapInArrow(lambda b: _stars(b, bits), "k long, a long, b long")
    met = checkpointed(met)
    freed(spark)
    candidates = met.where("b is not null").select("k", "a", "b")
    ends = candidates.select("a").union(candidates.select("b")).distinct()
    gate = spark.sparkContext.broadcast(IdFilter(ends, "a"))

    def contents(batches):
        seen = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                names, sets = [], []
                w, start, _, _ = cut(batch.slice(at, 256).column(0).to_pylist())
                if not len(w):
                    continue
                d = digests(w, start).astype(np.int64)
                hits = np.flatnonzero(gate.value.maybe(d))
                if len(hits):
                    pairs, ends_ = pair_hashes(w, start), np.append(start[1:], len(w))
                    for i in hits:
                        if d[i] not in seen:
                            seen.add(d[i])
                            names.append(d[i])
                            sets.append(distinct_sorted(pairs[start[i] : ends_[i]]).astype(np.int64).tobytes())
                if len(seen) > 500_000:
                    seen = set()
                if names:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], ["d", "s"])

    def verify(batches):
        for batch in batches:
            a_out, b_out = [], []
            for a, b, x, y in zip(*(batch.column(i).to_pylist() for i in range(4))):
                x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= threshold * (len(x) + len(y) - both):
                    a_out.append(a)
                    b_out.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    sets = checkpointed(texts.mapInArrow(contents, "d long, s binary").join(ends, F.col("d") == F.col("a"), "left_semi").dropDuplicates(["d"]))

    def verified(pairs: DataFrame) -> DataFrame:
        joined = pairs.join(sets.select(F.col("d").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("d").alias("b"), F.col("s").alias("y")), "b").select("a", "b", "x", "y")
        return checkpointed(joined.mapInArrow(verify, "a long, b long"))

    links = verified(candidates.where("k is null").select("a", "b").distinct())
    # larger buckets: their nodes' sets meet
    starred = met.where("k is not null and b is not null")
    nodes = starred.select("k", F.col("b").alias("d")).union(starred.select("k", F.col("a").alias("d")).distinct()).distinct()
    parts = checkpointed(nodes.groupBy("k").agg(F.ceil(F.count("*") / BUCKET).cast("int").alias("parts")).where("parts > 1")).withColumnRenamed("k", "hot")
    nodes = nodes.join(parts, F.col("k") == F.col("hot"), "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("p", F.expr("cast(pmod(xxhash64(d), parts) as int)"))
    nodes = nodes.select("k", "d", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least(q, F.col("p")).alias("i"), F.greatest(q, F.col("p")).alias("j")))).alias("at")).select("k", "at.i", "at.j", "d")
    meeting = nodes.join(sets, "d").select("k", "i", "j", "d", "s").repartition(n, "k", "i", "j").sortWithinPartitions("k", "i", "j", "d")
    links = links.union(checkpointed(meeting.mapInArrow(lambda b: _forests(b, threshold), "a long, b long").distinct()))
    clusters = components(links)
    # roots: cluster of every digest that occurs more than once or has a similar one
    many = met.where("b is null").select(F.col("a").alias("node")).distinct()
    roots = checkpointed(many.join(clusters, "node", "full").select("node", F.coalesce("component", "node").alias("root")))
    gate2 = spark.sparkContext.broadcast(IdFilter(roots, "node"))

    def occurrences(batches):
        for ids, texts_ in text_rows(batches):
            w, start, of, first = cut(texts_)
            if len(w):
                d = digests(w, start).astype(np.int64)
                hits = np.flatnonzero(gate2.value.maybe(d))
                if len(hits):
                    names = np.array([(1 << 63) - 1 if i is None else i for i in ids], np.int64)[of[hits]]
                    base = first[of[hits]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (d[hits], names, start[hits] - base, np.append(start[1:], len(w))[hits] - base)], ["node", "doc_id", "start", "end"])

    at = checkpointed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(occurrences, "node long, doc_id long, start long, end long").join(roots, "node").select("root", "doc_id", "start", "end"))
    first = at.groupBy("root").agg(F.min(F.struct("doc_id", "start")).alias("first"))
    extra = at.join(first, "root").where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("start") != F.col("first.start"))).where(f"doc_id <> {(1 << 63) - 1}")
    # adjacent paragraphs make one passage
    runs = extra.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("s"))
    merged = F.expr(
        """aggregate(s, cast(array() as array<struct<start: bigint, end: bigint>>), (acc, x) ->
             if(size(acc) > 0 and acc[size(acc) - 1].end >= x.start,
                concat(slice(acc, 1, size(acc) - 1), array(struct(acc[size(acc) - 1].start as start, greatest(acc[size(acc) - 1].end, x.end) as end))),
                concat(acc, array(x))))"""
    )
    runs = runs.select("doc_id", F.filter(merged, lambda x: x["end"] - x["start"] >= min_words).alias("s"))
    runs = runs.select("doc_id", F.expr("aggregate(s, 0L, (t, x) -> t + x.end - x.start)").alias("n_removed"), F.expr("array_join(transform(s, x -> concat(x.start, ':', x.end)), ',')").alias("spans"))
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return ids.join(runs, "doc_id", "left").select("doc_id", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("spans", F.lit("")).alias("spans"))


def without_passages(text: str, spans: str) -> str:
    """The text without the words of the spans, and without the white space before each of them."""
    if not spans:
        return text
    data = text.encode("utf-8", "surrogatepass")
    _, start, end = word_hashes(data)
    out, at = [], 0
    for a, b in (map(int, s.split(":")) for s in spans.split(",")):
        out.append(data[at : end[a - 1] if a else 0])
        at = end[b - 1]
    return (b"".join(out) + data[at:]).decode("utf-8", "surrogatepass")


def op9_paragraph_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
