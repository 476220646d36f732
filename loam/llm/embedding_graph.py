"""Near duplicates among embeddings by a robust-pruned flat graph.

1. Vectors are normalised in double precision; equal ones form a class that is searched once.
2. Pivots cut the space into overlapping clusters: each vector goes to its ``OVERLAP`` nearest pivots. A cluster beyond
   ``SHARD`` vectors is salted into blocks of about that many, so no task's shard grows with the input.
3. In every block a flat proximity graph is built: nearest neighbours, robust-pruned (a neighbour that
   lies much nearer to one already chosen is dropped), with back edges.
4. Every vector is a query: greedy search over the graph of each of its blocks, from the medoid, first
   to the query's surroundings, then range-expanding over all within the search radius.
5. The graph of the whole is the union of the adjacency lists. The expansion crosses clusters in rounds: where a query
   has found a node within the slack, it becomes a guest of the node's other clusters, until no query has a new one.
   A guest meets all vectors of a cluster exactly, hence all that the node's lists there hold. So do the blocks
   of a salted cluster, each pair of them, whatever their number.
6. Hits are verified by the exact cosine in double precision.
7. ``audit`` measures recall against brute force on a stated query set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, mix64, partitions, table
from .graph import components

THRESHOLD = 0.95
DEGREE = 24
ALPHA = 1.2
OVERLAP = 2
SHARD = 4_000
SLACK = 0.08  # searches go on over nodes whose similarity is this much below the threshold


def unit(v: np.ndarray) -> np.ndarray:
    """A vector that isn't zero, of length one; scaled first, as squares of large components would overflow and those of small ones vanish."""
    v = v / np.abs(v).max()
    return v / np.linalg.norm(v)


def usable(vectors: list) -> np.ndarray:
    """Which rows have a vector of finite components, not all zero."""
    ok = np.zeros(len(vectors), bool)
    for i, v in enumerate(vectors):
        if v is not None and len(v) and None not in v:
            a = np.asarray(v, np.float64)
            ok[i] = bool(np.isfinite(a).all() and a.any())
    return ok


def build(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[np.ndarray]:
    """Adjacency lists of a shard: robust-pruned nearest neighbours and back edges. Deterministic."""
    n = len(x)
    wide = min(n - 1, 3 * degree)
    lists: list[np.ndarray] = []
    for at in range(0, n, 512):
        sims = x[at : at + 512] @ x.T
        sims[np.arange(len(sims)), np.arange(at, at + len(sims))] = -2
        near = np.argpartition(-sims, wide - 1, axis=1)[:, :wide] if wide else np.empty((len(sims), 0), int)
        for r, c in enumerate(near):
            c = c[np.lexsort((c, -sims[r, c]))]
            lists.append(_prune(x, sims[r, c], c, degree, alpha))
    back: list[list[int]] = [[] for _ in range(n)]
    for i, c in enumerate(lists):
        for j in c:
            back[j].append(i)
    for i in range(n):
        both = np.union1d(lists[i], np.array(back[i], int)).astype(int)
        if len(both) > 2 * degree:
            s = x[both] @ x[i]
            o = np.lexsort((both, -s))
            both = _prune(x, s[o], both[o], 2 * degree, alpha)
        lists[i] = both
    return lists


def _prune(x: np.ndarray, sims: np.ndarray, c: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of candidates by falling similarity, those that no kept one is ``alpha`` times nearer to."""
    dist = np.sqrt(np.maximum(0, 2 - 2 * sims))
    among = x[c] @ x[c].T
    between = np.sqrt(np.maximum(0, 2 - 2 * among))
    alive = np.ones(len(c), bool)
    kept = []
    for i in range(len(c)):
        if alive[i]:
            kept.append(i)
            if len(kept) == degree:
                break
            alive &= ~(alpha * between[i] <= dist)
    return c[kept]


def walk(x: np.ndarray, lists: list[np.ndarray], queries: np.ndarray, medoid: int, most: int = 64) -> np.ndarray:
    """Greedy search: for each query the node at which a walk from the medoid finds no neighbour nearer to it."""
    at = np.full(len(queries), medoid)
    best = x[queries] @ x[medoid]
    moving = np.arange(len(queries))
    for _ in range(most):
        if not len(moving):
            break
        still = []
        for i in moving.tolist():
            near = lists[at[i]]
            if len(near):
                s = x[near] @ x[queries[i]]
                j = int(s.argmax())
                if s[j] > best[i]:
                    best[i], at[i] = s[j], near[j]
                    still.append(i)
        moving = np.array(still, int)
    return at


def expand_all(x: np.ndarray, lists: list[np.ndarray], threshold: float, hops: int = 2, slack: float = SLACK) -> tuple[np.ndarray, np.ndarray]:
    """Range expansion of all rows of a block at once: pairs (i, j), i < j, within the threshold less the slack.

    Every row is a query. It starts where its greedy walk from the medoid ends, and at its own node, and expands
    over neighbours within that radius until nothing new is near.
    """
    n = len(x)
    width = np.array([len(c) for c in lists])
    flat = np.concatenate(lists) if n and width.sum() else np.empty(0, int)
    offset = np.concatenate(([0], np.cumsum(width)))
    near = threshold - slack
    out_a, out_b = [], []
    medoid = int((x @ x.mean(0)).argmax()) if n else 0
    for at in range(0, n, 256):
        queries = np.arange(at, min(at + 256, n))
        seen = np.zeros((len(queries), n), bool)
        q = np.arange(len(queries))
        node = queries.copy()
        seen[q, node] = True
        far = walk(x, lists, queries, medoid)
        other = np.flatnonzero(far != queries)
        seen[other, far[other]] = True
        s = np.einsum("ij,ij->i", x[queries[other]], x[far[other]])
        out_a.append(queries[other[s >= near - 1e-6]])
        out_b.append(far[other[s >= near - 1e-6]])
        q, node = np.concatenate([q, other]), np.concatenate([node, far[other]])
        step = 0
        while len(q):
            many = width[node]
            qq = np.repeat(q, many)
            nn = flat[np.repeat(offset[node] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())]
            new = ~seen[qq, nn]
            code = np.unique(qq[new] * n + nn[new])
            qq, nn = code // n, code % n
            seen[qq, nn] = True
            s = np.einsum("ij,ij->i", x[queries[qq]], x[nn])
            hit = s >= near - 1e-6
            out_a.append(queries[qq[hit]])
            out_b.append(nn[hit])
            go = (s >= near) if step >= hops else np.ones(len(s), bool) if step < 1 else s >= near - 0.15
            q, node = qq[go], nn[go]
            step += 1
    a, b = np.concatenate(out_a) if out_a else np.empty(0, int), np.concatenate(out_b) if out_b else np.empty(0, int)
    low, high = np.minimum(a, b), np.maximum(a, b)
    code = np.unique(low * max(n, 1) + high)
    return code // max(n, 1), code % max(n, 1)


def _classes(rows: DataFrame) -> DataFrame:
    """(vec_id, cls, ok): cls is a hash of the vector's bytes; unusable vectors have none."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                vectors = part.column(1).to_pylist()
                ok = usable(vectors)
                names, data = [], []
                for v, good in zip(vectors, ok):
                    if good:
                        a = np.asarray(v, np.float64) + 0.0
                        h = mix64(a.view(np.uint64) + np.arange(len(a), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64, keepdims=True)
                        names.append(int(mix64(h)[0] >> np.uint64(1)))
                        data.append(unit(a).tobytes())
                    else:
                        names.append(None)
                        data.append(None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.int64()), pa.array(data, pa.binary())], ["vec_id", "cls", "v"])

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, cls long, v binary")


def _pivots(vectors: DataFrame, count: int) -> dict[int, tuple[int, np.ndarray]]:
    """Length -> (number of its first pivot, pivots): a bounded set, the ``count`` classes of least hash."""
    rows = vectors.orderBy(F.xxhash64("cls"), "cls").limit(count).toArrow()
    by_length: dict[int, list[np.ndarray]] = {}
    for v in rows.column("v"):
        v = np.frombuffer(v.as_py(), np.float64)
        by_length.setdefault(len(v), []).append(v)
    out, first = {}, 0
    for n, vs in sorted(by_length.items()):
        out[n] = (first, np.stack(vs))
        first += len(vs)
    return out


def similar_vectors(vectors: DataFrame, threshold: float = THRESHOLD, degree: int = DEGREE, shard: int = SHARD, overlap: int = OVERLAP) -> tuple[DataFrame, DataFrame]:
    """(members, links): members has vec_id and cls of every row; links the pairs of classes at or above the threshold."""
    rows = checkpointed(_classes(vectors))
    members = rows.select("vec_id", "cls")
    distinct = rows.where("cls is not null").groupBy("cls").agg(F.first("v").alias("v"))
    distinct = checkpointed(distinct)
    n = distinct.count()
    pivots = _pivots(distinct, max(1, min(4096, -(-n * overlap * 2 // shard))))

    def place(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = [np.frombuffer(v, np.float64) for v in part.column(1).to_pylist()]
                rows_, where = [], []
                lengths = np.array([len(v) for v in x])
                for n in np.unique(lengths).tolist():
                    good = np.flatnonzero(lengths == n)
                    if n not in pivots:  # a rare length, one cluster
                        rows_ += good.tolist()
                        where += [-n] * len(good)
                        continue
                    first, of_length = pivots[n]
                    s = np.stack([x[i] for i in good]) @ of_length.T
                    k = min(overlap, s.shape[1])
                    near = np.argsort(-s, axis=1, kind="stable")[:, :k]
                    for r, c in zip(good, near):
                        rows_ += [int(r)] * k
                        where += [first + int(p) for p in c]
                yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), part.column(0).take(pa.array(rows_, pa.int64())), part.column(1).take(pa.array(rows_, pa.int64()))], ["c", "cls", "v"])

    def opened(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names, vectors and clusters (filled up with the first) of a block's rows, by name."""
        t = t.sort_by("cls")
        homes = [h + h[:1] * (overlap - len(h)) for h in t.column("homes").to_pylist()]
        return t.column("cls").to_numpy(), np.stack([np.frombuffer(v, np.float64) for v in t.column("v").to_pylist()]), np.array(homes, np.int64)

    def found(a, b, sims, homes_a, homes_b) -> pa.Table:
        """Links (a, b, null), and routes (query, null, cluster) to the clusters of near nodes that aren't the query's own."""
        hit = sims >= threshold
        routes = []
        for q, own, other in ((a, homes_a, homes_b), (b, homes_b, homes_a)):
            for k in range(other.shape[1]):
                go = (own != other[:, k : k + 1]).all(1)
                routes.append(np.stack([q[go], other[go, k]], 1))
        r = np.unique(np.concatenate(routes), axis=0)
        low, high = np.minimum(a[hit], b[hit]), np.maximum(a[hit], b[hit])
        return pa.table({"a": pa.array(np.concatenate([low, r[:, 0]]), pa.int64()), "b": pa.concat_arrays([pa.array(high, pa.int64()), pa.nulls(len(r), pa.int64())]), "c": pa.concat_arrays([pa.nulls(len(low), pa.int64()), pa.array(r[:, 1], pa.int64())])})

    def solve(t: pa.Table) -> pa.Table:
        names, x, homes = opened(t)
        a, b = expand_all(x, build(x, degree), threshold)
        return found(names[a], names[b], np.einsum("ij,ij->i", x[a], x[b]), homes[a], homes[b])

    def meet(t: pa.Table, guests: pa.Table) -> pa.Table:
        out = []
        if t.num_rows and guests.num_rows:
            names, x, homes = opened(t)
            others, y, others_homes = opened(guests.rename_columns([k.removeprefix("guest_") for k in guests.column_names]))
            for at in range(0, len(y), 256):
                q, i = np.nonzero(y[at : at + 256] @ x.T >= threshold - SLACK - 1e-6)
                q += at
                q, i = q[others[q] != names[i]], i[others[q] != names[i]]
                out.append(found(others[q], names[i], np.einsum("ij,ij->i", y[q], x[i]), others_homes[q], homes[i]))
        return pa.concat_tables(out) if out else pa.table({k: pa.array([], pa.int64()) for k in "abc"})

    if n == 0:
        return members, members.select(F.col("cls").alias("a"), F.col("cls").alias("b")).limit(0)
    placed = checkpointed(distinct.select("cls", "v").mapInArrow(place, "c long, cls long, v binary"))
    salts = F.broadcast(checkpointed(placed.groupBy("c").agg(F.ceil(F.count("*") / shard).alias("salts"))))  # a row per cluster
    nodes = placed.groupBy("cls").agg(F.first("v").alias("v"), F.sort_array(F.collect_set("c")).alias("homes"))
    nodes = checkpointed(nodes)
    blocks = nodes.withColumn("c", F.explode("homes")).join(salts, "c").withColumn("salt", F.expr("pmod(xxhash64(cls), salts)"))
    blocks = checkpointed(blocks.select("c", "salt", "salts", "cls", "v", "homes"))
    schema = "a long, b long, c long"
    got = checkpointed(blocks.select("c", "salt", "cls", "v", "homes").groupBy("c", "salt").applyInArrow(solve, schema))
    # blocks of a cluster meet each later one of it
    guests = blocks.where("salts > 1 and salt < salts - 1").select("c", F.explode(F.sequence(F.col("salt") + 1, F.col("salts") - 1)).alias("salt"), F.col("salt").alias("turn"), "cls", "v", "homes")
    links, visited = [got.where("b is not null").select("a", "b")], placed.select("cls", "c")

    def met(guests: DataFrame) -> DataFrame:
        """Of guests by cluster, salt and turn (a bounded number of each), what they find in that block."""
        keys = ["c", "salt", "turn"]
        hosts = blocks.select("c", "salt", "cls", "v", "homes").join(guests.select(keys).distinct(), ["c", "salt"])
        left = hosts.select(*[F.col(k).alias(k) for k in (*keys, "cls", "v", "homes")])
        right = guests.select(*[F.col(k).alias(f"guest_{k}") for k in (*keys, "cls", "v", "homes")])
        return checkpointed(left.groupBy(keys).cogroup(right.groupBy([f"guest_{k}" for k in keys])).applyInArrow(meet, schema))

    found_now = [got]
    if not guests.isEmpty():
        found_now.append(met(guests))
        links.append(found_now[-1].where("b is not null").select("a", "b"))
    while True:
        routes = found_now[0] if len(found_now) == 1 else found_now[0].unionByName(found_now[1])
        new = checkpointed(routes.where("c is not null").select(F.col("a").alias("cls"), "c").distinct().join(visited, ["cls", "c"], "left_anti"))
        if new.isEmpty():
            break
        visited = checkpointed(visited.union(new))
        turns = F.broadcast(new.groupBy("c").agg(F.ceil(F.count("*") / shard).alias("turns")))
        guests = new.join(turns, "c").join(salts, "c").join(nodes, "cls").select("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.expr("pmod(xxhash64(cls), turns)").alias("turn"), "cls", "v", "homes")
        found_now = [met(guests)]
        links.append(found_now[0].where("b is not null").select("a", "b"))
    everything = links[0]
    for more in links[1:]:
        everything = everything.union(more)
    return members, checkpointed(everything.distinct())


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, **build_options) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Null, empty and zero vectors, and those with null or non-finite components, link with nothing. Equal vectors
    link with each other. Vectors of different lengths don't link. Repeated ids are separate rows; an empty table gives no rows.
    """
    members, links = similar_vectors(vectors, threshold, **build_options)
    classes = checkpointed(members.where("cls is not null").groupBy("cls").agg(F.count("*").alias("size"), F.min("vec_id").alias("least")))
    both = links.union(links.select("b", "a"))
    degree = both.join(classes.select(F.col("cls").alias("b"), "size"), "b").groupBy("a").agg(F.sum("size").alias("others")).withColumnRenamed("a", "cls")
    named = links.join(classes.select(F.col("cls").alias("a"), F.col("least").alias("la")), "a").join(classes.select(F.col("cls").alias("b"), F.col("least").alias("lb")), "b")
    groups = components(named, "la", "lb")
    facts = classes.join(degree, "cls", "left").join(groups.select(F.col("node").alias("least"), "component"), "least", "left")
    facts = facts.select("cls", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "least").alias("component_id"))
    out = members.join(facts, "cls", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def audit(vectors: DataFrame, links: DataFrame, members: DataFrame, threshold: float = THRESHOLD, every: int = 50, block: int = 4096) -> DataFrame:
    """One row: expected and found pairs (query, class), queries being the ids divisible by ``every``, and recall.

    Queries meet all rows in blocks: at most ``block`` of them are sent to every task, one block after another.
    """
    rows = checkpointed(_classes(vectors).where("cls is not null"))
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("cls").agg(F.first("v").alias("v"))
    asked = checkpointed(asked)
    expected, last = None, None
    while True:
        queries = (asked if last is None else asked.where(F.col("cls") > last)).orderBy("cls").limit(block).toArrow()
        if last is not None and not queries.num_rows:
            break
        names = queries.column("cls").to_pylist()
        now = checkpointed(rows.mapInArrow(_near(names, [np.frombuffer(v.as_py(), np.float64) for v in queries.column("v")], threshold), "a long, b long").distinct())
        expected = now if expected is None else expected.union(now)
        if len(names) < block:
            break
        last = names[-1]
    found = links.union(links.select("b", "a")).withColumn("hit", F.lit(1))
    return expected.join(found, ["a", "b"], "left").agg(F.count("*").alias("expected"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found")).withColumn("recall", F.when(F.col("expected") == 0, F.lit(1.0)).otherwise(F.col("found") / F.col("expected")))


def _near(names: list[int], queries: list[np.ndarray], threshold: float):
    """Of batches of (vec_id, cls, v): pairs (query's class, another class) at or above the threshold, of equal length."""
    by_length = {n: ([k for k, v in zip(names, queries) if len(v) == n], np.array([v for v in queries if len(v) == n])) for n in {len(v) for v in queries}}

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                other, data = part.column(1).to_pylist(), [np.frombuffer(v, np.float64) for v in part.column(2).to_pylist()]
                got = set()
                for n, (own, q) in by_length.items():
                    same = [k for k, v in enumerate(data) if len(v) == n]
                    if same:
                        i, j = np.nonzero(q @ np.stack([data[k] for k in same]).T >= threshold)
                        got.update((own[a], other[same[b]]) for a, b in zip(i, j) if own[a] != other[same[b]])
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], ["a", "b"])

    return run


def op4_embedding_graph(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
), walk(node, seen) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, k.seen FROM walk k JOIN links l ON l.a = k.node)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, (SELECT min(seen) FROM walk WHERE node = vec_id) AS component_id,
  vec_id = (SELECT min(seen) FROM walk WHERE node = vec_id) AS kept FROM embeddings
"""
