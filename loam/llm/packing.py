"""Variable-capacity best-fit packing of documents into training sequences.

Lengths go in descending order into the open bin that they fill best. Where none fits, a bin is opened, and its
permitted capacity is chosen by cost: each capacity is tried with the lengths that are left, best fits first, and the one whose
contents cost least per token is opened, a bin's cost being the least capacity that holds its contents plus a charge for the bin. In
the end each bin shrinks to that capacity. Plans that always open one of the permitted capacities (or the least above it) are
made as well, and each shard keeps the plan of least cost.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITIES = (256, 512, 1024, 2048, 4096, 8192)
BIN_COST = 8
SHARD_ROWS = 8_192


def tokens(text: Column) -> Column:
    """Length in tokens: a quarter of the UTF-8 bytes, rounded up; null and empty texts have none."""
    return F.coalesce(F.ceil(F.octet_length(text) / 4), F.lit(0)).cast("long")


def _cheapest(lengths: list[int], order: list[int], capacities: list[int], bin_cost: int) -> tuple[list[int], list[int]]:
    """(bin of each length, contents of each bin), each bin opened at the capacity whose contents cost least per token."""
    distinct = sorted(set(lengths))
    waiting: dict[int, list[int]] = {}
    for i in reversed(order):
        waiting.setdefault(lengths[i], []).append(i)
    where, filled = [0] * len(lengths), []

    def tried(capacity: int) -> list[int]:
        """Lengths of the best fits of a bin that begins with the greatest length left."""
        room, chosen, taken = capacity, [], {}
        at = len(distinct)
        while at:
            at = bisect_right(distinct, room, 0, at)
            if not at or not distinct[at - 1]:
                break
            n = distinct[at - 1]
            many = min(len(waiting[n]) - taken.get(n, 0), room // n)
            chosen += [n] * many
            taken[n] = taken.get(n, 0) + many
            room -= n * many
            at -= 1
        return chosen

    while distinct and distinct[-1]:
        best = None
        for capacity in capacities[bisect_left(capacities, distinct[-1]) :]:
            chosen = tried(capacity)
            used = sum(chosen)
            rate = (capacities[bisect_left(capacities, used)] + bin_cost) / used
            if best is None or rate < best[0]:
                best = (rate, chosen, used)
        for n in best[1]:
            where[waiting[n].pop()] = len(filled)
            if not waiting[n]:
                distinct.pop(bisect_left(distinct, n))
        filled.append(best[2])
    if distinct and not filled:
        filled.append(0)
    return where, filled  # lengths of nothing go into the first bin


def _fixed(lengths: list[int], order: list[int], capacities: list[int], policy: int) -> tuple[list[int], list[int]]:
    """Best fit in descending order; every bin is opened at one capacity, or the least above it that is needed."""
    room: list[tuple[int, int]] = []  # (space left, bin), ascending
    where, filled = [0] * len(lengths), []
    for i in order:
        need = lengths[i]
        at = bisect_left(room, (need, -1))
        if at < len(room):
            left, bin_ = room.pop(at)
        else:
            left, bin_ = capacities[max(policy, bisect_left(capacities, need))], len(filled)
            filled.append(0)
        where[i] = bin_
        filled[bin_] += need
        if left > need:
            insort(room, (left - need, bin_))
    return where, filled


def pack(lengths: list[int], capacities=CAPACITIES, bin_cost: int = BIN_COST) -> tuple[list[int], list[int], int]:
    """(bin of each length, capacity of each bin, cost). Every length is at most the greatest capacity.

    Ties go to the earlier length, bin and plan, so the result depends on the list alone.
    """
    capacities = sorted(capacities)
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    best: tuple[int, list[int], list[int]] | None = None
    for where, filled in (_cheapest(lengths, order, capacities, bin_cost), *(_fixed(lengths, order, capacities, policy) for policy in range(len(capacities)))):
        sizes = [capacities[bisect_left(capacities, f)] for f in filled]
        cost = sum(sizes) + bin_cost * len(sizes)
        if best is None or cost < best[0]:
            best = (cost, where, sizes)
    return best[1], best[2], best[0]


PLACED = "doc_id long, piece long, n_tokens long, shard long, bin long, start long, capacity long"


def pack_documents(docs: DataFrame, capacities=CAPACITIES, bin_cost: int = BIN_COST, shard_rows: int = SHARD_ROWS, length: Column | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, n_tokens, shard, bin, start, capacity.

    Texts longer than the greatest capacity are cut into pieces of it, the rest being the last piece;
    a document without tokens is one empty piece, in a bin of its shard. Shards are hashes of
    (doc_id, piece, n_tokens), about ``shard_rows`` pieces each: a bin never crosses shards, and no
    shard grows with the input. A shard that equal keys make larger is packed in parts of at most twice as many pieces, with further bins.
    Only ids and lengths are shuffled. Null and repeated ids are packed like any other; pieces with the same id and number are told apart by
    their bins and starts. Other columns are ignored; an empty table gives no rows.
    """
    most = max(capacities)
    n = length if length is not None else tokens(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.cast("long").alias("n"))
    pieces = F.greatest(F.expr(f"(n + {most} - 1) div {most}"), F.lit(1))
    total = rows.agg(F.coalesce(F.sum(pieces), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_rows))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1))).select("doc_id", "piece", F.least(F.col("n") - F.col("piece") * most, F.lit(most)).cast("long").alias("n_tokens"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "n_tokens"), F.lit(shards)))

    def packed(held: list[tuple], bins: int) -> tuple[pa.RecordBatch, int]:
        sizes = [r[2] for r in held]
        where, caps, _ = pack(sizes, capacities, bin_cost)
        used, start = [0] * len(caps), []
        for b, s in zip(where, sizes):
            start.append(used[b])
            used[b] += s
        columns = [*zip(*held), [b + bins for b in where], start, [caps[b] for b in where]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "piece", "n_tokens", "shard", "bin", "start", "capacity"]), bins + len(caps)

    def run(batches):
        held: list[tuple] = []
        bins = 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if held and (held[0][3] != row[3] or len(held) == 2 * shard_rows):
                    out, after = packed(held, bins)
                    yield out
                    bins = after if held[0][3] == row[3] else 0
                    held = []
                held.append(row)
        if held:
            yield packed(held, bins)[0]

    return rows.repartition("shard").sortWithinPartitions("shard", "doc_id", "piece", "n_tokens").mapInArrow(run, PLACED)


def op10_best_fit(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return pack_documents(table(spark, sf_dir, "documents"))
