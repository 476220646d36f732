"""Mixing sources to target weights by Pfair scheduling.

Every source is cut into blocks of documents. A source of weight w may start its j-th block at
floor(j/w), and it is due at ceil((j+1)/w). Weights are counted in billionths that sum to one, so this is whole
arithmetic. Earliest deadline first over these windows gives each source, after any number of slots, within
less than one block of its weight's share. Slots are dealt until the last source is through, by a fold over slots and
sources that knows sizes only; the documents themselves are never put in one order by one task.

A block has ``block_rows`` documents, or as many as make at most ``most_blocks`` blocks of the whole corpus: the fold, which
is one task's, stays as long whatever the corpus. No document is left out by that; only the grain of the mix is coarser.

Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, fresh_names, table

UNITS = 1_000_000_000  # of which weights are made up
ALPHA = 0.9
BLOCK_ROWS = 16
MOST_BLOCKS = 1 << 20
MOST_BROADCAST = 100_000  # sources, of some 50 bytes each; beyond, documents are joined by shuffling


def source_sizes(docs: DataFrame, block_rows: int = BLOCK_ROWS, alpha: float = ALPHA, weights: DataFrame | None = None, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """One row per source: source, n_rows, block_rows, n_blocks, weight, units (the weight in billionths).

    weights: source, weight, the target weights, in any unit; without them a source's target is its rows**alpha. A source of the documents
    without a positive finite weight raises an error; weights of other sources count for nothing. Units go by largest remainder (ties: lesser name),
    at least one each.
    """
    by = docs.groupBy(F.col("source")).agg(F.count("*").alias("n_rows"))
    everything = Window.partitionBy(F.lit(0))  # over sources, not rows
    if weights is None:
        by = by.withColumn("mass", F.pow(F.col("n_rows").cast("double"), F.lit(alpha)))
    else:
        given = weights.groupBy(F.col("source").alias("ws")).agg(F.sum(F.col("weight").cast("double")).alias("w"))
        fine = (F.col("w") > 0) & (F.col("w") < float("inf"))
        by = by.join(given, F.col("source").eqNullSafe(F.col("ws")), "left").select("source", "n_rows", F.when(fine, F.col("w")).otherwise(F.raise_error(F.concat(F.lit("no positive target weight: "), F.coalesce("source", F.lit("null"))))).alias("mass"))
    by = by.withColumn("block_rows", F.greatest(F.lit(block_rows).cast("long"), F.ceil(F.sum("n_rows").over(everything) / most_blocks)))
    by = by.withColumn("n_blocks", F.ceil(F.col("n_rows") / F.col("block_rows"))).withColumn("weight", F.col("mass") / F.sum("mass").over(everything))
    by = by.withColumn("floor", F.greatest(F.floor(F.col("weight") * UNITS), F.lit(1).cast("long"))).withColumn("over", F.round(F.col("weight") * UNITS - F.floor(F.col("weight") * UNITS), 3))
    by = by.withColumn("short", UNITS - F.sum("floor").over(everything))
    nth = F.row_number().over(everything.orderBy(F.desc("over"), F.col("source").asc_nulls_first()))
    by = by.withColumn("units", F.col("floor") + ((F.col("short") > 0) & (nth <= F.col("short"))).cast("long"))
    # where least units went beyond, the heaviest source gives way
    heaviest = F.row_number().over(everything.orderBy(F.desc("units"), F.col("source").asc_nulls_first())) == 1
    units = F.col("units") + F.when(heaviest, UNITS - F.sum("units").over(everything)).otherwise(0)
    return by.select("source", "n_rows", "block_rows", "n_blocks", "weight", units.alias("units"))


def schedule(sizes: DataFrame, chunk: int = 1_000) -> DataFrame:
    """(source, nth, slot): all slots in order of earliest deadline among released blocks, up to the last deadline of a source's own blocks."""
    due = F.expr(f"(n_blocks * {UNITS}L + units - 1) div units")
    # rank of sources by name breaks ties of deadlines
    name = F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))
    listed = sizes.groupBy().agg(F.sort_array(F.collect_list(F.struct(name.alias("name"), "source", "units"))).alias("s"), F.max(due).alias("length")).where("length > 0")
    # picks are gathered by chunks, as an array is copied whenever it grows
    folded = listed.select(
        "s",
        F.expr(
            f"""
            aggregate(sequence(0L, (length - 1) div {chunk}),
              struct(transform(s, x -> 0L) as done, cast(array() as array<array<struct<i: int, nth: bigint>>>) as chunks),
              (all, c) -> transform(array(
                aggregate(sequence(c * {chunk}, least(c * {chunk} + {chunk}, length) - 1),
                  struct(all.done as done, cast(array() as array<struct<i: int, nth: bigint>>) as picks),
                  (acc, t) -> transform(array(array_min(transform(s, (x, i) -> case
                        when acc.done[i] * {UNITS}L div x.units <= t
                        then struct((((acc.done[i] + 1) * {UNITS}L + x.units - 1) div x.units) as due, i as i)
                        else struct(9223372036854775807L as due, i as i) end)).i),
                      p -> struct(transform(acc.done, (d, i) -> d + if(i = p, 1L, 0L)) as done, concat(acc.picks, array(struct(p as i, acc.done[p] as nth))) as picks))[0])),
                r -> struct(r.done as done, concat(all.chunks, array(r.picks)) as chunks))[0],
              all -> flatten(all.chunks)) as picks
            """
        ),
    )
    return folded.select("s", F.posexplode("picks").alias("slot", "pick")).select(F.expr("s[pick.i].source").alias("source"), "pick.nth", F.col("slot").cast("long").alias("slot"))


def numbered(docs: DataFrame) -> DataFrame:
    """source, doc_id and nth_row, the row's index within its source in ascending doc_id (null ids first; equal ids in any order).

    Rows are laid out in ranges of (source, doc_id) with bounds from a sample, so neither a hot source nor far-out ids make a range
    large. Each range is numbered on its own, from the number of the source's rows in earlier ranges.
    """
    rows = checkpointed(docs.select("source", F.col("doc_id").cast("long").alias("doc_id")).repartitionByRange("source", "doc_id").withColumn("r", F.spark_partition_id()))
    counts = rows.groupBy("source", "r").agg(F.count("*").alias("c"))  # a source and range each: few
    counts = counts.withColumn("before", F.sum("c").over(Window.partitionBy("source").orderBy("r")) - F.col("c"))
    inside = rows.withColumn("k", F.row_number().over(Window.partitionBy("source", "r").orderBy(F.col("doc_id").asc_nulls_first())) - 1)
    c = counts.select(F.col("source").alias("cs"), F.col("r").alias("cr"), "before")
    return inside.join(c, F.col("source").eqNullSafe(F.col("cs")) & (F.col("r") == F.col("cr"))).select("source", "doc_id", (F.col("before") + F.col("k")).alias("nth_row"))


def _dealt(docs: DataFrame, options: dict) -> tuple[DataFrame, DataFrame]:
    """(sizes with given, slots). given: the blocks that a source gives until the slowest source is through all of its own."""
    sizes = checkpointed(source_sizes(docs, **options))
    slots = checkpointed(schedule(sizes))
    last = sizes.select(F.col("source").alias("ls"), (F.col("n_blocks") - 1).alias("ln"))
    ends = last.join(slots, F.col("source").eqNullSafe(F.col("ls")) & (F.col("nth") == F.col("ln"))).agg(F.max("slot").alias("end"))
    counts = slots.join(F.broadcast(ends)).where("slot <= end").groupBy(F.col("source").alias("ps")).agg(F.count("*").alias("given"))
    return checkpointed(sizes.join(counts, F.col("source").eqNullSafe(F.col("ps"))).select(*[sizes[c] for c in sizes.columns], "given")), slots


def plan_mix(docs: DataFrame, **options) -> DataFrame:
    """Every document's place: doc_id, source, block, first_slot, repeats. options: as of ``source_sizes``.

    ``block`` counts the source's blocks, ``first_slot`` is the slot at which the block comes first.
    The mix lasts until the slowest source has given all its blocks; a source that is through starts
    again, so nothing is dropped: ``repeats`` says how often the block comes within that time (at
    least once). Null sources form one source; null and repeated ids are rows like others, texts are never read, other columns
    are ignored. An empty table gives no rows.
    """
    sizes, slots = _dealt(docs, options)
    s = sizes.select(F.col("source").alias("ss"), "n_blocks", "block_rows", "given")
    rows = numbered(docs).join(s, F.col("source").eqNullSafe(F.col("ss"))).withColumn("block", F.expr("nth_row div block_rows"))
    f = slots.select(F.col("source").alias("fs"), F.col("nth").alias("fn"), F.col("slot").alias("first_slot"))
    rows = rows.join(f, F.col("source").eqNullSafe(F.col("fs")) & (F.col("block") == F.col("fn")))
    return rows.select("doc_id", "source", "block", "first_slot", (F.expr("given div n_blocks") + (F.col("block") < F.expr("given % n_blocks")).cast("long")).alias("repeats"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents, all columns kept, each as often as its block comes in the mix (at least once). options: as of ``source_sizes``.

    A block's repeats depend on its number alone, and blocks go by ascending doc_id. So one id per source
    tells its rows apart, and the texts are neither sorted nor shuffled. Rows of one source and id are all on the same side, that of
    the last of them. Columns of any names are kept; an empty table stays empty.
    """
    sizes, _ = _dealt(docs, options)
    more = sizes.select("source", F.expr("given div n_blocks").alias("base"), (F.expr("given % n_blocks") * F.col("block_rows")).alias("lead"))
    m = more.select(F.col("source").alias("ms"), "lead")
    rows = numbered(docs).join(m, F.col("source").eqNullSafe(F.col("ms"))).where(F.col("nth_row") < F.col("lead"))
    edge = rows.groupBy("source").agg(F.max("doc_id").alias("last"), F.count("*").alias("n")).select(F.col("source").alias("es"), F.coalesce("last", F.lit(-(1 << 63))).alias("last"))
    src, base, last, n = fresh_names(docs, "source", "base", "last", "n")
    rule = more.join(edge, F.col("source").eqNullSafe(F.col("es")), "left").select(F.col("source").alias(src), F.col("base").alias(base), F.col("last").alias(last))
    if sizes.count() <= MOST_BROADCAST:
        rule = F.broadcast(rule)
    times = F.col(base) + F.coalesce(F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63))) <= F.col(last), F.lit(False)).cast("long")
    joined = docs.join(rule, docs["source"].eqNullSafe(F.col(src)))
    return joined.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), times))).select(*[docs[c] for c in docs.columns])


def op2_mix_pfair(spark, sf_dir: str) -> DataFrame:
    return plan_mix(table(spark, sf_dir, "documents"))


#: the same fold as a recursion over slots; its state is a list of the blocks that each source has given
ORACLE = f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS n_rows FROM documents GROUP BY 1),
m AS (SELECT source, n_rows, greatest({BLOCK_ROWS}, ceil(sum(n_rows) OVER () / {MOST_BLOCKS}::DOUBLE))::BIGINT AS block_rows, power(n_rows::DOUBLE, {ALPHA}) AS mass FROM n),
w AS (SELECT *, ceil(n_rows / block_rows::DOUBLE)::BIGINT AS n_blocks, mass / sum(mass) OVER () * {UNITS} AS share FROM m),
f AS (SELECT *, greatest(floor(share), 1)::BIGINT AS low, round(share - floor(share), 3) AS over FROM w),
g AS (SELECT *, {UNITS} - sum(low) OVER () AS short, row_number() OVER (ORDER BY over DESC, source NULLS FIRST) AS nth FROM f),
u AS (SELECT source, n_rows, block_rows, n_blocks, low + (short > 0 AND nth <= short)::BIGINT AS units FROM g),
z AS (SELECT source, n_rows, block_rows, n_blocks, (units + CASE WHEN row_number() OVER (ORDER BY units DESC, source NULLS FIRST) = 1 THEN {UNITS} - sum(units) OVER () ELSE 0 END)::BIGINT AS units FROM u),
s AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST) AS i FROM z),
a AS (SELECT list(units ORDER BY i) AS us, count(*)::BIGINT AS k, max((n_blocks * {UNITS} + units - 1) // units)::BIGINT AS length FROM s),
walk(t, done, pick) AS (
  SELECT -1::BIGINT, list_transform(range(k), lambda x: 0::BIGINT), NULL::BIGINT FROM a
  UNION ALL
  SELECT t, list_transform(done, lambda d, j: d + (j = p)::BIGINT), p FROM (
    SELECT t + 1 AS t, done, k, list_sort(list_transform(range(1, k + 1), lambda j: {{'due': CASE WHEN done[j] * {UNITS} // us[j] <= t + 1 THEN ((done[j] + 1) * {UNITS} + us[j] - 1) // us[j] ELSE 9223372036854775807 END, 'j': j}}))[1].j AS p
    FROM walk, a WHERE t + 1 < length)),
slots AS (SELECT pick AS i, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS nth FROM walk WHERE t >= 0),
stop AS (SELECT max(slot) AS last FROM slots JOIN s USING (i) WHERE nth = n_blocks - 1),
given AS (SELECT i, count(*) AS given FROM slots, stop WHERE slot <= last GROUP BY i),
d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k FROM documents)
SELECT d.doc_id, d.source, k // block_rows AS block, slot AS first_slot, given // n_blocks + (k // block_rows < given % n_blocks)::BIGINT AS repeats
FROM d JOIN s ON s.source IS NOT DISTINCT FROM d.source JOIN given USING (i) JOIN slots ON slots.i = s.i AND slots.nth = k // block_rows
"""
