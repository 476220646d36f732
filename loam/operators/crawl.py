"""Crawl state as tables: frontier, pages, links, rate limits, statistics."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U

BASE_DELAY, MOST_DELAY = 100, 10_000


def retryable(status: Column) -> Column:
    return status.isin(403, 429) | status.between(500, 599)


def enqueue(found: DataFrame, queue: DataFrame, pages: DataFrame, priority: int = 0, now: int = 0) -> DataFrame:
    """Rows to add to the frontier: normalised urls that are neither queued nor crawled, once each."""
    new = found.select(U.normalize_url(F.col("url")).alias("url")).where("url is not null").distinct()
    return new.join(queue.select("url"), "url", "left_anti").join(pages.select("url"), "url", "left_anti").select("url", F.lit(now).cast("long").alias("discovered_at"), F.lit(priority).alias("priority"))


def pop(queue: DataFrame, n: int = 1) -> tuple[DataFrame, DataFrame]:
    """(popped, rest): highest priority first, then the earliest found, then by url."""
    popped = queue.orderBy(F.desc("priority"), "discovered_at", "url").limit(n)
    return popped, queue.join(popped.select("url"), "url", "left_anti")


def new_content(batch: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages whose content isn't stored under any url yet; of equal ones in the batch the first (seq) stays."""
    first = batch.withColumn("__n", F.row_number().over(Window.partitionBy("content_hash").orderBy("seq"))).where("__n = 1").drop("__n")
    return first.join(pages.select("content_hash").distinct(), "content_hash", "left_anti")


def url_of_hash(pages: DataFrame) -> DataFrame:
    return pages.groupBy("content_hash").agg(F.min_by("url", "id").alias("url"))


def upsert_pages(pages: DataFrame, batch: DataFrame) -> DataFrame:
    """The latest row of each url (crawled_at, then batch over store)."""
    both = pages.withColumn("__seq", F.lit(0)).unionByName(batch.withColumn("__seq", F.lit(1)))
    return both.withColumn("__n", F.row_number().over(Window.partitionBy("url").orderBy(F.desc("crawled_at"), F.desc("__seq"), F.desc("id")))).where("__n = 1").drop("__n", "__seq")


def after(errors: int, delay: int, status: int) -> tuple[int, int]:
    """(errors, delay) after one answer.

    Retryable errors double the delay up to the cap. A success after errors clears their count and leaves the delay; a further one
    halves it, down to the base. Other codes change nothing.
    """
    if status in (403, 429) or 500 <= status <= 599:
        return errors + 1, min(delay * 2, MOST_DELAY)
    if 200 <= status <= 299:
        return 0, delay if errors else max(delay // 2, BASE_DELAY)
    return errors, delay


def rate_limits(requests: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(domain, error_count, delay, last_request_time) after all requests of each domain, in order.

    requests: domain, at (ms), seq, status; before: domain, errors, delay to begin with, one row a domain (none: no errors, base delay).
    A task streams through its domains' requests in order and holds one state, however long a domain's history is. Null domains are
    left out.
    """
    if before is None:
        rows = requests.select("domain", "at", "seq", "status", F.lit(0).alias("errors"), F.lit(BASE_DELAY).alias("delay"))
    else:
        rows = requests.join(before.select("domain", "errors", "delay"), "domain", "left").select("domain", "at", "seq", "status", F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("delay", F.lit(BASE_DELAY)).alias("delay"))
    rows = rows.where("domain is not null").select("domain", F.col("at").cast("long").alias("at"), "seq", F.col("status").cast("int").alias("status"), F.col("errors").cast("int").alias("errors"), F.col("delay").cast("int").alias("delay"))

    def fold(batches):
        now: tuple | None = None  # domain, errors, delay, last
        for batch in batches:
            done = []
            for domain, at, status, errors, delay in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5))):
                if now is None or now[0] != domain:
                    if now is not None:
                        done.append(now)
                    now = (domain, errors, delay, at)
                now = (domain, *after(now[1], now[2], status), max(now[3], at))
            yield _states(done)
        if now is not None:
            yield _states([now])

    return rows.repartition("domain").sortWithinPartitions("domain", "at", "seq").mapInArrow(fold, "domain string, error_count int, delay int, last_request_time long")


def _states(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int64()))], ["domain", "error_count", "delay", "last_request_time"])


def wait_ms(last: Column, delay: Column, now: Column) -> Column:
    """Milliseconds to wait, null if none."""
    left = delay - (now - last)
    return F.when(left > 0, left)


def domain_stats(state: DataFrame, pages: DataFrame, limit: int = 20) -> DataFrame:
    """Crawled urls per known domain, most first."""
    counted = pages.select(U.raw_domain(F.col("url")).alias("domain"), "url").groupBy("domain").agg(F.count_distinct("url").alias("pages"))
    return state.select("domain", "error_count", "delay").join(counted, "domain", "left").select("domain", F.coalesce("pages", F.lit(0)).alias("pages"), "error_count", "delay").orderBy(F.desc("pages"), "domain").limit(limit)


def links_of(pages: DataFrame) -> DataFrame:
    """(from_url, to_url), a set: all http links of the pages, resolved."""
    from ..functions.page import hrefs_udf

    found = pages.select(F.col("url").alias("from_url"), F.explode(U.absolute_links(F.col("url"), hrefs_udf(F.col("html")))).alias("to_url"))
    return found.distinct()


def parse_pages(pages: DataFrame, least: int = 100, limit: int | None = None, bare: bool = True) -> DataFrame:
    """Parsed pages of more than ``least`` characters; with ``limit``, at most so many of them, those of least page_id.

    ``bare``: references without a semicolon count where HTML lets them; else they stay text.
    """
    from ..functions.page import parse_page_strict_udf, parse_page_udf

    long = pages.where(F.length("html") > least)
    long = long if limit is None else long.orderBy("page_id").limit(limit)
    return long.select("page_id", "url", (parse_page_udf if bare else parse_page_strict_udf)(F.col("html")).alias("p")).select("page_id", "url", "p.*")
