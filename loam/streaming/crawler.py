"""The crawl as a resumable loop of batches over stored tables."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import crawl as C
from ..sources import lists, tables
from ..sources.fetch import fetch, http_get
from ..sources.files import read_whole, write_whole


@dataclass
class Progress:
    """Counts of a crawl; a checkpoint is due whenever ``interval`` successes have been counted since the last."""

    interval: int = 200
    success: int = 0
    skipped: int = 0
    errors: int = 0
    since: int = 0
    started: float = field(default_factory=time.time)

    def count(self, success: int = 0, skipped: int = 0, errors: int = 0) -> None:
        self.success, self.skipped, self.errors, self.since = self.success + success, self.skipped + skipped, self.errors + errors, self.since + success

    def due(self) -> bool:
        return self.since >= self.interval

    def reset(self) -> None:
        self.since = 0

    def rate(self, now: float | None = None) -> float:
        """Pages per second so far."""
        spent = (time.time() if now is None else now) - self.started
        return self.success / spent if spent > 0 else 0.0

    def eta(self, total: int, now: float | None = None) -> float | None:
        """Seconds until ``total`` pages at the rate so far; null before the first page."""
        rate = self.rate(now)
        return max(0, total - self.success) / rate if rate else None


class Crawl:
    """Tables pages, links, crawl_queue and crawl_state in versioned folders; every batch writes a new version, then names it current.

    A crawl that was stopped or lost between batches goes on from the current version.
    """

    def __init__(self, spark: SparkSession, root: str, get: Callable[[str], tuple[int, str]] = http_get, agent: str = "loam", robots: DataFrame | None = None, pause: float = 0.2):
        self.spark, self.root, self.get, self.agent, self.robots, self.pause = spark, root, get, agent, robots, pause
        self.progress, self.stopped = Progress(), False

    def version(self) -> int:
        raw = read_whole(f"{self.root}/CURRENT")
        return json.loads(raw)["version"] if raw else 0

    def table(self, name: str) -> DataFrame:
        v = self.version()
        return self.spark.read.schema(tables.CRAWL[name]).parquet(f"{self.root}/v{v}/{name}") if v else self.spark.createDataFrame([], tables.CRAWL[name])

    def _save(self, **new: DataFrame) -> None:
        v = self.version() + 1
        for name, schema in tables.CRAWL.items():
            columns = [f"cast({x.split()[0]} as {x.split()[1]}) as {x.split()[0]}" for x in schema.split(", ")]
            (new[name] if name in new else self.table(name)).selectExpr(*columns).write.mode("overwrite").parquet(f"{self.root}/v{v}/{name}")
        write_whole(f"{self.root}/CURRENT", json.dumps({"version": v} | {k: x for k, x in asdict(self.progress).items() if k != "started"}).encode())

    def seed(self, urls: DataFrame, priority: int = 0, now: int = 0) -> None:
        queue, pages = self.table("crawl_queue"), self.table("pages")
        self._save(crawl_queue=queue.unionByName(C.enqueue(urls, queue, pages, priority, now)))

    def step(self, batch: int, now: int) -> int:
        """One batch: pop, ask robots, fetch, drop known content, store pages and links, enqueue what was found. Returns how many were popped."""
        queue, pages, links, state = (self.table(t) for t in ("crawl_queue", "pages", "links", "crawl_state"))
        popped, rest = C.pop(queue, batch)
        wanted = popped.select("url").join(pages.select("url"), "url", "left_anti")
        if self.robots is not None:
            wanted = lists.allowed(wanted, self.robots, self.agent)
        got = fetch(wanted, self.get, pause=self.pause, clock=lambda: now).withColumn("seq", F.col("url"))
        stage = f"{self.root}/stage/v{self.version() + 1}"
        got.write.mode("overwrite").parquet(stage)  # fetched once, however often it is read below
        got = self.spark.read.parquet(stage)
        fine = got.where("status_code between 200 and 299 and html_content is not null")
        fresh = C.new_content(fine, pages).drop("seq")
        base = pages.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("base"))
        numbered = fresh.crossJoin(F.broadcast(base)).withColumn("id", F.col("base") + 1 + F.row_number().over(C.Window.partitionBy(F.lit(0)).orderBy("url")))  # a batch is bounded
        found = C.links_of(fresh.select("url", F.col("html_content").alias("html")))
        new = C.enqueue(found.select(F.col("to_url").alias("url")), rest, pages.select("url").union(got.select("url")).union(popped.select("url")), now=now)
        requests = got.select(U.raw_domain(F.col("url")).alias("domain"), F.lit(now).cast("long").alias("at"), "seq", F.col("status_code").alias("status"))
        before = state.select("domain", F.col("error_count").alias("errors"), F.col("rate_limit_delay").alias("delay"))
        limits = C.rate_limits(requests, before).select("domain", "last_request_time", "error_count", F.col("delay").alias("rate_limit_delay"))
        states = state.join(limits.select("domain"), "domain", "left_anti").unionByName(limits)
        n, errors, kept = popped.count(), got.where("status_code not between 200 and 299").count(), fresh.count()
        self.progress.count(kept, n - errors - kept, errors)
        self._save(pages=pages.unionByName(numbered.select(pages.columns)), links=links.unionByName(found).distinct(), crawl_queue=rest.unionByName(new), crawl_state=states)
        if self.progress.due():
            self.progress.reset()
        return n

    def stop(self) -> None:
        """End after the batch that is under way."""
        self.stopped = True

    def run(self, most_pages: int, batch: int = 100, now: Callable[[], int] = lambda: int(time.time())) -> Progress:
        while not self.stopped and self.progress.success < most_pages:
            if not self.step(min(batch, most_pages - self.progress.success), now()):
                break
        return self.progress
