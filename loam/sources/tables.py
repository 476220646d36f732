"""The engine's stored tables: created empty, replaced, or appended to."""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from .files import read_whole, write_whole

CRAWL = {
    "pages": "id long, url string, html_content string, status_code int, content_hash string, crawled_at long",
    "links": "from_url string, to_url string",
    "crawl_queue": "url string, discovered_at long, priority int",
    "crawl_state": "domain string, last_request_time long, error_count int, rate_limit_delay int",
}
QUERY_LOG = "query string, timestamp long, results_count long, search_time_ms double, mode string"


def create_all(spark: SparkSession, root: str) -> None:
    """The crawl's tables, empty, where they aren't yet there."""
    for name, schema in CRAWL.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{root}/{name}")


def open_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(CRAWL[name]).parquet(f"{root}/{name}")


def log_query(spark: SparkSession, path: str, query: str, results: int, ms: float, mode: str, now: int | None = None) -> None:
    """Append one search to the query log, stamped with the second."""
    row = (query, int(time.time()) if now is None else now, results, float(ms), mode)
    spark.createDataFrame([row], QUERY_LOG).coalesce(1).write.mode("append").parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Append many searches at once; columns as in ``QUERY_LOG``."""
    rows.selectExpr(*[f"cast({c} as {t}) as {c}" for c, t in (x.split() for x in QUERY_LOG.split(", "))]).write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUERY_LOG).parquet(path)


def save_ranks(ranks: DataFrame, path: str) -> None:
    """Replace the table of (url, score)."""
    ranks.select("url", "score").write.mode("overwrite").parquet(path)


def save_json(row: DataFrame, path: str) -> None:
    """A one-row table, such as a summary of vector buckets, as indented JSON."""
    first = row.first()
    write_whole(path, json.dumps(first.asDict(True) if first else {}, indent=2).encode())


@dataclass
class SourceState:
    """How far an input file has been taken in."""

    source_path: str
    byte_offset: int = 0
    processed_lines: int = 0
    total_updates: int = 0


def load_state(path: str, source: str) -> SourceState:
    """Fresh if there is none; of another source, only the number of updates stays."""
    raw = read_whole(path)
    if raw is None:
        return SourceState(source)
    state = SourceState(**json.loads(raw))
    return state if state.source_path == source else SourceState(source, total_updates=state.total_updates)


def save_state(state: SourceState, path: str) -> None:
    write_whole(path, json.dumps(asdict(state), indent=2).encode())
