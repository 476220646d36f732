"""Fetching pages inside tasks, by a replaceable function."""

from __future__ import annotations

import hashlib
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

AGENTS = tuple(f"Mozilla/5.0 ({system}) loam/1.0" for system in ("X11; Linux x86_64", "Windows NT 10.0; Win64; x64", "Macintosh; Intel Mac OS X 14_0", "X11; Ubuntu", "compatible"))
FETCHED = "url string, html_content string, status_code int, content_hash string, crawled_at long"


def http_get(url: str, timeout: float = 30) -> tuple[int, str]:
    """(status, body) by urllib; statuses of errors are returned, other failures raised."""
    request = urllib.request.Request(url, headers={"User-Agent": random.choice(AGENTS)})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.status, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, ""


def fetch(urls: DataFrame, get: Callable[[str], tuple[int, str]] = http_get, retries: int = 1, pause: float = 0.2, clock: Callable[[], float] = time.time) -> DataFrame:
    """A row per url. A failing call is tried again after ``pause`` seconds; one that fails ``retries`` times more is recorded as status 500, without content."""

    def run(batches):
        for batch in batches:
            rows = []
            for url in batch.column(0).to_pylist():
                status, body = 500, None
                for attempt in range(retries + 1):
                    try:
                        status, body = get(url)
                        break
                    except Exception:  # whatever a fetcher raises is a failed fetch
                        if attempt < retries:
                            time.sleep(pause)
                rows.append((url, body, status, None if body is None else hashlib.sha256(body.encode("utf-8", "surrogatepass")).hexdigest(), int(clock())))
            types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["url", "html_content", "status_code", "content_hash", "crawled_at"])

    return urls.select("url").mapInArrow(run, FETCHED)
