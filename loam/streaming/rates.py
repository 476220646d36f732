"""Rate limits as keyed state over a stream of requests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.crawl import BASE_DELAY, after

STATE = "errors int, delay int, last long"
OUT = "domain string, error_count int, delay int, last_request_time long"


def rate_limits(requests: DataFrame) -> DataFrame:
    """(domain, error_count, delay, last_request_time) of each domain that a batch touched, after it. requests: domain, at, seq, status.

    State is three numbers a domain, whatever the length of its history. Requests of one batch are folded in order of (at, seq);
    batches in order of arrival.
    """

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        errors, delay, last = state.get if state.exists else (0, BASE_DELAY, -1)
        rows = pd.concat(list(parts)).sort_values(["at", "seq"], kind="stable")
        for at, status in zip(rows["at"].tolist(), rows["status"].tolist()):
            errors, delay = after(errors, delay, status)
            last = max(last, at)
        state.update((errors, delay, last))
        yield pd.DataFrame({"domain": [key[0]], "error_count": [errors], "delay": [delay], "last_request_time": [last]})

    return requests.groupBy("domain").applyInPandasWithState(fold, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
