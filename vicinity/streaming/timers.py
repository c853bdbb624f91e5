"""Keyed state with an end: candidates that expire, retry counters that are forgotten.

Both follow the time in the rows, so a replay gives the same results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vicinity.operators.routing import MAX_ATTEMPTS
from vicinity.operators.store import RETRY_DAYS

CANDIDATE_OUT = "guid string, state string, at timestamp"
RETRY_OUT = "guid string, attempts int, final boolean, at timestamp"


def candidate_expiry(rows: DataFrame, hours: int = 24, late: str = "10 minutes") -> DataFrame:
    """(guid, state, at): a candidate's row (guid, state, at timestamp) opens a term; it comes out as
    queued if a queued row of it comes within the term, and as dropped once event time passes its end."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (since,) = state.get
            state.remove()
            yield pd.DataFrame([(key[0], "dropped", pd.Timestamp(since, unit="ms") + pd.Timedelta(hours=hours))], columns=["guid", "state", "at"])
            return
        out, since = [], state.get[0] if state.exists else None
        for r in pd.concat(list(batches)).sort_values("at").itertuples(index=False):
            if r.state == "queued" and since is not None:
                since = None
                out.append((key[0], "queued", r.at))
            elif r.state == "candidate" and since is None:
                since = int(r.at.timestamp() * 1000)
        if since is not None:
            state.update((since,))
            state.setTimeoutTimestamp(max(since + hours * 3_600_000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["guid", "state", "at"])

    return rows.withWatermark("at", late).groupBy("guid").applyInPandasWithState(step, CANDIDATE_OUT, "since bigint", "append", GroupStateTimeout.EventTimeTimeout)


def retry_counters(failures: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(guid, attempts, final, at) for each failure (guid, at timestamp): its number, and whether it is
    the last that counts.  A counter is forgotten a week after its latest failure."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, last = state.get if state.exists else (0, 0)
        out = []
        for r in pd.concat(list(batches)).sort_values("at").itertuples(index=False):
            now = int(r.at.timestamp() * 1000)
            n = 1 if now - last > RETRY_DAYS * 86_400_000 else n + 1
            last = max(last, now)
            out.append((key[0], n, n >= MAX_ATTEMPTS, r.at))
        state.update((n, last))
        state.setTimeoutTimestamp(max(last + RETRY_DAYS * 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["guid", "attempts", "final", "at"])

    return failures.withWatermark("at", late).groupBy("guid").applyInPandasWithState(step, RETRY_OUT, "attempts int, last bigint", "append", GroupStateTimeout.EventTimeTimeout)
