"""Processors of keyed state on RocksDB with timers: candidates that expire, and warnings that are followed.

Everything follows the time in the rows: what falls due is dealt with before the next row of its key, and a
timer does it for keys without further rows once the watermark has passed.  So results do not depend on how
rows fall into batches, and a replay gives the same ones.  (State that expires by itself does so by the clock
and would not.)  Rows that come behind the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CANDIDATES = "guid string, state string, at timestamp"
FOLLOWED = "id string, at timestamp, action string, occurrence string, version string"
HOUR = 3_600_000_000  # microseconds


def _milliseconds(micros: int) -> int:
    """The first millisecond at which a time has come."""
    return -(-micros // 1000)


def _sorted(batches: Iterator[pd.DataFrame], *columns: str) -> list[tuple]:
    """One key's rows of a batch in order, times in microseconds; a key with very many rows a batch wants smaller
    batches."""
    rows = []
    for batch in batches:
        times = batch["at"].to_numpy().astype("datetime64[us]").astype(np.int64).tolist()
        rows += zip(times, *(batch[c].tolist() for c in columns), strict=True)
    return sorted(rows)


class _Timed(StatefulProcessor):
    """Holds at most one timer a key, and writes rows of ``columns``.

    Each call of the handle or of a state is a request to the JVM, and there are several a key and batch: so the
    timer is known from the state instead of listed, and set only if it changes."""

    columns: list[str]

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        out = dict(zip(self.columns, zip(*rows, strict=True) if rows else [()] * len(self.columns), strict=True))
        return pd.DataFrame({c: np.array(v, np.int64).view("datetime64[us]") if c == "at" else np.array(v, object) for c, v in out.items()})

    def wake(self, before: int | None, micros: int | None) -> None:
        """Sets the timer; ``before``: when the key was to wake, None if it had no timer or that has expired."""
        if before == micros:
            return
        if before is not None:
            self.handle.deleteTimer(_milliseconds(before))
        if micros is not None:
            self.handle.registerTimer(_milliseconds(micros))

    def close(self) -> None:
        pass


class Candidates(_Timed):
    """A candidate's row opens a term; a queued row within it ends it as queued, its end as dropped."""

    columns = ["guid", "state", "at"]

    def __init__(self, hours: int) -> None:
        self.term = hours * HOUR

    def init(self, handle) -> None:
        self.handle = handle
        self.since = handle.getValueState("since", "since bigint")

    def handleInputRows(self, key, rows, timerValues):
        held, out = self.since.get(), []
        since = before = held[0] if held else None
        for now, state in _sorted(rows, "state"):
            if since is not None and now >= since + self.term:
                out.append((key[0], "dropped", since + self.term))
                since = None
            if state == "queued" and since is not None:
                out.append((key[0], "queued", now))
                since = None
            elif state == "candidate" and since is None:
                since = now
        if since != before:
            self.since.clear() if since is None else self.since.update((since,))
            self.wake(*(None if t is None else t + self.term for t in (before, since)))
        yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self.since.get()
        self.since.clear()
        yield self.frame([(key[0], "dropped", held[0] + self.term)] if held else [])


class Follower(_Timed):
    """A warning's messages.  Rows (id, at, event, version) say what was seen of it: ``warn`` in a response, in
    some version; ``sent`` and ``gone``, that its message went out or is missing; ``cancel``, that it is over.

    The occurrence is named when the warning is first tried and keeps that name until it is over, whatever
    fails in between: ``post`` until it is sent, then ``edit`` for another version, ``repost`` once its message
    is missing, ``all_clear`` at its end if it had been sent; each hour ``check`` while it is."""

    columns = ["id", "at", "action", "occurrence", "version"]

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "first bigint, version string, checked bigint")

    def checks(self, name: str, held: tuple, until: int) -> tuple[list[tuple], tuple]:
        """Checks due until a time, that included."""
        first, version, checked = held
        n, occurrence = (0 if checked is None else max(0, (until - checked) // HOUR)), f"{name}:{first}"
        return [(name, checked + HOUR * (i + 1), "check", occurrence, version) for i in range(n)], (first, version, None if checked is None else checked + HOUR * n)

    def handleInputRows(self, key, rows, timerValues):
        name, held, out = key[0], self.state.get(), []
        held = before = tuple(held) if held else None
        for now, event, seen in _sorted(rows, "event", "version"):
            if held is not None:
                due, held = self.checks(name, held, now)
                out += due
            if held is None:
                if event != "warn":
                    continue
                held = (now, seen, None)
                out.append((name, now, "post", f"{name}:{now}", seen))
                continue
            first, version, checked = held
            sent, action = checked is not None, None
            if event == "warn":
                action = "post" if not sent else "edit" if seen != version else None
                version = seen
            elif event == "sent":
                checked = checked if sent else now
            elif event == "gone" and sent:
                action, checked = "repost", None
            elif event == "cancel":
                action = "all_clear" if sent else None
            if action:
                out.append((name, now, action, f"{name}:{first}", version))
            held = None if event == "cancel" else (first, version, checked)
        self.keep(before, held, self.due(before))
        yield self.frame(out)

    def due(self, held: tuple | None) -> int | None:
        """When the next check is due."""
        return None if held is None or held[2] is None else held[2] + HOUR

    def keep(self, before: tuple | None, held: tuple | None, timer: int | None) -> None:
        if held != before:
            self.state.clear() if held is None else self.state.update(held)
        self.wake(timer, self.due(held))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        out, before = [], self.state.get()
        if before:
            out, held = self.checks(key[0], tuple(before), timerValues.getCurrentWatermarkInMs() * 1000)
            self.keep(tuple(before), held, None)  # Spark deletes the timer that has expired
        yield self.frame(out)


def _run(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, late: str) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return rows.withWatermark("at", late).groupBy(key).transformWithStateInPandas(processor, schema, "append", "eventTime")


def candidate_terms(rows: DataFrame, hours: int = 24, late: str = "10 minutes") -> DataFrame:
    """(guid, state, at) of a stream of (guid, state, at): see :class:`Candidates`.  Other states, and null times,
    count for nothing.  Sets the session's state store to RocksDB."""
    return _run(rows.where("state IN ('candidate', 'queued') AND at IS NOT NULL").select("guid", "state", "at"), "guid", Candidates(hours), CANDIDATES, late)


def follow(rows: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(id, at, action, occurrence, version) of a stream of (id, at, event, version): see :class:`Follower`.
    A null version is an empty one.  Sets the session's state store to RocksDB."""
    known = rows.where("event IN ('warn', 'sent', 'gone', 'cancel') AND at IS NOT NULL").selectExpr("id", "at", "event", "coalesce(version, '') AS version")
    return _run(known, "id", Follower(), FOLLOWED, late)
