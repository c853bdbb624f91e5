"""The life cycle of warnings as keyed state.

A snapshot stream has the rows of :func:`vicinity.operators.alerts.ranked` with ``snapshot`` (the time
of the feed, in ms); every snapshot also has a row (region, family) with a null key for each group
that it leaves out, so that its end is seen: :func:`with_absent` adds them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "region string, family string, snapshot bigint, key string, old_key string, action string"
STATE = "key string, level bigint, start_ms bigint, end_ms bigint, snapshot bigint"


def with_absent(primaries: DataFrame, groups: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Primary rows of snapshots, and null rows for groups that a snapshot leaves out.  ``groups`` and
    ``snapshots`` are the small tables of all (region, family) and of all snapshot times."""
    every = groups.crossJoin(F.broadcast(snapshots))
    return every.join(primaries.select("region", "family", "snapshot", "key", "level", "start_ms", "end_ms"), ["region", "family", "snapshot"], "left")


def _steps(group: tuple[str, str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held: Any = state.get if state.exists else None
    out = []
    rows = pd.concat(list(batches)).sort_values("snapshot", kind="stable")
    for r in rows.itertuples(index=False):
        if held is not None and r.snapshot <= held[4]:
            continue  # an older snapshot that comes again
        if pd.isna(r.key):
            if held is not None and held[0] is not None:
                out.append((*group, r.snapshot, None, held[0], "all_clear"))
                held = (None, 0, 0, 0, r.snapshot)
            continue
        now = (r.key, int(r.level), int(r.start_ms), int(r.end_ms), int(r.snapshot))
        if held is None or held[0] is None:
            step, old = "new", None
        elif held[0] == r.key:
            step, old = ("noop" if held[2:4] == now[2:4] else "update"), held[0]
        else:
            step, old = ("up" if now[1] > held[1] else "down" if now[1] < held[1] else "replace"), held[0]
        out.append((*group, r.snapshot, r.key, old, step))
        held = now
    if held is not None:
        state.update(held)
    yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])


def lifecycle(snapshots: DataFrame) -> DataFrame:
    """(region, family, snapshot, key, old_key, action) for each group and snapshot of a stream."""
    return snapshots.groupBy("region", "family").applyInPandasWithState(_steps, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
