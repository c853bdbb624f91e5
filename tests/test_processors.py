"""Timed state: terms, followed warnings, restarts."""

import datetime

import pandas as pd

from vicinity.streaming import processors

START = datetime.datetime(2031, 5, 1)


def _at(hours):
    return START + datetime.timedelta(hours=hours)


def _run(spark, folder, run, schema, kind, *batches):
    feed, out = f"{folder}/feed", f"{folder}/out"
    for rows in batches:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(feed)
        run(spark.readStream.schema(kind).parquet(feed)).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema(schema).parquet(out).selectExpr("* EXCEPT (at)", f"(unix_micros(at) - {int(START.replace(tzinfo=datetime.UTC).timestamp())}000000) / 3.6e9 AS h").collect())


CANDIDATE = "guid string, state string, at timestamp"
ROWS = [("a", "candidate", _at(0)), ("a", "queued", _at(23)), ("a", "queued", _at(25)), ("b", "candidate", _at(1)), ("b", "queued", _at(25)), ("c", "candidate", _at(2)), ("c", "candidate", _at(3)), ("d", "queued", _at(4)), ("e", "seen", _at(5)), ("f", "candidate", None), ("z", "queued", _at(60)), ("b", "candidate", _at(60)), ("a", "candidate", _at(50)), ("a", "candidate", _at(60))]
TERMS = sorted([("a", "queued", 23.0), ("b", "dropped", 25.0), ("c", "dropped", 26.0)])


def test_terms_end_as_queued_or_dropped_in_one_batch_or_several(spark, tmp_path):
    one = _run(spark, tmp_path / "1", processors.candidate_terms, processors.CANDIDATES, CANDIDATE, ROWS)
    assert one == TERMS
    parts = [[r for r in ROWS if r[2] and low <= (r[2] - START).total_seconds() / 3600 < high] for low, high in ((0, 3), (3, 25), (25, 99))]
    assert _run(spark, tmp_path / "3", processors.candidate_terms, processors.CANDIDATES, CANDIDATE, *parts) == one


WARNING = "id string, at timestamp, event string, version string"


def test_a_warning_is_followed_until_it_is_over(spark, tmp_path):
    rows = [
        [("w", _at(-1), "sent", None), ("w", _at(0), "warn", "1"), ("w", _at(0.5), "warn", "2"), ("w", _at(1), "sent", None), ("w", _at(1.5), "warn", "2"), ("u", _at(0), "warn", None), ("u", _at(1), "cancel", None)],
        [("w", _at(2.5), "warn", "3"), ("w", _at(3), "gone", None), ("w", _at(4), "gone", None), ("w", _at(5), "warn", "3"), ("w", _at(6), "sent", None), ("w", _at(7.5), "cancel", None), ("w", _at(8), "warn", "4"), ("w", _at(8.2), "sent", None)],
        [("x", _at(11), "sent", None)],
    ]
    got = _run(spark, tmp_path, processors.follow, processors.FOLLOWED, WARNING, *rows)
    assert {r[2] for r in got if r[0] == "w"} == {f"w:{int(_at(h).replace(tzinfo=datetime.UTC).timestamp())}000000" for h in (0, 8)}
    said = [(r[4], r[1], r[3]) for r in got if r[0] == "w"]
    want = [(0, "post", "1"), (0.5, "post", "2"), (2, "check", "2"), (2.5, "edit", "3"), (3, "check", "3"), (3, "repost", "3"), (5, "post", "3"), (7, "check", "3"), (7.5, "all_clear", "3"), (8, "post", "4"), (9.2, "check", "4"), (10.2, "check", "4")]
    assert sorted((round(h, 6), a, v) for h, a, v in said) == sorted(want)
    assert [(r[1], r[3]) for r in got if r[0] == "u"] == [("post", "")]
    assert not [r for r in got if r[0] == "x"]


def test_no_rows(spark, tmp_path):
    assert _run(spark, tmp_path, processors.follow, processors.FOLLOWED, WARNING, []) == []


class _Handle:
    """Counts requests; has one state and its timers, and refuses to list these."""

    def __init__(self):
        self.value, self.timers, self.asked = None, set(), 0

    def getValueState(self, *_):
        return self

    def get(self):
        self.asked += 1
        return self.value

    def update(self, value):
        self.asked, self.value = self.asked + 1, value

    def clear(self):
        self.asked, self.value = self.asked + 1, None

    def registerTimer(self, t):
        self.asked += 1
        self.timers.add(t)

    def deleteTimer(self, t):
        self.asked += 1
        self.timers.remove(t)


def test_a_key_and_batch_take_few_requests():
    handle, follower = _Handle(), processors.Follower()
    follower.init(handle)
    hour = 3_600_000
    start = int(START.replace(tzinfo=datetime.UTC).timestamp()) * 1000
    for rows, most, timers in (([(0, "warn"), (0.5, "sent")], 3, {1.5}), ([(0.7, "warn")], 1, {1.5}), ([(3, "warn")], 4, {3.5}), ([(3.2, "cancel")], 3, set()), ([(4, "sent")], 1, set())):
        handle.asked = 0
        batch = pd.DataFrame([(_at(h), event, "1") for h, event in rows], columns=["at", "event", "version"])
        list(follower.handleInputRows(("w",), iter([batch]), None))
        assert handle.asked <= most and handle.timers == {start + round(h * hour) for h in timers}
