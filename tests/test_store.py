from pyspark.sql import functions as F

from vicinity.operators import store

NOW = 1_700_000_000
ITEMS = "guid string, source_name string, score int, state string, discovered_at bigint, last_attempt_at bigint, posted_at bigint, error string"


def _items(spark, *rows):
    return spark.createDataFrame([(g, "s", score, state, NOW - age, None, None, None) for g, score, state, age in rows], ITEMS)


def _states(df):
    return {r["guid"]: r["state"] for r in df.collect()}


def test_state_machine(spark):
    rows = _items(spark, ("a", 3, "queued", 0), ("b", 0, "queued", 0), ("c", 2, "candidate", 90000), ("d", 2, "candidate", 10), ("e", 1, "processing", 0))
    assert _states(store.expire_candidates(rows, NOW, 24))["c"] == "dropped"
    assert {r["guid"] for r in store.pending(rows, NOW, 24).collect()} == {"a", "b", "d"}
    up = store.promote(rows, spark.createDataFrame([("d",), ("a",)], "guid string"), 4, "two sources").where("guid = 'd'").first()
    assert (up["state"], up["score"], up["error"]) == ("queued", 4, "two sources")
    taken = store.take_for_digest(rows, 1)
    assert _states(taken) == {"a": "processing", "b": "dropped", "c": "candidate", "d": "candidate", "e": "processing"}
    done = store.finish(taken, spark.createDataFrame([("a",), ("c",)], "guid string"), "posted", NOW)
    assert _states(done)["a"] == "posted" and _states(done)["c"] == "candidate"
    assert [r["guid"] for r in store.recent_posted(done, NOW + 3600, 48).collect()] == ["a"]
    assert _states(store.recover(taken))["e"] == "queued"
    again = store.finish(taken, spark.createDataFrame([("a",)], "guid string"), "queued", NOW, "no room").where("guid = 'a'").first()
    assert (again["state"], again["error"], again["posted_at"]) == ("queued", "no room", None)
    assert {r["guid"] for r in store.prune(_items(spark, ("x", 1, "posted", 90 * 86400), ("y", 1, "queued", 90 * 86400)), NOW, 30).collect()} == {"y"}


def test_insert_keeps_stored_rows_and_one_of_equal_keys(spark):
    old = _items(spark, ("a", 1, "queued", 0))
    new = _items(spark, ("a", 9, "dropped", 0), ("b", 2, "queued", 0), ("b", 3, "candidate", 0))
    got = {r["guid"]: r["score"] for r in store.insert_if_absent(old, new, F.desc("score")).collect()}
    assert got == {"a": 1, "b": 3}
    retries = spark.createDataFrame([("a", 2, NOW), ("z", 1, NOW)], "guid string, attempts int, last_at bigint")
    assert [r["guid"] for r in store.clear_retries(retries, new).collect()] == ["z"]


def test_retry_counters(spark):
    old = spark.createDataFrame([("a", 5, NOW - 10), ("b", 1, NOW - 8 * 86400)], "guid string, attempts int, last_at bigint")
    got = {r["guid"]: r["attempts"] for r in store.record_retries(old, spark.createDataFrame([("a",), ("c",)], "guid string"), NOW).collect()}
    assert got == {"a": 6, "c": 1}


def test_statistics_with_ties_and_reports(spark):
    rows = spark.createDataFrame([(NOW, "b", 3, 1, 0, 2, 0), (NOW, "a", 3, 1, 0, 2, 0), (NOW - 50 * 3600, "c", 9, 9, 0, 0, 0), (NOW, "d", None, 2, 0, 0, 0)], "ts bigint, source_name string, total int, queued int, candidate int, dropped int, retry_later int")
    top = store.stats_summary(rows, NOW, 24)
    assert [(r["source_name"], r["total"]) for r in top.collect()] == [("d", 0), ("a", 3), ("b", 3)]
    assert store.stats_summary(rows, NOW, 99999).count() == 4 and store.stats_summary(rows, NOW, 24, 1).count() == 1
    assert store.stats_report(top, 24).first()[0].split("\n\n")[1] == "📰 d\n📥 0 total · 📬 2 queued\n🔎 0 candidate · 🗑️ 0 dropped · 🔁 0 retry"
    assert store.stats_report(top.where("false"), 5).first()[0] == "🤷 No source stats in the last 5h."
    assert [store.report_hours(x) for x in ("", "x", "0", "9999", " 48 ")] == [24, 24, 1, 720, 48]
    assert store.append_stats(rows, rows.withColumn("ts", F.col("ts") - 31 * 86400), NOW).count() == 4


def test_post_keys_last_until_forgotten(spark):
    kind = "id string, source string, key string, start_ms bigint, end_ms bigint, created_at bigint"
    first = store.post_keys(spark.createDataFrame([], kind), spark.createDataFrame([("w", "dwd", "w|end=1", 0, 1, NOW)], kind))
    again = store.post_keys(first, spark.createDataFrame([("w", "dwd", "w|end=2", 0, 2, NOW + 1), ("n", "nina", "n|1", 0, 0, NOW)], kind))
    assert {r["id"]: r["key"] for r in again.collect()} == {"w": "w|end=1", "n": "n|1"}
    left = store.forget_keys_except(again, "dwd", spark.createDataFrame([], "id string"))
    assert [r["id"] for r in left.collect()] == ["n"]
    assert {r["key"] for r in store.post_keys(left, spark.createDataFrame([("w", "dwd", "w|end=3", 0, 3, NOW)], kind)).collect()} == {"n|1", "w|end=3"}


def test_upserts_renames_and_columns(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, n int, s string")
    new = spark.createDataFrame([("a", 5, None), ("c", 6, "z")], "id string, n int, s string")
    assert {tuple(r) for r in store.upsert(old, new).collect()} == {("a", 5, None), ("b", 2, "y"), ("c", 6, "z")}
    assert ("a", 5, "x") in {tuple(r) for r in store.upsert(old, new, keep=("s",)).collect()}
    moved = store.rename_key(old, spark.createDataFrame([("a", "b")], "id string, new_id string"))
    assert {tuple(r) for r in moved.collect()} == {("b", 1, "x")}
    assert store.delete(old, new, "id").count() == 1 and store.with_columns(old, {"n": "int", "t": "string"}).columns == ["id", "n", "s", "t"]
    seen = store.mark_seen(spark.createDataFrame([("q", "usgs", 1)], "id string, source string, sent_at bigint"), spark.createDataFrame([("q", "usgs", 2)], "id string, source string, sent_at bigint"))
    assert [r["sent_at"] for r in seen.collect()] == [1] and store.has_from(seen, "usgs") and not store.has_from(seen, "gdacs")
