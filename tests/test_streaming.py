from pyspark.sql import functions as F

from vicinity.streaming import lifecycle, polls


def test_polls_insert_new_items_once_and_survive_a_restart(spark, tmp_path):
    feed, table, state = str(tmp_path / "feed"), str(tmp_path / "items"), str(tmp_path / "state")
    kind = "guid string, score int"
    run = lambda: polls.poll_batches(spark.readStream.schema(kind).parquet(feed), table, kind, lambda x: x.withColumn("score", F.col("score") + 1), state).awaitTermination()
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], kind).coalesce(1).write.parquet(feed)
    run()
    spark.createDataFrame([("b", 9), ("c", 3)], kind).coalesce(1).write.mode("append").parquet(feed)
    run()
    run()
    rows = polls.snapshot(spark, table, 1 << 60, kind).collect()
    assert sorted((r["guid"], r["score"]) for r in rows) == [("a", 2), ("b", 3), ("c", 4)]


def test_summary(spark):
    items = spark.createDataFrame([("a",), ("b",)], "guid string")
    assert tuple(polls.poll_summary(items, items.limit(1), 3, 0).first()) == (3, 2, 1, 0)


def test_warnings_are_followed_over_batches(spark, tmp_path):
    kind = "region string, family string, snapshot bigint, key string, level bigint, start_ms bigint, end_ms bigint"
    feed = str(tmp_path / "feed")
    run = lambda: lifecycle.lifecycle(spark.readStream.schema(kind).parquet(feed)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    spark.createDataFrame([("R", "FROST", 1, "k2", 2, 0, 9), ("R", "FROST", 2, "k2", 2, 0, 9), ("S", "UV", 1, None, None, None, None)], kind).write.parquet(feed)
    run()
    spark.createDataFrame([("R", "FROST", 3, "k3", 3, 0, 9), ("R", "FROST", 4, "k3", 3, 0, 12), ("R", "FROST", 5, None, None, None, None), ("R", "FROST", 6, "k2", 2, 5, 9), ("R", "FROST", 2, "k9", 9, 0, 0)], kind).write.mode("append").parquet(feed)
    run()
    rows = spark.read.schema(lifecycle.OUT).parquet(str(tmp_path / "out")).collect()
    assert sorted((r["snapshot"], r["action"], r["key"]) for r in rows if r["region"] == "R") == [(1, "new", "k2"), (2, "noop", "k2"), (3, "up", "k3"), (4, "update", "k3"), (5, "all_clear", None), (6, "new", "k2")]
    assert not [r for r in rows if r["region"] == "S"]
