"""Micro-batches of items: the seen filter, routing into the item table, and retry counters.

One batch is one poll.  The item table is a folder of snapshots; a batch reads the latest, writes the
next, and names it by its number, so a batch that is run again writes the same snapshot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vicinity.operators import store


def seen_once(items: DataFrame, key: str = "guid") -> DataFrame:
    """A stream's first row of each key; its state keeps every key, as a seen list does."""
    return items.dropDuplicates([key])


def seen_within(items: DataFrame, key: str, event_time: str, hours: int) -> DataFrame:
    """As :func:`seen_once`, with state for some hours of event time only: for sources whose items do
    not come back later than that."""
    return items.withWatermark(event_time, f"{hours} hours").dropDuplicatesWithinWatermark([key])


def snapshot(spark: SparkSession, folder: str, batch: int, schema: str) -> DataFrame:
    """The latest snapshot before a batch; empty before the first."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    done = []
    if fs.exists(root):
        done = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(root) if s.getPath().getName().startswith("batch=") and fs.exists(s.getPath().suffix("/_SUCCESS"))]
    last = max((b for b in done if b < batch), default=None)
    return spark.createDataFrame([], schema) if last is None else spark.read.schema(schema).parquet(f"{folder}/batch={last}")


def poll_batches(items: DataFrame, folder: str, schema: str, route: Callable[[DataFrame], DataFrame], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs new items of each batch through ``route`` and inserts them: ``folder/batch=N`` is the item
    table after batch N.  Items seen before never reach ``route``."""

    def step(batch: DataFrame, number: int) -> None:
        before = snapshot(batch.sparkSession, folder, number, schema)
        fresh = route(store.first_rows(store.unseen(batch, before), "guid", *[c for c in batch.columns if c != "guid"]))
        columns = before.columns
        after = before.unionByName(fresh.select(*columns))
        after.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = items.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 minutes")).start()


def poll_summary(items: DataFrame, new: DataFrame, sources: int, panicked: int) -> DataFrame:
    """One row: sources, fetched, new_items, panicked."""
    return items.agg(F.count("*").alias("fetched")).crossJoin(new.agg(F.count("*").alias("new_items"))).select(F.lit(sources).alias("sources"), "fetched", "new_items", F.lit(panicked).alias("panicked"))
