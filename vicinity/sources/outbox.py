"""Messages to rooms as tables: what to post or edit, and what came of it.

Posting itself is a side effect: a sink takes the outbox batch by batch, under transaction ids that
are the same for each attempt, and writes the results to a table that later steps read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.functions import text
from vicinity.operators import alerts, store


def posts(messages: DataFrame, rooms: DataFrame) -> DataFrame:
    """(alert_key, room, op, txn_id, plain, html): each message (alert_key, plain, html) to each room."""
    return messages.crossJoin(F.broadcast(rooms)).select("alert_key", "room", F.lit("post").alias("op"), alerts.transaction_id(F.col("alert_key"), F.col("room")).alias("txn_id"), "plain", "html")


def edits(messages: DataFrame) -> DataFrame:
    """Edits of messages (alert_key, event_ids, plain, html) in the rooms of their stored map only."""
    rows = messages.select("alert_key", F.explode(F.from_json("event_ids", "map<string,string>")).alias("room", "event_id"), "plain", "html")
    return rows.select("alert_key", "room", F.lit("edit").alias("op"), "event_id", alerts.transaction_id(F.concat("alert_key", F.lit("|edit")), F.col("room")).alias("txn_id"), "plain", "html")


def delivered(results: DataFrame) -> DataFrame:
    """(alert_key, all_ok, event_ids): whether every room has it, and the map of those that do."""
    ok = F.col("error").isNull()
    pairs = F.sort_array(F.collect_list(F.when(ok, F.struct("room", "event_id"))))
    return results.groupBy("alert_key").agg(F.bool_and(ok).alias("all_ok"), F.to_json(F.map_from_entries(pairs)).alias("event_ids"))


def edit_results(results: DataFrame) -> DataFrame:
    """(alert_key, result): ok, missing_original if any room lost the message, else failed."""
    missing = text.is_missing_message(F.coalesce("error", F.lit("")))
    return results.groupBy("alert_key").agg(F.when(F.bool_or(missing), "missing_original").when(F.bool_and(F.col("error").isNull()), "ok").otherwise("failed").alias("result"))


def reposts(gone: DataFrame, stored: DataFrame, rooms_: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(next post keys, outbox) for warnings (id, source, start_ms, end_ms, event_ids, plain, html) whose
    message is gone: a key that says what it replaces, kept from the first attempt on, and the posts."""
    wanted = gone.select("id", "source", alerts.post_key(F.col("id"), F.col("end_ms"), F.col("event_ids")).alias("key"), "start_ms", "end_ms", F.lit(now).cast("bigint").alias("created_at"))
    keys = store.post_keys(stored, wanted)
    messages = gone.select("id", "plain", "html").join(keys.select("id", F.col("key").alias("alert_key")), "id")
    return keys, posts(messages, rooms_)


def reposted(keys: DataFrame, results: DataFrame) -> DataFrame:
    """(id, event_ids, start_ms, end_ms) of reposts that every room has: the window is that of the first
    attempt, so that one that has moved since is edited next."""
    done = delivered(results).where("all_ok")
    return keys.select("id", F.col("key").alias("alert_key"), "start_ms", "end_ms").join(done, "alert_key").select("id", "event_ids", "start_ms", "end_ms")


def posted_version(stored: DataFrame, attempts: DataFrame) -> DataFrame:
    """(id, result): this_version, earlier_version if the stored first key is another, or failed."""
    return attempts.join(stored.select("id", F.col("key").alias("stored_key")), "id", "left").select("id", F.when(~F.col("all_ok"), "failed").when(F.coalesce("stored_key", "key") == F.col("key"), "this_version").otherwise("earlier_version").alias("result"))


RESULTS = "alert_key string, room string, op string, txn_id string, event_id string, error string"


def send_all(outbox: DataFrame, send: Callable[[dict], tuple[str | None, str | None]]) -> DataFrame:
    """Results of handing each row of an outbox to ``send``, which gives (event id, error).  Rooms are
    dealt over tasks; a room's messages are sent by one of them, in the order of their keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch.astype(object).where(batch.notna(), None).to_dict("records")
            done = [(r["alert_key"], r["room"], r["op"], r["txn_id"], *send(r)) for r in rows]
            yield pd.DataFrame(done, columns=[c.split()[0] for c in RESULTS.split(", ")])

    return outbox.repartition("room").sortWithinPartitions("room", "alert_key", "op").mapInPandas(run, RESULTS)


def room_sink(send: Callable[[dict], tuple[str | None, str | None]], folder: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that sends an outbox and writes what came of it to ``folder/batch=N``,
    for :func:`delivered` and :func:`edit_results`.  Rows have stable transaction ids, so a batch that is
    run again posts nothing twice and writes the same table."""

    def run(batch: DataFrame, number: int) -> None:
        send_all(batch, send).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return run


def rooms(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "room string")
