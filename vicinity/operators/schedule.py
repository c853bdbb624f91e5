"""Daily slots in local time, what of them is due, and the ledger of those handled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vicinity.functions import dates
from vicinity.operators import store

# How long a missed slot is caught up, and when a failed one is tried again.
CATCH_UP_HOURS = 3
RETRY_MINUTES = 15
POST_WINDOW_MINUTES = 10
FORECAST_DEFAULT = "08:00"


def daily_slots(spark: SparkSession, first: str, last: str, times: list[str], zone: str) -> DataFrame:
    """(slot, at): each day's times as local ``date HH:MM`` and seconds since the epoch.  Times that are
    none are left out; a local time that a clock change skips moves on by the change."""
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("day"))
    named = days.withColumn("time", F.explode(F.array(*[F.lit(t) for t in times]).cast("array<string>"))).withColumn("minutes", dates.time_of_day(F.col("time"))).where("minutes is not null")
    label = F.concat(F.lpad(F.floor(F.col("minutes") / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col("minutes") % 60).cast("string"), 2, "0"))
    slot = F.concat(F.col("day").cast("string"), F.lit(" "), label)
    return named.select(slot.alias("slot"), dates.local_seconds(slot, zone, "yyyy-MM-dd HH:mm").alias("at"))


def due(slots: DataFrame, ledger: DataFrame, job: str, now: int, catch_up_hours: int | None = CATCH_UP_HOURS) -> DataFrame:
    """Slots that have come, are not in the ledger, and are not missed for too long."""
    come = slots.where(F.col("at") <= now)
    if catch_up_hours is not None:
        come = come.where(F.col("at") >= now - catch_up_hours * 3600)
    return come.withColumn("id", store.slot_id(F.lit(job), F.col("slot"))).join(ledger.select("id"), "id", "left_anti")


def retry_at(failed_at: int, slot_at: int) -> int | None:
    """When a failed slot is tried again; null once it is too late."""
    again = failed_at + RETRY_MINUTES * 60
    return again if again <= slot_at + CATCH_UP_HOURS * 3600 else None


def next_attempt(posts: DataFrame) -> DataFrame:
    """(id, step, at) for slot posts (id, slot_at, started_at, failed_at, transient), seconds each: done
    without a failure; now while the service does not answer and the post window is open; at a later
    time within the catch-up window; else missed.  Attempts carry the slot's key, so rooms that have a
    post get no second one."""
    failed, again = F.col("failed_at"), F.col("failed_at") + RETRY_MINUTES * 60
    open_ = F.col("transient") & (failed < F.col("started_at") + POST_WINDOW_MINUTES * 60)
    late = again > F.col("slot_at") + CATCH_UP_HOURS * 3600
    step = F.when(failed.isNull(), "done").when(open_, "now").when(late, "missed").otherwise("later")
    return posts.select("id", step.alias("step"), F.when(step == "now", failed).when(step == "later", again).alias("at"))


def seed(ledger: DataFrame, slots: DataFrame, job: str, now: int) -> DataFrame:
    """The next ledger: on a job's first start its latest past slot counts as done, so nothing old is
    posted; afterwards nothing changes."""
    own = ledger.where(F.col("id").startswith(f"{job}:"))
    if not own.limit(1).isEmpty():
        return ledger
    last = slots.where(F.col("at") <= now).withColumn("n", F.row_number().over(W.orderBy(F.desc("at")))).where("n = 1")
    return store.mark_seen(ledger, last.select(store.slot_id(F.lit(job), F.col("slot")).alias("id"), F.lit(job).alias("source"), F.lit(now).cast("bigint").alias("sent_at")))


def forecast_time(post_time: str | None, digest_times: list[str]) -> str:
    """The forecast's own time, else the first digest's, else the default."""
    return post_time or (digest_times[0] if digest_times else FORECAST_DEFAULT)
