"""Snapshot tables: inserts, upserts, the item state machine, counters, ledgers, as new snapshots.

Plain files have no updates in place, so each operation takes a snapshot and gives the next one.
Times are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# How long rows are kept.
STATS_DAYS = 30
RETRY_DAYS = 7
TOP_SOURCES = 25
STATES = ("queued", "candidate", "processing", "posted", "dropped")
COUNTS = ("total", "queued", "candidate", "dropped", "retry_later")


def unseen(rows: DataFrame, stored: DataFrame, key: str = "guid") -> DataFrame:
    """Rows whose key is not stored yet."""
    return rows.join(stored.select(key), key, "left_anti")


def first_rows(rows: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """One row of each key, the first in order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def insert_if_absent(stored: DataFrame, rows: DataFrame, *order: Column | str, key: str = "guid") -> DataFrame:
    """The next snapshot: stored rows stay as they are; of several new ones with a key the first counts."""
    return stored.unionByName(first_rows(unseen(rows, stored, key), key, *order), allowMissingColumns=True)


def clear_retries(retries: DataFrame, inserted: DataFrame, key: str = "guid") -> DataFrame:
    return retries.join(inserted.select(key), key, "left_anti")


def upsert(stored: DataFrame, rows: DataFrame, key: str = "id", keep: tuple[str, ...] = ()) -> DataFrame:
    """The next snapshot: new rows take the place of stored ones.  Columns in ``keep`` fall back to the
    stored value where the new one is null."""
    new = rows.select(key, *[F.col(c).alias(f"_{c}") for c in stored.columns if c != key and c in rows.columns], F.lit(True).alias("_new"))

    def value(c: str) -> Column:
        if c not in rows.columns:
            return F.col(c)
        return F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in keep else F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)

    return stored.join(new, key, "full_outer").select(key, *[value(c) for c in stored.columns if c != key])


def delete(stored: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return stored.join(keys.select(key), key, "left_anti")


def rename_key(stored: DataFrame, renames: DataFrame, key: str = "id") -> DataFrame:
    """Rows get a new key (``renames``: key, new_id); a row already under it goes."""
    gone = renames.select(F.col("new_id").alias(key))
    return stored.join(gone, key, "left_anti").join(renames, key, "left").withColumn(key, F.coalesce("new_id", key)).drop("new_id")


def pending(stored: DataFrame, now: int, retention_hours: int) -> DataFrame:
    """Queued items and fresh enough candidates."""
    return stored.where((F.col("state") == "queued") | ((F.col("state") == "candidate") & (F.col("discovered_at") >= now - retention_hours * 3600)))


def promote(stored: DataFrame, ids: DataFrame, min_score: int, reason: str) -> DataFrame:
    hit = stored.join(ids.select("guid").distinct().withColumn("_hit", F.lit(True)), "guid", "left")
    up = F.col("_hit") & (F.col("state") == "candidate")
    return hit.withColumns({"score": F.when(up, F.greatest("score", F.lit(min_score))).otherwise(F.col("score")), "error": F.when(up, F.lit(reason)).otherwise(F.col("error")), "state": F.when(up, "queued").otherwise(F.col("state"))}).drop("_hit")


def expire_candidates(stored: DataFrame, now: int, retention_hours: int) -> DataFrame:
    old = (F.col("state") == "candidate") & (F.col("discovered_at") < now - retention_hours * 3600)
    return stored.withColumn("state", F.when(old, "dropped").otherwise(F.col("state")))


def take_for_digest(stored: DataFrame, min_score: int) -> DataFrame:
    """Queued items go to processing, or are dropped below the score; what is in processing then is
    taken, leftovers of an earlier round too."""
    queued = F.col("state") == "queued"
    return stored.withColumn("state", F.when(queued & (F.col("score") < min_score), "dropped").when(queued, "processing").otherwise(F.col("state")))


def finish(stored: DataFrame, ids: DataFrame, state: str, now: int, error: str | None = None) -> DataFrame:
    """Items in processing go on to ``state`` (posted, queued again, or dropped); others stay."""
    hit = stored.join(ids.select("guid").distinct().withColumn("_hit", F.lit(True)), "guid", "left")
    go = F.coalesce(F.col("_hit"), F.lit(False)) & (F.col("state") == "processing")
    changes = {"last_attempt_at": F.when(go, F.lit(now).cast("bigint")).otherwise(F.col("last_attempt_at")), "error": F.when(go, F.lit(error).cast("string")).otherwise(F.col("error"))}
    if state == "posted":
        changes["posted_at"] = F.when(go, F.lit(now).cast("bigint")).otherwise(F.col("posted_at"))
    return hit.withColumns(changes | {"state": F.when(go, state).otherwise(F.col("state"))}).drop("_hit")


def recover(stored: DataFrame) -> DataFrame:
    """After a crash, what was in processing is queued again."""
    return stored.withColumn("state", F.when(F.col("state") == "processing", "queued").otherwise(F.col("state")))


def recent_posted(stored: DataFrame, now: int, hours: int) -> DataFrame:
    return stored.where((F.col("state") == "posted") & (F.col("posted_at") >= now - hours * 3600))


def prune(stored: DataFrame, now: int, days: int) -> DataFrame:
    return stored.where(~F.col("state").isin("posted", "dropped") | (F.col("discovered_at") >= now - days * 86400))


def append_stats(stored: DataFrame, rows: DataFrame, now: int) -> DataFrame:
    """The next snapshot of poll statistics, without rows over 30 days old."""
    return stored.unionByName(rows).where(F.col("ts") >= now - STATS_DAYS * 86400)


def stats_summary(stats: DataFrame, now: int, hours: int = 24, top: int = TOP_SOURCES) -> DataFrame:
    """Sums by source over the last hours (1 to 720), busiest first; a report of the top few."""
    since = now - max(1, min(720, hours)) * 3600
    sums = stats.where(F.col("ts") >= since).groupBy("source_name").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in COUNTS])
    return sums.orderBy(F.desc("queued"), F.desc("candidate"), F.desc("total"), "source_name").limit(top)


def report_hours(argument: str) -> int:
    """The hours asked for, 24 if it is no number, within 1 to 720."""
    try:
        return max(1, min(720, int(argument.strip())))
    except ValueError:
        return 24


def stats_report(summary: DataFrame, hours: int) -> DataFrame:
    """One row with the report's text; ``summary`` has a few rows by contract."""
    line = F.format_string("📰 %s\n📥 %d total · 📬 %d queued\n🔎 %d candidate · 🗑️ %d dropped · 🔁 %d retry", "source_name", *COUNTS)
    lines = summary.agg(F.array_sort(F.collect_list(F.struct((-F.col("queued")).alias("a"), (-F.col("candidate")).alias("b"), (-F.col("total")).alias("c"), "source_name", line.alias("line")))).alias("l"))
    return lines.select(F.when(F.size("l") == 0, F.lit(f"🤷 No source stats in the last {hours}h.")).otherwise(F.concat(F.lit(f"📊 Source stats, last {hours}h\n\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n\n"))).alias("report"))


def record_retries(retries: DataFrame, failed: DataFrame, now: int) -> DataFrame:
    """The next snapshot of retry counters: one more for each failed key; week-old ones go."""
    more = failed.groupBy("guid").agg(F.count("*").cast("int").alias("_more"))
    both = retries.join(more, "guid", "full_outer")
    return both.select("guid", (F.coalesce("attempts", F.lit(0)) + F.coalesce("_more", F.lit(0))).cast("int").alias("attempts"), F.when(F.col("_more").isNotNull(), F.lit(now).cast("bigint")).otherwise(F.col("last_at")).alias("last_at")).where(F.col("last_at") >= now - RETRY_DAYS * 86400)


def post_keys(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """The next snapshot of post keys: the first key of an id stays until it is forgotten."""
    return insert_if_absent(stored, wanted, "created_at", "key", key="id")


def forget_keys_except(stored: DataFrame, source: str, current: DataFrame) -> DataFrame:
    """Keys of one source whose id is no longer current go; other sources' stay."""
    return stored.where(F.col("source") != source).unionByName(stored.where(F.col("source") == source).join(current.select("id"), "id", "left_semi").select(*stored.columns))


def mark_seen(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    """The next snapshot of the ledger of alerts and slots: first entries stay."""
    return insert_if_absent(ledger, rows, "sent_at", key="id")


def has_from(ledger: DataFrame, source: str) -> bool:
    return not ledger.where(F.col("source") == source).limit(1).isEmpty()


def slot_id(job: Column, slot: Column) -> Column:
    return F.concat(job, F.lit(":"), slot)


def with_columns(rows: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Older snapshots read with today's columns: missing ones are null."""
    return rows.select(*rows.columns, *[F.lit(None).cast(t).alias(c) for c, t in schema.items() if c not in rows.columns])
