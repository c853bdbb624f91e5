"""Queries over snapshots: seen items, inserts, counters, the state machine, statistics, ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.catalog import query
from vicinity.operators import routing, schedule, store

NOW = 1706659200  # 2024-01-31 00:00:00 UTC


def poll_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as poll statistics: a row counts one item of its user's source."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    is_ = lambda kind: (F.col("event_type") == kind).cast("int")
    return e.select(F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("source_name"), F.lit(1).alias("total"), is_("click").alias("queued"), is_("signup").alias("candidate"), is_("error").alias("dropped"), is_("purchase").alias("retry_later"))


_STATS = "WITH s AS (SELECT floor(epoch(ts))::BIGINT AS ts, 'user ' || user_id AS source_name, 1 AS total, (event_type = 'click')::INTEGER AS queued, (event_type = 'signup')::INTEGER AS candidate, (event_type = 'error')::INTEGER AS dropped, (event_type = 'purchase')::INTEGER AS retry_later FROM events)"
_SUMS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in store.COUNTS)


@query(f"{_STATS} SELECT source_name, {_SUMS} FROM s WHERE ts >= {NOW} - 720 * 3600 GROUP BY source_name ORDER BY queued DESC, candidate DESC, total DESC, source_name LIMIT 25")
def source_stats_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.stats_summary(poll_stats(spark, sf_dir), NOW, 720)


@query(f"{_STATS}, t AS (SELECT source_name, {_SUMS} FROM s WHERE ts >= {NOW} - 720 * 3600 GROUP BY source_name ORDER BY queued DESC, candidate DESC, total DESC, source_name LIMIT 25) SELECT '📊 Source stats, last 720h' || chr(10) || chr(10) || string_agg('📰 ' || source_name || chr(10) || '📥 ' || total || ' total · 📬 ' || queued || ' queued' || chr(10) || '🔎 ' || candidate || ' candidate · 🗑️ ' || dropped || ' dropped · 🔁 ' || retry_later || ' retry', chr(10) || chr(10) ORDER BY queued DESC, candidate DESC, total DESC, source_name) AS report FROM t")
def source_stats_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.stats_report(store.stats_summary(poll_stats(spark, sf_dir), NOW, store.report_hours("720")), 720)


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kinds = F.create_map(*[F.lit(x) for p in (("click", "queued"), ("signup", "candidate"), ("error", "dropped"), ("purchase", "retry")) for x in p])
    return e.where("event_type <> 'view'").select(F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("source_name"), kinds[F.col("event_type")].alias("outcome"), F.concat(F.lit("rule "), (F.col("event_id") % 4).cast("string")).alias("reason"))


_OUTCOMES = "WITH o AS (SELECT 'user ' || user_id AS source_name, CASE event_type WHEN 'click' THEN 'queued' WHEN 'signup' THEN 'candidate' WHEN 'error' THEN 'dropped' ELSE 'retry' END AS outcome, 'rule ' || event_id % 4 AS reason FROM events WHERE event_type <> 'view')"


@query(_OUTCOMES + ", u AS (SELECT 'user ' || i AS source_name FROM range(0, 200) t(i) UNION SELECT 'user ' || user_id FROM events WHERE user_id IS NOT NULL) SELECT source_name, count(outcome) AS total, count(*) FILTER (outcome = 'queued') AS queued, count(*) FILTER (outcome = 'candidate') AS candidate, count(*) FILTER (outcome = 'dropped') AS dropped, count(*) FILTER (outcome = 'retry') AS retry_later FROM u LEFT JOIN o USING (source_name) GROUP BY source_name")
def outcome_counts_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All users of the events, and the first 200 numbers; those who only viewed, or did nothing, have no items."""
    users = spark.range(200).union(spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id is not null").select("user_id"))
    return routing.outcome_counts(outcomes(spark, sf_dir), users.select(F.concat(F.lit("user "), F.col("id").cast("string")).alias("source_name")))


@query(_OUTCOMES + " SELECT outcome, reason, count(*) AS n FROM o GROUP BY ALL")
def reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.reason_counts(outcomes(spark, sf_dir))


@query("SELECT o_orderkey AS guid, o_custkey AS source FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def new_items_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("guid"), F.col("o_custkey").alias("source"))
    return store.unseen(orders, spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("guid")).distinct())


@query("WITH stored AS (SELECT o_custkey AS guid, min(o_orderkey) AS first FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1), fresh AS (SELECT o_custkey AS guid, min(o_orderkey) AS first FROM orders WHERE o_orderkey % 3 <> 0 AND o_custkey NOT IN (SELECT guid FROM stored) GROUP BY 1) SELECT guid, first, 'old' AS origin FROM stored UNION ALL SELECT guid, first, 'new' FROM fresh")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("guid"), F.col("o_orderkey").alias("first"))
    old = rows.where("first % 3 = 0").groupBy("guid").agg(F.min("first").alias("first")).withColumn("origin", F.lit("old"))
    return store.insert_if_absent(old, rows.where("first % 3 <> 0").withColumn("origin", F.lit("new")), "first")


@query(f"WITH a AS (SELECT user_id::VARCHAR AS guid, count(*)::INTEGER AS attempts, max(floor(epoch(ts)))::BIGINT AS last_at FROM events WHERE event_type = 'error' AND event_id % 2 = 0 GROUP BY 1), f AS (SELECT user_id::VARCHAR AS guid, count(*)::INTEGER AS more FROM events WHERE event_type = 'error' AND event_id % 2 = 1 GROUP BY 1), j AS (SELECT guid, (coalesce(attempts, 0) + coalesce(more, 0))::INTEGER AS attempts, CASE WHEN more IS NOT NULL THEN {NOW} ELSE last_at END AS last_at FROM a FULL JOIN f USING (guid)) SELECT * FROM j WHERE last_at >= {NOW} - 7 * 86400")
def retry_counter_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'error'").select("event_id", F.col("user_id").cast("string").alias("guid"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    old = e.where("event_id % 2 = 0").groupBy("guid").agg(F.count("*").cast("int").alias("attempts"), F.max("at").alias("last_at"))
    return store.record_retries(old, e.where("event_id % 2 = 1"), NOW)


def item_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored items in all states."""
    n = F.col("doc_id")
    states = F.array(*[F.lit(s) for s in store.STATES])
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        n.alias("guid"), F.col("source").alias("source_name"), (n % 6).cast("int").alias("score"), F.get(states, (n % 5).cast("int")).alias("state"), (F.lit(NOW) - n * 113 % 200000).alias("discovered_at"),
        F.lit(None).cast("bigint").alias("last_attempt_at"), F.when(n % 5 == 3, F.lit(NOW) - n * 71 % 400000).alias("posted_at"), F.lit(None).cast("string").alias("error"),
    )


_ROWS = f"WITH i AS (SELECT doc_id AS guid, source AS source_name, (doc_id % 6)::INTEGER AS score, (['queued', 'candidate', 'processing', 'posted', 'dropped'])[doc_id % 5 + 1] AS state, {NOW} - doc_id * 113 % 200000 AS discovered_at, CASE WHEN doc_id % 5 = 3 THEN {NOW} - doc_id * 71 % 400000 END AS posted_at FROM documents)"


@query(_ROWS + f" SELECT guid, CASE WHEN state = 'candidate' AND discovered_at < {NOW} - 86400 THEN 'dropped' ELSE state END AS state FROM i")
def expire_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.expire_candidates(item_rows(spark, sf_dir), NOW, 24).select("guid", "state")


@query(_ROWS + " SELECT guid, CASE WHEN guid % 2 = 0 AND state = 'candidate' THEN 'queued' ELSE state END AS state, CASE WHEN guid % 2 = 0 AND state = 'candidate' THEN greatest(score, 3) ELSE score END AS score FROM i")
def promote_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = item_rows(spark, sf_dir)
    return store.promote(rows, rows.where("guid % 2 = 0").select("guid"), 3, "seen in several sources").select("guid", "state", "score")


@query(_ROWS + " SELECT guid, score FROM i WHERE (state = 'queued' AND score >= 2) OR state = 'processing'")
def take_for_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.take_for_digest(item_rows(spark, sf_dir), 2).where("state = 'processing'").select("guid", "score")


@query(_ROWS + f" SELECT guid, CASE WHEN state = 'processing' AND guid % 2 = 0 THEN 'posted' ELSE state END AS state, CASE WHEN state = 'processing' AND guid % 2 = 0 THEN {NOW} ELSE posted_at END AS posted_at FROM i")
def mark_posted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = item_rows(spark, sf_dir)
    return store.finish(rows, rows.where("guid % 2 = 0").select("guid"), "posted", NOW).select("guid", "state", "posted_at")


@query(_ROWS + " SELECT guid, CASE WHEN state = 'processing' THEN 'queued' ELSE state END AS state FROM i")
def recover_processing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.recover(item_rows(spark, sf_dir)).select("guid", "state")


@query(_ROWS + f" SELECT guid, state, score FROM i WHERE state = 'queued' OR (state = 'candidate' AND discovered_at >= {NOW} - 86400)")
def pending_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.pending(item_rows(spark, sf_dir), NOW, 24).orderBy(F.desc("score"), "discovered_at", "guid").select("guid", "state", "score")


@query(_ROWS + f" SELECT guid, posted_at FROM i WHERE state = 'posted' AND posted_at >= {NOW} - 48 * 3600")
def recent_posted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.recent_posted(item_rows(spark, sf_dir), NOW, 48).select("guid", "posted_at")


@query("WITH o AS (SELECT o_custkey AS id, max(o_orderkey) AS k, arg_max(o_orderstatus, o_orderkey) AS s FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), n AS (SELECT o_custkey AS id, max(o_orderkey) AS k, arg_max(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END, o_orderkey) FILTER (true) AS s0, max_by(o_orderkey % 5 = 0, o_orderkey) AS gone, arg_max(o_orderstatus, o_orderkey) AS s FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) SELECT id, coalesce(n.k, o.k) AS k, CASE WHEN n.id IS NULL THEN o.s WHEN gone THEN o.s ELSE n.s END AS s FROM o FULL JOIN n USING (id)")
def snapshot_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    last = lambda r: r.groupBy("id").agg(F.max_by(F.struct("k", "s"), "k").alias("x")).select("id", "x.k", "x.s")
    new = last(rows.where("k % 2 = 1")).withColumn("s", F.when(F.col("k") % 5 == 0, F.lit(None).cast("string")).otherwise(F.col("s")))
    return store.upsert(last(rows.where("k % 2 = 0")), new, keep=("s",))


@query("WITH days AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS d), slots AS (SELECT epoch(d)::BIGINT + m * 60 AS due_at, strftime(d, '%Y-%m-%d') || ' ' || lpad((m // 60)::VARCHAR, 2, '0') || ':' || lpad((m % 60)::VARCHAR, 2, '0') AS slot FROM days, (VALUES (480), (1110)) t(m)), done AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') || ' 08:00' AS slot FROM events WHERE ts < TIMESTAMP '2024-01-20') SELECT slot, due_at FROM slots WHERE slot NOT IN (SELECT slot FROM done) AND due_at <= 1706659200")
def daily_slots_catchup(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = schedule.daily_slots(spark, "2024-01-01", "2024-01-31", ["08:00", "18:30", "25:99"], "UTC")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("ts < timestamp_ntz '2024-01-20 00:00:00'")
    done = e.select(F.concat(F.lit("digest:"), F.date_format("ts", "yyyy-MM-dd"), F.lit(" 08:00")).alias("id")).distinct()
    return schedule.due(slots, done, "digest", NOW, catch_up_hours=None).select("slot", F.col("at").alias("due_at"))
