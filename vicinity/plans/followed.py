"""Queries of timed state: each stream stops half way and goes on from its checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.catalog import query
from vicinity.plans.streams import _finish, _folder
from vicinity.streaming import processors

_DAY = 24 * processors.HOUR
_LATE = "(SELECT (max(t) // 1000 - 600000) * 1000 FROM r)"


def _in_two_runs(rows: DataFrame, name: str, run: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """A stream over rows with ``at``: the first half of their time, then, started anew, the rest."""
    spark = rows.sparkSession
    feed, out = _folder(spark, "", f"{name}-feed"), _folder(spark, "", name)
    first, last = rows.agg(F.unix_micros(F.min("at")), F.unix_micros(F.max("at"))).first()
    early = F.unix_micros("at") < ((first or 0) + (last or 0)) // 2
    for part in (early, ~early):
        rows.where(part).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(rows.schema).parquet(feed)
        _finish(run(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(), spark)
    return spark.read.schema(schema).parquet(out)


@query(f"""WITH RECURSIVE r AS (SELECT user_id::VARCHAR AS guid, epoch_us(ts) AS t, event_type <> 'purchase' AS opens FROM events WHERE event_type IN ('view', 'click', 'purchase')),
 l AS (SELECT guid, list(t) FILTER (opens) AS cs, coalesce(list(t) FILTER (NOT opens), []) AS qs, max(t) AS latest FROM r GROUP BY guid),
 o AS (SELECT *, list_min(list_filter(qs, lambda x: x >= s AND x < s + {_DAY})) AS q FROM (SELECT *, list_min(cs) AS s FROM l WHERE cs IS NOT NULL)
 UNION ALL SELECT *, list_min(list_filter(qs, lambda x: x >= s AND x < s + {_DAY})) FROM (SELECT guid, cs, qs, latest, list_min(list_filter(cs, lambda x: CASE WHEN q IS NULL THEN x >= s + {_DAY} ELSE x > q END)) AS s FROM o) n WHERE s IS NOT NULL)
 SELECT guid, CASE WHEN q IS NULL THEN 'dropped' ELSE 'queued' END AS state, coalesce(q, s + {_DAY}) AS at_us FROM o WHERE q IS NOT NULL OR s + {_DAY} <= greatest({_LATE}, latest)""")
def streaming_candidate_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and clicks as candidates, purchases as their queueing, within a day."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type IN ('view', 'click', 'purchase')")
    rows = e.select(F.col("user_id").cast("string").alias("guid"), F.when(F.col("event_type") == "purchase", "queued").otherwise("candidate").alias("state"), F.col("ts").cast("timestamp").alias("at"))
    return _in_two_runs(rows, "terms", processors.candidate_terms, processors.CANDIDATES).select("guid", "state", F.unix_micros("at").alias("at_us"))


@query(f"""WITH r AS (SELECT user_id::VARCHAR AS id, epoch_us(ts) AS t, CASE event_type WHEN 'purchase' THEN 'sent' WHEN 'error' THEN 'gone' WHEN 'click' THEN CASE WHEN event_id % 3 = 0 THEN 'cancel' ELSE 'warn' END ELSE 'warn' END AS event, 'v' || event_id % 3 AS version FROM events),
 a AS (SELECT *, count(*) FILTER (event = 'cancel') OVER (PARTITION BY id ORDER BY t, event, version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seg FROM r),
 b AS (SELECT * FROM (SELECT *, min(t) FILTER (event = 'warn') OVER (PARTITION BY id, seg) AS first FROM a) x WHERE t >= first),
 c AS (SELECT *, coalesce(last_value(CASE WHEN event IN ('sent', 'gone') THEN event END IGNORE NULLS) OVER p, '') = 'sent' AS was_sent, last_value(CASE WHEN event = 'warn' THEN version END IGNORE NULLS) OVER p AS before, lead(t) OVER (PARTITION BY id, seg ORDER BY t, event, version) AS next FROM b WINDOW p AS (PARTITION BY id, seg ORDER BY t, event, version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 d AS (SELECT *, CASE WHEN event = 'warn' THEN version ELSE before END AS now, event = 'sent' OR was_sent AND event NOT IN ('gone', 'cancel') AS is_sent, last_value(CASE WHEN event = 'sent' AND NOT was_sent THEN t END IGNORE NULLS) OVER (PARTITION BY id, seg ORDER BY t, event, version) AS since FROM c),
 e AS (SELECT id, seg, first, now, since, unnest(range((t - since) // {processors.HOUR} + 1, (coalesce(next, greatest({_LATE}, t)) - since) // {processors.HOUR} + 1)) AS k FROM d WHERE is_sent),
 f AS (SELECT id, t AS at_us, CASE WHEN event = 'warn' AND NOT was_sent THEN 'post' WHEN event = 'warn' AND version <> before THEN 'edit' WHEN event = 'gone' AND was_sent THEN 'repost' WHEN event = 'cancel' AND was_sent THEN 'all_clear' END AS action, id || ':' || first AS occurrence, now AS version FROM d)
 SELECT * FROM f WHERE action IS NOT NULL UNION ALL SELECT id, since + k * {processors.HOUR}, 'check', id || ':' || first, now FROM e""")
def streaming_followed_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users as what was seen of a warning: its messages, and an hourly check while it is out."""
    e, kind = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_type")
    event = F.when(kind == "purchase", "sent").when(kind == "error", "gone").when((kind == "click") & (F.col("event_id") % 3 == 0), "cancel").otherwise("warn")
    rows = e.select(F.col("user_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("at"), event.alias("event"), F.concat(F.lit("v"), (F.col("event_id") % 3).cast("string")).alias("version"))
    return _in_two_runs(rows, "followed", processors.follow, processors.FOLLOWED).select("id", F.unix_micros("at").alias("at_us"), "action", "occurrence", "version")
