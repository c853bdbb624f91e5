"""Queries that run as streams over saved files, pages, streets, and outboxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.catalog import query
from vicinity.functions import markup, streets
from vicinity.functions.shared import keep
from vicinity.plans import warnings
from vicinity.plans.items import items
from vicinity.sources import outbox
from vicinity.streaming import lifecycle, polls

_HOUR = 3_600_000


def _folder(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A new folder in the shared one."""
    path = keep(spark.range(1), name).inputFiles()[0]
    return path.rsplit("/", 1)[0] + "-out"


def _finish(query_, spark: SparkSession) -> None:
    query_.awaitTermination()
    if query_.exception():
        raise RuntimeError(str(query_.exception()))


@query("SELECT user_id, event_type, user_id || ':' || event_type AS guid FROM events GROUP BY ALL")
def streaming_seen_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's event types, the first time they are seen."""
    feed = _folder(spark, sf_dir, "seen-feed")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type")
    events.write.parquet(feed)
    rows = spark.readStream.schema(events.schema).parquet(feed).withColumn("guid", F.concat_ws(":", "user_id", "event_type"))
    out = _folder(spark, sf_dir, "seen")
    _finish(polls.seen_once(rows).select("user_id", "event_type", "guid").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(), spark)
    return spark.read.parquet(out)


@query("SELECT user_id AS guid, count(*) FILTER (event_type = 'click') > 0 AS clicked FROM events GROUP BY user_id")
def streaming_poll_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New users of each micro-batch go into a snapshot table once."""
    path = f"{sf_dir}/events.parquet"
    events = spark.read.parquet(path)
    users = events.groupBy(F.col("user_id").alias("guid")).agg((F.count_if(F.col("event_type") == "click") > 0).alias("clicked"))
    feed = _folder(spark, sf_dir, "poll-feed")
    keep(users, "users").repartition(4).write.parquet(feed)
    rows = spark.readStream.schema(users.schema).option("maxFilesPerTrigger", 2).parquet(feed)
    out = _folder(spark, sf_dir, "poll")
    _finish(polls.poll_batches(rows, out, "guid bigint, clicked boolean", lambda x: x, f"{out}-state"), spark)
    return polls.snapshot(spark, out, 1 << 60, "guid bigint, clicked boolean")


_TIMES = [warnings.NOW_MS + 12 * _HOUR * i for i in range(5)]


@query(warnings._ROWS + ", " + ", ".join(f"s{i} AS ({warnings._snapshot(str(t))})" for i, t in enumerate(_TIMES)) + ", p AS (" + " UNION ALL ".join(f"SELECT {t} AS snapshot, region, family, key, level, start_ms, end_ms FROM s{i} WHERE place = 1" for i, t in enumerate(_TIMES)) + f"""),
 g AS (SELECT DISTINCT region, family FROM p), e AS (SELECT g.region, g.family, t.snapshot, key, level, start_ms, end_ms FROM g CROSS JOIN (SELECT unnest([{', '.join(map(str, _TIMES))}]) AS snapshot) t LEFT JOIN p USING (region, family, snapshot)),
 l AS (SELECT *, lag(key) OVER w AS pk, lag(level) OVER w AS pl, lag(start_ms) OVER w AS ps, lag(end_ms) OVER w AS pe FROM e WINDOW w AS (PARTITION BY region, family ORDER BY snapshot))
 SELECT region, family, snapshot, key, pk AS old_key, CASE WHEN key IS NULL THEN 'all_clear' WHEN pk IS NULL THEN 'new' WHEN pk = key AND ps = start_ms AND pe = end_ms THEN 'noop' WHEN pk = key THEN 'update' WHEN level > pl THEN 'up' WHEN level < pl THEN 'down' ELSE 'replace' END AS action
 FROM l WHERE key IS NOT NULL OR pk IS NOT NULL""")
def streaming_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings followed over five snapshots by a stateful stream."""
    parts = [warnings.snapshot(spark, sf_dir, t).where("place = 1").select(F.lit(t).cast("bigint").alias("snapshot"), "region", "family", "key", "level", "start_ms", "end_ms") for t in _TIMES]
    primaries = parts[0]
    for p in parts[1:]:
        primaries = primaries.unionByName(p)
    primaries = keep(primaries, "primaries")
    groups = primaries.select("region", "family").distinct()
    times = spark.createDataFrame([(t,) for t in _TIMES], "snapshot bigint")
    rows = lifecycle.with_absent(primaries, groups, times)
    feed = _folder(spark, sf_dir, "feed")
    rows.write.parquet(feed)
    stream = spark.readStream.schema(rows.schema).parquet(feed)
    out = _folder(spark, sf_dir, "lifecycle")
    _finish(lifecycle.lifecycle(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(), spark)
    return spark.read.schema(lifecycle.OUT).parquet(out)


_STRIP = "trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace({0}, '(?s)<[^>]*>', '', 'g'), '>', ''), '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&'), '\\s+', ' ', 'g'))"
_CLEAN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', '', 'g'), '(?is)<style.*?</style>', '', 'g'), '(?is)<nav.*?</nav>', '', 'g'), '(?is)<header.*?</header>', '', 'g'), '(?is)<footer.*?</footer>', '', 'g')"


@query(f"WITH c AS (SELECT page_id, {_CLEAN} AS page FROM pages), a AS (SELECT page_id, page, {_STRIP.format(chr(39) * 2 + ' || regexp_extract(page, ' + repr('(?s)<article>(.*?)</article>') + ', 1)')} AS article FROM c) SELECT page_id, CASE WHEN octet_length(encode(article)) >= 200 THEN article ELSE {_STRIP.format('page')} END AS body FROM a")
def page_article_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", markup.article_body_column(F.col("html")).alias("body"))


@query()
def street_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).select(F.col("doc_id").alias("id"), "title", F.lit(None).cast("string").alias("description"), F.col("text").alias("article_text"))
    return streets.street_evidence(rows)


@query("SELECT s_suppkey, 'room' || r AS room, 'post' AS op FROM supplier, range(0, 3) t(r)")
def outbox_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("alert "), F.col("s_suppkey").cast("string")).alias("alert_key"), F.col("s_name").alias("plain"), F.col("s_name").alias("html"))
    posted = outbox.posts(rows, outbox.rooms(spark, ["room0", "room1", "room2"]))
    return posted.select(F.substring("alert_key", 7, 20).cast("bigint").alias("s_suppkey"), "room", "op")
