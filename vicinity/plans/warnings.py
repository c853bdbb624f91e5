"""Queries over events as weather warnings, hourly readings and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.catalog import query
from vicinity.functions import dates, text
from vicinity.operators import alerts, forecast

NOW_MS = 1705276800000  # 2024-01-15 00:00:00 UTC
LEAD_MS = 3 * 3_600_000
_EVENTS = ["Starkregen", "Gewitter mit Hagel", "Sturmböen", "Frost", "Extreme Hitze"]


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as warnings: region by user, name by type, level and bucket by the number in props."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("bigint")
    names = F.create_map(*[F.lit(x) for p in zip(("view", "click", "signup", "error", "purchase"), _EVENTS, strict=True) for x in p])
    start = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    return e.select(
        "event_id", F.when(k % 4 == 0, alerts.ADVANCE).otherwise(alerts.WARNINGS).alias("bucket"), F.concat(F.lit("Region "), (F.col("user_id") % 10).cast("string")).alias("region"), names[F.col("event_type")].alias("event"),
        (k % 5 + 1).alias("level"), start.alias("start_ms"), (start + (k % 72 + 1) * 3_600_000).alias("end_ms"),
    )


_ROWS = """WITH w AS (SELECT event_id, CASE WHEN k % 4 = 0 THEN 'vorabInformation' ELSE 'warnings' END AS bucket, 'Region ' || user_id % 10 AS region,
   CASE event_type WHEN 'view' THEN 'Starkregen' WHEN 'click' THEN 'Gewitter mit Hagel' WHEN 'signup' THEN 'Sturmböen' WHEN 'error' THEN 'Frost' ELSE 'Extreme Hitze' END AS event,
   CASE event_type WHEN 'view' THEN 'REGEN' WHEN 'click' THEN 'GEWITTER' WHEN 'signup' THEN 'WIND' WHEN 'error' THEN 'FROST' ELSE 'HITZE' END AS family,
   k % 5 + 1 AS level, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + (k % 72 + 1) * 3600000 AS end_ms FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events)),
 keyed AS (SELECT *, 'dwd:' || bucket || ':' || region || ':' || family || ':' || level AS key FROM w)"""


def _snapshot(now: str) -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY region, family ORDER BY (start_ms <= {now} AND end_ms >= {now} AND bucket = 'warnings') DESC, (start_ms <= {now} AND end_ms >= {now}) DESC, level DESC, start_ms, key, end_ms) AS place
   FROM keyed WHERE end_ms >= {now} AND (bucket = 'vorabInformation' OR start_ms <= {now} + {LEAD_MS}) AND start_ms <= {now} + 86400000"""


def snapshot(spark: SparkSession, sf_dir: str, now: int = NOW_MS) -> DataFrame:
    """What a feed would show at a moment: relevant warnings that start within a day."""
    w = rows(spark, sf_dir)
    shown = w.where(alerts.relevant_now(F.col("bucket"), F.col("start_ms"), F.col("end_ms"), now, LEAD_MS) & (F.col("start_ms") <= now + 86_400_000))
    return alerts.ranked(shown, now)


@query(_ROWS + f", s AS ({_snapshot(str(NOW_MS))}) SELECT region, family, key, level, start_ms, end_ms FROM s WHERE place = 1")
def warning_groups_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot(spark, sf_dir).where("place = 1").select("region", "family", "key", "level", "start_ms", "end_ms")


@query(_ROWS + " SELECT region, family, max(level) AS level FROM keyed GROUP BY ALL")
def active_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.active_levels(rows(spark, sf_dir))


_EMOJI = "CASE level WHEN 1 THEN '🟡' WHEN 2 THEN '⚠️' WHEN 3 THEN '🟠' ELSE '🔴' END"
_PLAIN = "CASE level WHEN 1 THEN 'Vorinformation' WHEN 2 THEN 'Warnung' WHEN 3 THEN 'Starke Warnung' WHEN 4 THEN 'Unwetterwarnung' ELSE 'Extreme Unwetterwarnung' END"
_OWN = f"CASE WHEN bucket = 'vorabInformation' THEN CASE WHEN level IN (4, 5) THEN 'Vorabinformation Unwetter' ELSE 'Vorabinformation' END ELSE {_PLAIN} END"
_LABEL = f"CASE WHEN family = 'GEWITTER' AND level IN (3, 4, 5) THEN (['Starke Gewitterwarnung', 'Unwetterwarnung Gewitter', 'Extreme Gewitterwarnung'])[level - 2] WHEN family = 'REGEN' AND level IN (3, 4, 5) THEN (['Starkregenwarnung', 'Unwetterwarnung Starkregen', 'Extreme Starkregenwarnung'])[level - 2] ELSE {_OWN} END"


@query(_ROWS + f""", s AS ({_snapshot(str(NOW_MS))}), p AS (SELECT region, family, start_ms AS ps, end_ms AS pe FROM s WHERE place = 1),
 n AS (SELECT s.region, s.family, start_ms, level, '(danach: ' || {_EMOJI} || ' ' || {_LABEL} || ' bis ' || CASE WHEN epoch_ms(end_ms)::DATE = DATE '2024-01-15' THEN strftime(epoch_ms(end_ms), '%H:%M') ELSE strftime(epoch_ms(end_ms), '%a %H:%M') END || ')' AS note
   FROM s JOIN p USING (region, family) WHERE place > 1 AND CASE WHEN start_ms < pe THEN end_ms > pe ELSE end_ms > ps END)
 SELECT region, family, string_agg(note, ' | ' ORDER BY start_ms, level DESC, note) AS notes FROM n GROUP BY ALL""")
def secondary_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.timestamp_millis(F.lit(NOW_MS))
    return alerts.secondary_notes(snapshot(spark, sf_dir), now).select("region", "family", F.array_join("notes", " | ").alias("notes"))


_LATER = NOW_MS + 12 * 3_600_000
_DIFF = _ROWS + f""", a AS ({_snapshot(str(NOW_MS))}), c AS ({_snapshot(str(_LATER))}),
 held AS (SELECT key AS old_key, region AS r, family AS f, level AS old_level, start_ms AS os, end_ms AS oe FROM a WHERE place = 1), p AS (SELECT * FROM c WHERE place = 1),
 former AS (SELECT r, f, min(old_key) AS fk, arg_min(old_level, old_key) AS fl FROM held GROUP BY ALL),
 d AS (SELECT key, old_key, CASE WHEN start_ms = os AND end_ms = oe THEN 'noop' ELSE 'update' END AS action FROM p JOIN held ON key = old_key
   UNION ALL SELECT key, fk, CASE WHEN fk IS NULL THEN 'new' WHEN level > fl THEN 'up' WHEN level < fl THEN 'down' ELSE 'replace' END FROM p LEFT JOIN former ON region = r AND family = f WHERE key NOT IN (SELECT old_key FROM held)
   UNION ALL SELECT NULL, old_key, 'all_clear' FROM held WHERE old_key NOT IN (SELECT key FROM c) AND NOT EXISTS (SELECT 1 FROM c WHERE region = r AND family = f))"""


def _diff(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    active = snapshot(spark, sf_dir).where("place = 1").select(F.col("key").alias("id"), "region", "event", "level", "start_ms", "end_ms")
    current = snapshot(spark, sf_dir, _LATER)
    return current, active, alerts.snapshot_diff(current, active)


@query(_DIFF + " SELECT key, old_key, action FROM d")
def warning_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir)[2]


@query(_DIFF + " SELECT old_key FROM held WHERE old_key NOT IN (SELECT old_key FROM d WHERE old_key IS NOT NULL AND action <> 'noop') UNION ALL SELECT key FROM d WHERE action IN ('new', 'update', 'up', 'down', 'replace')")
def warning_next_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, active, diff = _diff(spark, sf_dir)
    return alerts.next_active(current, active, diff).select(F.col("id").alias("old_key"))


@query(_ROWS.replace("WITH w", "WITH RECURSIVE w") + """, rooms AS (SELECT event_id, key || '|' || '!room' || event_id % 3 AS text FROM keyed),
 f AS (SELECT event_id, encode(text) AS data, 0 AS i, 14695981039346656037::HUGEINT AS h FROM rooms
   UNION ALL SELECT event_id, data, i + 1, ((xor(h, ('0x' || substr(hex(data), i * 2 + 1, 2))::HUGEINT)) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT FROM f WHERE i < octet_length(data))
 SELECT event_id, 'vicinity-alert-' || lower(lpad(printf('%x', h::UBIGINT), 16, '0')) AS txn FROM f WHERE i = octet_length(data)""")
def txn_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = rows(spark, sf_dir)
    key = alerts.stable_key(F.col("bucket"), F.col("region"), F.col("event"), F.col("level"))
    return w.select("event_id", alerts.transaction_id(key, F.concat(F.lit("!room"), (F.col("event_id") % 3).cast("string"))).alias("txn"))


@query("SELECT event_id, floor(epoch(ts))::BIGINT AS a, floor(epoch(ts))::BIGINT AS b, (epoch(ts::DATE) + 43200)::BIGINT AS c FROM events")
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("t", F.col("ts").cast("timestamp"))
    mail = F.concat(F.date_format("t", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    return e.select("event_id", dates.parse_feed_date(mail).alias("a"), dates.parse_feed_date(F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).alias("b"), dates.parse_page_date(F.date_format("t", "yyyy-MM-dd")).alias("c"))


@query(_ROWS + " SELECT event_id, CASE WHEN epoch_ms(start_ms)::DATE = epoch_ms(end_ms)::DATE THEN strftime(epoch_ms(start_ms), '%a, %d %b %H:%M') || '-' || strftime(epoch_ms(end_ms), '%H:%M') ELSE strftime(epoch_ms(start_ms), '%a, %d %b %H:%M') || ' - ' || strftime(epoch_ms(end_ms), '%a, %d %b %H:%M') END AS valid FROM keyed")
def validity_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).select("event_id", dates.validity(F.col("start_ms"), F.col("end_ms")).alias("valid"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    icons = F.array(*[F.lit(i) for i in forecast.ICONS])
    return e.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.hour("ts").alias("utc_hour"), F.col("event_id").alias("n"), F.when(F.col("event_id") % 97 > 0, F.round("value", 2)).alias("temperature"), (F.col("event_id") % 101).alias("precipitation"), (F.col("user_id") * 1.0).alias("wind"), F.get(icons, (F.col("event_id") % 12).cast("int")).alias("icon"))


_HOURS = f"""WITH r AS (SELECT strftime(ts, '%Y-%m-%d') AS day, hour(ts) AS h, event_id, CASE WHEN event_id % 97 > 0 THEN round(value, 2) END AS temperature, event_id % 101 AS precipitation, user_id AS wind, ([{', '.join(f"'{i}'" for i in forecast.ICONS)}])[event_id % 12 + 1] AS icon FROM events),
 x AS (SELECT r.*, l FROM r JOIN (VALUES (7), (13), (18), (22)) t(l) ON h = (l - 1 + 24) % 24), f AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY day, l ORDER BY event_id) = 1),
 g AS (SELECT * FROM f WHERE day IN (SELECT day FROM f WHERE temperature IS NOT NULL GROUP BY day HAVING count(*) = 4))"""


@query(_HOURS + " SELECT day, l AS local_hour, temperature, precipitation, wind::DOUBLE AS wind, icon FROM g")
def forecast_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.pick_hours(readings(spark, sf_dir), ["day"], 1)


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


@query(_ROWS + " SELECT event_id, bucket, region, event, level, start_ms FROM keyed")
def json_explode_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings written as feed bodies (one for each 50 events), and read back."""
    w = rows(spark, sf_dir).select("event_id", "bucket", F.col("region").alias("regionName"), F.struct(F.col("region").alias("regionName"), "event", F.col("event_id").cast("string").alias("headline"), "level", F.col("start_ms").alias("start"), F.col("end_ms").alias("end")).alias("w"))
    cells = w.groupBy(F.floor(F.col("event_id") / 50).alias("feed"), "bucket", "regionName").agg(F.collect_list("w").alias("list"))
    feeds = cells.groupBy("feed").agg(*[F.map_from_entries(F.collect_list(F.when(F.col("bucket") == b, F.struct("regionName", "list")))).alias(b) for b in (alerts.WARNINGS, alerts.ADVANCE)])
    body = F.concat(F.lit("warnWetter.loadWarnings("), F.to_json(F.struct(alerts.WARNINGS, alerts.ADVANCE)), F.lit(");"))
    return alerts.explode_warnings(feeds.select(body.alias("body"))).select(F.col("headline").cast("bigint").alias("event_id"), "bucket", "region", "event", "level", "start_ms")


@query("SELECT page_id, html_text FROM (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(html, '(?s)<[^>]*>', '', 'g'), '>', ''), '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&'), '\\s+', ' ', 'g')) AS html_text FROM pages)")
def strip_page_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vicinity.functions import markup

    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", text.plain_text(F.col("html"), markup.decode_entities).alias("html_text"))
