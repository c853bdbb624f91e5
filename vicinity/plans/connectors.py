"""Queries over saved responses, messages, civil warnings, streets and stores: events and orders as input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.catalog import query
from vicinity.functions import geo, streets, text
from vicinity.functions.shared import keep
from vicinity.operators import alerts, digest, routing, schedule, store
from vicinity.plans import warnings
from vicinity.plans.items import NOW
from vicinity.plans.streams import _finish, _folder
from vicinity.sources import feeds, hazards, outbox
from vicinity.streaming import timers

_S = "epoch_us(ts) // 1000000"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seconds() -> Column:
    return F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)


# -- saved responses -------------------------------------------------------------------------------


def _civil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as dashboards of fifty warnings; each fifth comes by the weather feed too."""
    e, n = _read(spark, sf_dir, "events"), F.col("event_id").cast("string")
    warning = F.struct(
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("dwd."), n)).otherwise(F.concat(F.lit("mow."), n, F.lit("-001"))).alias("id"), F.concat(F.lit("t"), n).alias("sent"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("e"), n)).alias("effective"), F.col("event_type").alias("severity"), F.array(F.struct(F.concat(F.lit("Kreis "), (F.col("user_id") % 10).cast("string")).alias("areaDesc"))).alias("area"),
        F.concat(F.lit("Eins "), n, F.lit(". Zwei. Eins "), n, F.lit(". Drei.")).alias("description"), F.when(F.col("event_id") % 3 == 0, F.lit("Fenster zu")).alias("instruction"),
    )
    return e.groupBy(F.floor(F.col("event_id") / 50)).agg(F.to_json(F.collect_list(warning)).alias("body"))


@query("SELECT 'mow.' || event_id || '-001' AS id, 'mow.' || event_id AS active_key, 'nina:mow.' || event_id || '-001:t' || event_id || ':' || CASE WHEN event_id % 2 = 0 THEN 'e' || event_id ELSE '' END || '::' || event_type AS alert_key, 'Kreis ' || user_id % 10 AS region FROM events WHERE event_id % 5 <> 0")
def civil_dashboards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hazards.civil_dashboard(_civil(spark, sf_dir))
    return rows.select("id", alerts.civil_active_key(F.col("id")).alias("active_key"), alerts.civil_alert_key(F.col("id"), F.col("data")).alias("alert_key"), alerts.civil_region(F.col("data")).alias("region"))


@query("SELECT 'mow.' || event_id || '-001' AS id, '📍 Kreis ' || user_id % 10 || chr(10) || 'ℹ️ Eins ' || event_id || '. Zwei.' || CASE WHEN event_id % 3 = 0 THEN chr(10) || '💡 Fenster zu' ELSE '' END AS description FROM events WHERE event_id % 5 <> 0")
def civil_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hazards.civil_dashboard(_civil(spark, sf_dir)).select("id", alerts.civil_description(F.col("data")).alias("description"))


@query("SELECT event_id::VARCHAR AS id, epoch_us(ts) // 1000 AS time, (user_id % 20)::DOUBLE AS lat, (event_id % 30)::DOUBLE AS lon, 'P' || event_id AS place, (event_id % 90) / 10 AS mag FROM events")
def quake_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as feature collections, read back."""
    e, n = _read(spark, sf_dir, "events"), F.col("event_id")
    feature = F.struct(n.cast("string").alias("id"), F.struct(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("time"), F.concat(F.lit("P"), n.cast("string")).alias("place"), ((n % 90) / 10).alias("mag")).alias("properties"), F.struct(F.array((n % 30).cast("double"), (F.col("user_id") % 20).cast("double"), F.lit(10.0)).alias("coordinates")).alias("geometry"))
    pages = e.groupBy(F.floor(n / 100)).agg(F.to_json(F.struct(F.collect_list(feature).alias("features"))).alias("body"))
    return hazards.quake_features(pages).select("id", "time", "lat", "lon", "place", "mag")


@query(f"SELECT event_id, 'G' || event_id AS link FROM events WHERE event_type <> 'view' AND {_S} >= {NOW} - 48 * 3600 AND 2 * 6371.0 * asin(sqrt(pow(sin(radians(user_id % 20 - 5) / 2), 2) + cos(radians(5)) * cos(radians(user_id % 20)) * pow(sin(radians(event_id % 30 - 9) / 2), 2))) <= 1500")
def disaster_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = _read(spark, sf_dir, "events"), F.col("event_id")
    rows = e.select("event_id", F.when(F.col("event_type") == "view", "GREEN alert").otherwise("Orange alert").alias("title"), F.concat(F.lit("G"), n.cast("string")).alias("link"), _seconds().alias("published_at"), (F.col("user_id") % 20).cast("double").alias("lat"), (n % 30).cast("double").alias("lon"))
    return alerts.disasters(rows, NOW, 5.0, 9.0, 1500.0).select("event_id", "link")


@query("SELECT event_id, user_id FROM events WHERE user_id % 7 = 0 OR abs(user_id % 20 - 9.75) < 3.5")
def warning_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings whose cell holds a point: the first layer counts, a cell without geometry is near."""
    cell, x = F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("cell_id"), F.col("user_id") % 20
    box = lambda lon, n: F.concat(F.lit('{"type":"Polygon","coordinates":[['), F.array_join(F.array(*[F.concat(F.lit("["), (lon + a).cast("string"), F.lit(f",{b}]")) for a, b in ((-n, -5), (n, -5), (n, 5), (-n, 5))]), ","), F.lit("]]}"))
    first, other = (F.lit(layer).alias("layer") for layer in alerts.GEOMETRY_LAYERS[:2])
    cells = _read(spark, sf_dir, "events").select("user_id").distinct().where("user_id % 7 <> 0")
    geometry = cells.select(cell, first, box(x, 3.5).alias("geojson")).unionByName(cells.select(cell, other, box(F.lit(9.75), 99.0).alias("geojson")))
    rows = _read(spark, sf_dir, "events").select("event_id", "user_id", cell)
    return alerts.with_geometry(rows, geometry, 0.0, 9.75).select("event_id", "user_id")


@query("SELECT event_id, user_id::VARCHAR AS day, hour(ts)::INTEGER AS utc_hour, event_id % 30 / 2 AS temperature, event_id % 101 AS precipitation, event_type AS icon FROM events")
def listed_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as responses that list hours."""
    n = F.col("event_id")
    hour = F.struct(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:00:00+00:00").alias("timestamp"), (n % 30 / 2).alias("temperature"), (n % 101).alias("precipitation_probability"), n.cast("double").alias("wind_speed"), F.col("event_type").alias("icon"))
    pages = _read(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("day")).agg(F.to_json(F.struct(F.collect_list(hour).alias("weather"))).alias("body"))
    return hazards.hourly_list(pages).select(F.col("wind").cast("bigint").alias("event_id"), "day", "utc_hour", "temperature", "precipitation", "icon")


@query("SELECT event_id, user_id::VARCHAR AS day, hour(ts)::INTEGER AS local_hour, event_id % 30 / 2 AS temperature, CASE event_id % 4 WHEN 0 THEN '☀️' WHEN 1 THEN '🌤️' WHEN 2 THEN '⛅' ELSE '☁️' END AS icon FROM events")
def zipped_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as responses of parallel lists."""
    n = F.col("event_id")
    row = F.struct(n, F.date_format("ts", "yyyy-MM-dd'T'HH:00").alias("t"), (n % 30 / 2).alias("c"), (n % 4).alias("code"))
    lists = _read(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("day")).agg(F.collect_list(row).alias("l"))
    part = lambda name: F.transform("l", lambda x: x[name])
    body = F.to_json(F.struct(F.struct(part("t").alias("time"), part("c").alias("temperature_2m"), part("event_id").alias("precipitation_probability"), part("c").alias("wind_speed_10m"), part("code").alias("weathercode")).alias("hourly")))
    return hazards.hourly_lists(lists.select("day", body.alias("body"))).select(F.col("precipitation").alias("event_id"), "day", F.col("utc_hour").alias("local_hour"), "temperature", "icon")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'B' || c_custkey WHEN c_custkey % 4 = 1 THEN 'D' || c_custkey WHEN c_custkey % 4 = 2 THEN 'S' || c_custkey END AS borough, CASE WHEN c_nationkey % 2 = 0 THEN CASE WHEN c_custkey % 3 = 0 THEN '110000000000' ELSE 'R' || c_custkey END END AS code FROM customer")
def place_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = _read(spark, sf_dir, "customer"), F.col("c_custkey")
    name = lambda p: F.concat(F.lit(p), k.cast("string"))
    address = F.when(k % 4 == 0, F.create_map(F.lit("borough"), name("B"), F.lit("suburb"), name("S"))).when(k % 4 == 1, F.create_map(F.lit("city_district"), name("D"))).when(k % 4 == 2, F.create_map(F.lit("suburb"), name("S"))).otherwise(F.create_map(F.lit("road"), name("R")))
    code = hazards.region_code(F.when(F.col("c_nationkey") % 2 == 0, "DE").otherwise("fr"), F.when(k % 3 == 0, "Berlin"), F.when(k % 3 == 1, "Town"), F.when(k % 3 == 2, "Village"), F.array(name("R")))
    return c.select("c_custkey", hazards.borough(address).alias("borough"), code.alias("code"))


@query("SELECT p_partkey, 'https://b.test/search?q=' || replace(url_encode(p_name), '%20', '+') || '&limit=' || least(p_size * 3, 100) || '&sort=latest&since=2024-01-01T00:00:00Z' AS url FROM part")
def post_search_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select("p_partkey", hazards.search_url(F.col("p_name"), F.col("p_size") * 3, F.lit("2024-01-01T00:00:00Z"), "https://b.test/search").alias("url"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1.0 WHEN o_custkey % 2 = 0 THEN 2.0 END::DOUBLE AS lat FROM orders")
def coordinates_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates by guid, else by link."""
    o = _read(spark, sf_dir, "orders")
    g, link = F.concat(F.lit("g"), F.col("o_orderkey").cast("string")), F.concat(F.lit("l"), F.col("o_custkey").cast("string"))
    rows = o.select("o_orderkey", g.alias("guid"), link.alias("link"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"))
    points = o.where("o_orderkey % 3 = 0").select(g.alias("key"), F.lit(1.0).alias("lat"), F.lit(0.0).alias("lon")).unionByName(o.where("o_custkey % 2 = 0").select(link.alias("key"), F.lit(2.0).alias("lat"), F.lit(0.0).alias("lon")).distinct())
    return feeds.attach_coordinates(rows, points).select("o_orderkey", "lat")


# -- messages --------------------------------------------------------------------------------------


@query("SELECT 'w' || s_suppkey AS alert_key, 'room' || r AS room, 'edit' AS op, '$' || s_suppkey || '-' || r AS event_id FROM supplier, range(0, 3) t(r) WHERE r <= s_suppkey % 3")
def edit_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits go to the rooms of a message's stored map only."""
    s = F.col("s_suppkey")
    ids = F.to_json(F.map_from_entries(F.transform(F.sequence(F.lit(0), (s % 3).cast("int")), lambda r: F.struct(F.concat(F.lit("room"), r.cast("string")), F.concat(F.lit("$"), s.cast("string"), F.lit("-"), r.cast("string"))))))
    return outbox.edits(_read(spark, sf_dir, "supplier").select(F.concat(F.lit("w"), s.cast("string")).alias("alert_key"), ids.alias("event_ids"), F.col("s_name").alias("plain"), F.col("s_name").alias("html"))).select("alert_key", "room", "op", "event_id")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'P' || event_id || chr(10) || chr(10) || '---' || chr(10) || '✅ Entwarnung (08:00): Diese Warnung gilt nicht mehr.' ELSE '✅ Entwarnung: ' || event_type || chr(10) || '📍 R' || user_id || chr(10) || 'Die Warnung ist nicht mehr aktiv.' || chr(10) || '📰 Source: DWD Weather Warnings' END AS plain FROM events")
def all_clear_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    added, _ = alerts.all_clear_suffix(F.concat(F.lit("P"), F.col("event_id").cast("string")), F.lit(""), F.lit("08:00"))
    own, _ = alerts.all_clear_message(F.col("event_type"), F.concat(F.lit("R"), F.col("user_id").cast("string")))
    return _read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, added).otherwise(own).alias("plain"))


@query(warnings._ROWS + f" SELECT event_id, {warnings._EMOJI} || ' ' || {warnings._OWN} || chr(10) || '📍 ' || region || chr(10) || 'ℹ️ ' || event || '. Mehr ' || event_id || '.' || CASE WHEN event_id % 2 = 0 THEN chr(10) || '(danach)' ELSE '' END AS description FROM keyed")
def warning_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    said = alerts.warning_description(F.col("region"), F.col("bucket"), F.col("level"), F.lit(None).cast("bigint"), F.lit(None).cast("bigint"), F.concat("event", F.lit(". Mehr "), n.cast("string"), F.lit(". Ende.")), F.lit(None).cast("string"), F.when(n % 2 == 0, F.array(F.lit("(danach)"))))
    return warnings.rows(spark, sf_dir).select("event_id", said.alias("description"))


@query("SELECT event_type, 'vicinity:digest:2024-01-31 08:00:' || string_agg(event_id, ',' ORDER BY event_id) AS key FROM events GROUP BY event_type")
def digest_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = _read(spark, sf_dir, "events").groupBy("event_type").agg(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")).alias("guids"))
    return groups.select("event_type", digest.post_key(F.lit("2024-01-31 08:00"), F.col("guids")).alias("key"))


@query("SELECT event_id, event_id % 4 IN (0, 1) AS missing, event_id % 3 = 0 AS rolling, event_id % 5 < 2 AS google, event_id % 6 < 2 AS polluted FROM events")
def link_and_error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    error = F.when(n % 4 == 0, "M_NOT_FOUND: x").when(n % 4 == 1, "Event was Redacted").when(n % 4 == 2, "timeout").otherwise("")
    url = F.concat(F.when(n % 5 == 0, "https://NEWS.google.de/").when(n % 5 == 1, "https://www.google.com/url?q=").otherwise("https://x.test/"), F.when(n % 3 == 0, "LiveTicker/").otherwise("a/"), n.cast("string"))
    words = F.when(n % 6 == 0, "Die  GROSSE Straße").when(n % 6 == 1, "ein Fluß").otherwise("nichts")
    return _read(spark, sf_dir, "events").select("event_id", text.is_missing_message(error).alias("missing"), text.is_rolling_url(url).alias("rolling"), text.is_google_url(url).alias("google"), text.contains_any_normalized(words, ["straße", "Fluss"]).alias("polluted"))


@query("SELECT s_suppkey % 10 AS hour, count(*) FILTER (s_suppkey % 3 = 0) = 0 AS ok, coalesce(string_agg(s_name, ', ' ORDER BY s_name) FILTER (s_suppkey % 3 = 0), '') AS failed FROM supplier GROUP BY 1 HAVING s_suppkey % 10 = 3")
def alert_round_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "supplier").where("s_suppkey % 10 = 3")
    health = routing.round_health(rows.where("s_suppkey % 3 = 0").withColumn("error", F.lit("timed out")), "s_name", "error")
    return health.select(F.lit(3).cast("bigint").alias("hour"), "ok", "failed")


@query(f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'done' WHEN o_orderkey % 5 = 1 AND o_custkey % 1200 < 600 THEN 'now' WHEN o_orderkey % 12000 + o_custkey % 1200 + 900 > 10800 THEN 'missed' ELSE 'later' END AS step, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 AND o_custkey % 1200 < 600 THEN {NOW} + o_orderkey % 12000 + o_custkey % 1200 WHEN o_orderkey % 12000 + o_custkey % 1200 + 900 > 10800 THEN NULL ELSE {NOW} + o_orderkey % 12000 + o_custkey % 1200 + 900 END AS at FROM orders")
def slot_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot posts that failed, within the post window, the catch-up window or neither."""
    n, late = F.col("o_orderkey"), F.lit(NOW) + F.col("o_orderkey") % 12000
    posts = _read(spark, sf_dir, "orders").select(n.alias("id"), F.lit(NOW).alias("slot_at"), late.alias("started_at"), F.when(n % 5 != 0, late + F.col("o_custkey") % 1200).alias("failed_at"), (n % 5 == 1).alias("transient"))
    return schedule.next_attempt(posts)


# -- life cycles -----------------------------------------------------------------------------------

_PRIMARY = warnings._ROWS + f", s AS ({warnings._snapshot(str(warnings.NOW_MS))}), p AS (SELECT * FROM s WHERE place = 1)"
_ANSWER = "(['ok', 'missing_original', 'failed'])[length(region || family) % 3 + 1]"


@query(f"{_PRIMARY} SELECT key, CASE WHEN level % 2 = 0 THEN 'update' WHEN length(region || family) % 5 = 0 THEN 'noop' ELSE 'reconcile' END AS action, CASE WHEN level % 2 <> 0 AND length(region || family) % 5 = 0 THEN NULL WHEN {_ANSWER} = 'failed' THEN 'retry' WHEN {_ANSWER} = 'missing_original' THEN 'repost' ELSE 'store' END AS next FROM p")
def reconcile_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An hourly round: unchanged warnings with a message are written again, lost messages posted anew."""
    current = keep(warnings.snapshot(spark, sf_dir), "current")
    shape = F.length(F.concat("region", "family"))
    held = current.where("place = 1").select(F.col("key").alias("id"), "region", "event", "level", F.when(F.col("level") % 2 == 0, F.col("start_ms") - 1).otherwise(F.col("start_ms")).alias("start_ms"), "end_ms", F.when(shape % 5 != 0, F.lit("{}")).alias("event_ids"), F.get(F.array(F.lit("ok"), F.lit("missing_original"), F.lit("failed")), shape % 3).alias("result"))
    diff = alerts.reconciled(alerts.snapshot_diff(current, held), held, alerts.reconcile_due(F.lit(warnings.NOW_MS - alerts.RECONCILE_MS), F.lit(warnings.NOW_MS)))
    done = diff.join(held.select(F.col("id").alias("key"), "result"), "key")
    return done.select("key", "action", F.when(F.col("action") != "noop", alerts.after_edit(F.col("action"), F.col("result"))).alias("next"))


@query("""WITH w AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'Cancel' ELSE 'Update' END AS kind, c_custkey % 3 > 0 AS posted, c_custkey % 5 < 2 AS moved, (['ok', 'missing_original', 'failed'])[c_nationkey % 3 + 1] AS result FROM customer WHERE c_custkey % 7 <> 0),
 a AS (SELECT *, CASE WHEN kind = 'Cancel' THEN CASE WHEN posted THEN 'all_clear' ELSE 'forget' END WHEN NOT posted THEN 'post' WHEN moved THEN 'edit' ELSE 'noop' END AS action FROM w)
 SELECT c_custkey::VARCHAR AS id, action, CASE WHEN action IN ('noop', 'forget') THEN NULL WHEN result = 'failed' THEN 'retry' WHEN action = 'all_clear' THEN 'end' WHEN result = 'ok' THEN 'store' WHEN action = 'post' THEN 'retry' ELSE 'repost' END AS next FROM a""")
def civil_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Civil warnings: posted, edited, cancelled, lost and seen ones."""
    c, k = _read(spark, sf_dir, "customer"), F.col("c_custkey")
    id_ = k.cast("string").alias("id")
    key = lambda version: F.concat(k.cast("string"), F.lit(":"), version)
    now = F.when(k % 5 < 2, "2").otherwise("1")
    current = c.select(id_, key(now).alias("key"), F.when(k % 4 == 0, "Cancel").otherwise("Update").alias("msg_type"))
    active = c.where("c_custkey % 3 > 0").select(id_, key(F.lit("1")).alias("key"))
    seen = c.where("c_custkey % 7 = 0").select(key(now).alias("id"))
    diff = alerts.civil_diff(current, active, seen)
    results = c.select(id_, F.get(F.array(F.lit("ok"), F.lit("missing_original"), F.lit("failed")), F.col("c_nationkey") % 3).alias("result"))
    return diff.join(results, "id").select("id", "action", F.when(~F.col("action").isin("noop", "forget"), alerts.after_edit(F.col("action"), F.col("result"))).alias("next"))


@query("SELECT s_suppkey::VARCHAR AS id, s_suppkey * 10 AS start_ms, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey ELSE s_suppkey + 5 END AS end_ms FROM supplier WHERE s_suppkey % 4 <> 1")
def reposted_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings whose message is gone: the first attempt's window and key stay, all rooms must have it."""
    s, n = _read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    gone = s.select(n.cast("string").alias("id"), F.lit("dwd").alias("source"), (n * 10).alias("start_ms"), (n + 5).alias("end_ms"), F.lit("{}").alias("event_ids"), F.col("s_name").alias("plain"), F.col("s_name").alias("html"))
    first = gone.where("cast(id as bigint) % 3 = 0").select("id", "source", F.concat(F.lit("first "), "id").alias("key"), "start_ms", (F.col("end_ms") - 5).alias("end_ms"), F.lit(1).cast("bigint").alias("created_at"))
    keys, posts = outbox.reposts(gone, first, outbox.rooms(spark, ["a", "b"]), 2)
    bad = s.where("s_suppkey % 4 = 1").select(n.cast("string").alias("id")).join(keys, "id").select("alert_key" if "alert_key" in keys.columns else F.col("key").alias("alert_key"), F.lit("b").alias("room"), F.lit("down").alias("error"))
    results = posts.join(bad, ["alert_key", "room"], "left").select("alert_key", "room", F.when(F.col("error").isNull(), F.concat(F.lit("$"), "txn_id")).alias("event_id"), "error")
    return outbox.reposted(keys, results).select("id", "start_ms", "end_ms")


@query(f"""WITH f AS (SELECT user_id, event_id, ts, lag(ts) OVER w AS before FROM events WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 g AS (SELECT *, sum(CASE WHEN before IS NULL OR epoch_ms(ts) - epoch_ms(before) > 7 * 86400000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS term FROM f),
 n AS (SELECT user_id, row_number() OVER (PARTITION BY user_id, term ORDER BY ts, event_id)::INTEGER AS attempts FROM g) SELECT user_id::VARCHAR AS guid, attempts, attempts >= {routing.MAX_ATTEMPTS} AS final, count(*) AS n FROM n GROUP BY ALL""")
def streaming_retry_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures counted by a keyed stream, forgotten after a week."""
    rows = _read(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").cast("string").alias("guid"), F.col("ts").cast("timestamp").alias("at"))
    feed = _folder(spark, sf_dir, "retry-feed")
    rows.write.parquet(feed)
    out = _folder(spark, sf_dir, "retry")
    stream = timers.retry_counters(spark.readStream.schema(rows.schema).parquet(feed))
    _finish(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(), spark)
    return spark.read.schema(timers.RETRY_OUT).parquet(out).groupBy("guid", "attempts", "final").agg(F.count("*").alias("n"))


# -- stores and streets ----------------------------------------------------------------------------


@query(f"SELECT event_id, {_S} AS ts FROM events WHERE {_S} >= 1706659200 - 30 * 86400 + 86400 * 7")
def statistics_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poll statistics appended, without rows over thirty days old."""
    rows = _read(spark, sf_dir, "events").select("event_id", _seconds().alias("ts"))
    return store.append_stats(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), 1706659200 + 7 * 86400)


@query(f"SELECT doc_id AS guid FROM documents WHERE doc_id % 5 < 3 OR {NOW} - doc_id * 1130 % 2000000 >= {NOW} - 14 * 86400")
def pruned_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    rows = _read(spark, sf_dir, "documents").select(n.alias("guid"), F.get(F.array(*[F.lit(s) for s in ("queued", "candidate", "processing", "posted", "dropped")]), (n % 5).cast("int")).alias("state"), (F.lit(NOW) - n * 1130 % 2000000).alias("discovered_at"))
    return store.prune(rows, NOW, 14).select("guid")


@query("SELECT doc_id, [doc_id] AS guids, 1 AS source_count, 'x' AS added FROM documents")
def digest_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = digest.seeds(_read(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("guid")))
    return store.with_columns(rows, {"added": "string"}).select("doc_id", "guids", "source_count", F.coalesce("added", F.lit("x")).alias("added"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 5000 > 3000 THEN 2 WHEN o_custkey % 5000 > 1000 THEN 1 ELSE 0 END::INTEGER AS penalty FROM orders")
def vagueness_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select("o_orderkey", geo.vagueness_penalty(F.col("o_orderkey").cast("double"), (F.col("o_orderkey") + F.col("o_custkey") % 5000).cast("double")).cast("int").alias("penalty"))


@query("""WITH m AS (SELECT s_suppkey AS id, (s_suppkey % 40) * 0.002 AS a FROM supplier), h AS (SELECT *, unnest([0, 1, 2]) AS pos FROM m),
 d AS (SELECT id, pos, (a + (CASE pos WHEN 0 THEN 0.01 WHEN 1 THEN 0.002 ELSE 1 END)) * pi() / 180 * 6371000 AS meters FROM h WHERE pos < 2), n AS (SELECT id, arg_min(pos, meters) AS pos, min(meters) AS meters, max(meters) AS far FROM d GROUP BY id)
 SELECT id, round(meters, 3) AS meters, 'Hof ' || id || ', Teil ' || pos AS label, CASE WHEN far - meters > 3000 THEN 2 WHEN far - meters > 1000 THEN 1 ELSE 0 END::INTEGER AS penalty FROM n WHERE meters < 10000""")
def nearest_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up answers of a geocoder along the equator: parts within five kilometres of the first, the nearest counts."""
    s, n = _read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    name = F.concat(F.lit("X"), F.translate(n.cast("string"), "0123456789", "abcdefghij"), F.lit("straße"))
    mentions = s.select(n.alias("id"), name.alias("candidate"), F.lit(5).alias("confidence"), F.lit(True).alias("prominent"), F.lit(0).alias("pos"))
    raw = s.withColumn("pos", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    lon = (n % 40) * 0.002 + F.when(F.col("pos") == 0, 0.01).when(F.col("pos") == 1, 0.002).otherwise(1.0)
    answers = raw.select(name.alias("candidate"), "pos", F.lit("0").alias("lat"), lon.cast("string").alias("lon"), name.alias("name"), F.concat(F.lit("Hof "), n.cast("string"), F.lit(", Teil "), F.col("pos").cast("string")).alias("display_name"), F.create_map(F.lit("city"), F.lit("Ort"), F.lit("road"), name).alias("address"), F.lit(None).cast("string").alias("geojson"))
    texts = s.select(n.alias("id"), F.lit("x").alias("prominent_text"), F.lit("").alias("rest_text"), F.lit(None).cast("string").alias("district"))
    got = streets.nearest_street(mentions, streets.validated_hits(answers, "Ort, DE"), texts, 0.0, 0.0)
    return got.select("id", F.round("meters", 3).alias("meters"), "label", F.col("penalty").cast("int").alias("penalty"))
