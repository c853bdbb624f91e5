"""Further queries: one for each operator that the other plans do not show by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.catalog import query
from vicinity.config import FilterConfig, Place
from vicinity.functions import dates, geo, text
from vicinity.functions.shared import keep
from vicinity.operators import alerts, enrich, evidence, forecast, routing, store
from vicinity.plans import items as plan_items
from vicinity.plans import warnings
from vicinity.plans.items import NOW, TITLE_SQL, items, norm_sql, points
from vicinity.sources import feeds

_ITEMS = f"WITH items AS (SELECT doc_id, source AS source_name, {TITLE_SQL} AS title, coalesce(text, '') AS text FROM documents)"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


@query("SELECT o_orderkey, CASE WHEN o_totalprice / 10 < 1000 THEN '~' || round(o_totalprice / 10)::BIGINT || 'm' ELSE '~' || round_even(o_totalprice / 10 / 1000, 1)::DECIMAL(18,1) || 'km' END AS distance, (['⚪', '🔵', '🟢', '🟡', '🟠', '🔴', '🔴'])[o_orderkey % 7 + 1] AS colour FROM orders")
def distance_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("o_orderkey", text.format_distance(F.col("o_totalprice") / 10).alias("distance"), text.score_color(F.col("o_orderkey") % 7).alias("colour"))


@query("SELECT p_partkey, array_to_string(list_slice(list_filter(list_transform(string_split(p_name || ', ' || p_brand || ',, ' || p_type || ',x', ','), lambda x: trim(x)), lambda x: x <> ''), 1, 3), ', ') AS label FROM part")
def short_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", text.short_location(F.concat("p_name", F.lit(", "), "p_brand", F.lit(",, "), "p_type", F.lit(",x"))).alias("label"))


@query("SELECT c_custkey, replace(replace(replace(replace(c_name || '<' || c_mktsegment || '> & \"x\"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM customer")
def html_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", text.html_escape(F.concat("c_name", F.lit("<"), "c_mktsegment", F.lit('> & "x"'))).alias("escaped"))


@query("WITH s AS (SELECT *, s_name || CASE s_suppkey % 3 WHEN 0 THEN ' Straße ' WHEN 1 THEN '-Strasse ' ELSE ' Allee ' END || s_suppkey % 90 AS c FROM supplier), b AS (SELECT *, regexp_replace(c, ' [0-9][^ ]*$', '') AS street FROM s) SELECT s_suppkey, street, replace(" + norm_sql("street") + ", '-', ' ') = replace(" + norm_sql("s_name || ' Str.'") + ", '-', ' ') AS named FROM b")
def street_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("s_suppkey") % 3 == 0, " Straße ").when(F.col("s_suppkey") % 3 == 1, "-Strasse ").otherwise(" Allee ")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name", text.street_without_number(F.concat("s_name", kind, (F.col("s_suppkey") % 90).cast("string"))).alias("street"))
    return s.select("s_suppkey", "street", text.street_matches(F.col("street"), F.concat("s_name", F.lit(" Str."))).alias("named"))


@query(f"{_ITEMS}, w AS (SELECT doc_id, {norm_sql('text')} AS hay, {plan_items.SIGNIFICANT_SQL} AS words FROM items), h AS (SELECT *, len(list_filter(words, lambda x: contains(hay, x))) AS hits FROM w) SELECT doc_id, len(words) < 2 OR hits >= 2 OR hits * 2 >= len(words) AS matches FROM h")
def title_matches_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("doc_id", text.text_matches_title(F.col("text"), F.col("title")).alias("matches"))


@query(f"{_ITEMS}, m AS (SELECT doc_id, text, list_min(list_filter([strpos(lower(text), w) for w in ['newsletter', 'impressum', 'weitere artikel']], lambda x: x > 0)) AS stop FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' Newsletter abonnieren' WHEN doc_id % 3 = 1 THEN text || ' Weitere Artikel: x. IMPRESSUM' ELSE text END AS text FROM items)) SELECT doc_id, length(CASE WHEN stop IS NULL THEN text ELSE substr(text, 1, stop - 1) END) AS n FROM m")
def article_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id") % 3
    long = F.when(n == 0, F.concat("text", F.lit(" Newsletter abonnieren"))).when(n == 1, F.concat("text", F.lit(" Weitere Artikel: x. IMPRESSUM"))).otherwise(F.col("text"))
    return items(spark, sf_dir).select("doc_id", F.length(text.relevant_article_text(long)).cast("long").alias("n"))


@query("SELECT source, array_to_string(list_transform(list_sort(list_distinct(list_transform(range(0, 4), lambda i: lower(CASE WHEN i % 2 = 0 THEN source ELSE upper(source) END)))), lambda x: source), ' + ') AS names FROM (SELECT DISTINCT source FROM documents)")
def unique_source_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source").distinct()
    return names.select("source", F.array_join(text.unique_names(F.array("source", F.upper("source"), "source", F.upper("source"))), " + ").alias("names"))


_AWAY = FilterConfig(home_borough="src1", elsewhere=["hatio", "thble"], places=[Place("anent", 0, 0)])


@query(f"{_ITEMS} SELECT doc_id, CASE WHEN doc_id % 4 = 0 AND {norm_sql('source_name')} <> 'src1' THEN 'filed under ' || source_name || ', not src1' WHEN NOT {plan_items.find_sql(norm_sql('title'), 'anent', True)} THEN CASE WHEN {plan_items.find_sql(norm_sql('title'), 'hatio', True)} THEN 'title names hatio' WHEN {plan_items.find_sql(norm_sql('title'), 'thble', True)} THEN 'title names thble' END END AS why FROM items")
def located_elsewhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    filed = F.when(F.col("doc_id") % 4 == 0, F.col("source_name"))
    return items(spark, sf_dir).select("doc_id", evidence.located_elsewhere(F.col("title"), filed, _AWAY).alias("why"))


@query("WITH p AS (SELECT s_suppkey AS id, 52.4 + (s_suppkey % 1000) / 5000.0 AS lat, 13.3 + (s_suppkey * 7 % 1000) / 3000.0 AS lon FROM supplier), d AS (SELECT id, list_transform([[52.5, 13.4], [52.53, 13.5], [lat + 0.001, lon]], lambda v: 2 * 6371000.0 * asin(sqrt(pow(sin(radians(v[1] - lat) / 2), 2) + cos(radians(lat)) * cos(radians(v[1])) * pow(sin(radians(v[2] - lon) / 2), 2)))) AS v FROM p) SELECT id, round(list_max(v))::BIGINT AS far FROM d")
def shape_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    shape = geo.geojson_paths(F.lit('{"type":"LineString","coordinates":[[13.4,52.5],[13.5,52.53]]}'))
    return p.select("id", geo.distance_range(F.col("lat"), F.col("lon"), F.col("lat") + 0.001, F.col("lon"), shape).alias("d")).select("id", F.round("d.far").cast("long").alias("far"))


@query("SELECT event_id, CASE WHEN event_type = 'error' OR (user_id % 5 > 0 AND event_id % 7 = 0) THEN 'failed' WHEN event_id % 3 > 0 THEN 'ok' ELSE 'idle' END AS health FROM events")
def poll_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", routing.poll_health((F.col("event_type") == "error").cast("int"), F.col("user_id") % 5, F.col("event_id") % 7, F.col("event_id") % 3).alias("health"))


@query(f"SELECT event_id, floor(({NOW} - floor(epoch(ts))) / 3600.0) > 240 AS old, floor(epoch(ts)) >= {NOW} - 240 * 3600 AS scanned, least(floor(epoch(ts))::BIGINT, CASE WHEN event_id % 2 = 0 THEN {NOW} - 900000 END) AS published FROM events")
def item_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", routing.too_old(at, F.lit(NOW), F.lit(240)).alias("old"), routing.within_age(at, F.lit(NOW), 240).alias("scanned"), routing.merged_published(at, F.when(F.col("event_id") % 2 == 0, F.lit(NOW - 900000))).alias("published"))


@query("SELECT event_id FROM events WHERE user_id % 10 IN (1, 7)")
def region_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warnings.rows(spark, sf_dir).where(alerts.region_matches(F.col("region"), [" region 1 ", "", "N 7"])).select("event_id")


@query(warnings._ROWS + " SELECT event_id, key || '|end=' || end_ms || CASE WHEN event_id % 2 = 0 THEN '|replaces={\"r\":\"' || event_id || '\"}' ELSE '' END AS post_key, family, level FROM keyed")
def warning_post_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = warnings.rows(spark, sf_dir).withColumn("key", alerts.stable_key(F.col("bucket"), F.col("region"), F.col("event"), F.col("level")))
    replaced = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"r":"'), F.col("event_id").cast("string"), F.lit('"}')))
    parsed = alerts.parse_stable_key(F.col("key"))
    return w.select("event_id", alerts.post_key(F.col("key"), F.col("end_ms"), replaced).alias("post_key"), parsed["event"].alias("family"), parsed["level"].alias("level"))


@query(warnings._ROWS + " SELECT event_id, '🚨 ' || event || chr(10) || region || chr(10) || '📰 Source: S' AS plain, CASE WHEN level > 2 THEN '⬆️' ELSE '⬇️' END || ' Warnung aktualisiert: Warnstufe ' || CASE WHEN level > 2 THEN 'erhöht' ELSE 'reduziert' END || ' auf ' || " + warnings._EMOJI + " || ' ' || " + warnings._PLAIN + " || '; jetzt: ' || event || ' (08:00).' AS change FROM keyed")
def warning_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain, _ = alerts.alert_message(F.lit("S"), F.col("event"), F.col("region"), F.lit(None).cast("string"))
    change, _ = alerts.level_change_suffix(F.lit(""), F.lit(""), F.lit(2), F.col("level"), F.col("event"), F.lit("08:00"))
    return warnings.rows(spark, sf_dir).select("event_id", plain.alias("plain"), F.substring(change, 7, 999).alias("change"))


@query("WITH n AS (SELECT user_id::VARCHAR AS id, arg_min(event_id, event_id) AS first FROM events WHERE event_type <> 'error' GROUP BY 1), o AS (SELECT user_id::VARCHAR AS id, min(event_id) AS first FROM events WHERE event_type = 'error' GROUP BY 1), a AS (SELECT id, coalesce(o.first, n.first) AS first FROM n FULL JOIN o USING (id)) SELECT id, first FROM a WHERE id::BIGINT % 2 = 0")
def post_key_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First keys stay over later ones, and go with their warning."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    key = lambda rows: rows.select(F.col("user_id").cast("string").alias("id"), F.lit("s").alias("source"), F.col("event_id").cast("string").alias("key"), F.col("event_id").alias("created_at"))
    stored = store.post_keys(store.first_rows(key(e.where("event_type = 'error'")), "id", "created_at"), key(e.where("event_type <> 'error'")))
    current = stored.where(F.col("id").cast("bigint") % 2 == 0)
    return store.forget_keys_except(stored, "s", current).select("id", F.col("created_at").alias("first"))


@query("WITH l AS (SELECT DISTINCT event_type AS id FROM events), s AS (SELECT 'digest:' || event_id AS id FROM events) SELECT id FROM l UNION ALL SELECT id FROM s")
def alert_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    seen = e.select(F.col("event_type").alias("id"), F.lit("feed").alias("source"), F.col("event_id").alias("sent_at"))
    ledger = store.mark_seen(seen.limit(0), seen)
    slots = e.select(store.slot_id(F.lit("digest"), F.col("event_id").cast("string")).alias("id"), F.lit("digest").alias("source"), F.col("event_id").alias("sent_at"))
    return store.mark_seen(ledger, slots).select("id")


@query(warnings._HOURS.replace("WITH r", "WITH r", 1) + """ SELECT day, '🌦️ Weather · ' || day || chr(10) || string_agg(CASE l WHEN 7 THEN '🌅 Morning' WHEN 13 THEN '🌞 Midday' WHEN 18 THEN '🌆 Evening' ELSE '🌙 Night' END || ': ' || (['""" + "', '".join(e for e, _ in forecast.ICONS.values()) + """'])[list_position([""" + ", ".join(f"'{i}'" for i in forecast.ICONS) + """], icon)] || ' ' || round_even(temperature, 0)::BIGINT || '°C  💧 ' || precipitation || '%  💨 ' || wind || ' km/h', chr(10) ORDER BY l) AS plain FROM g GROUP BY day""")
def weather_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = forecast.pick_hours(warnings.readings(spark, sf_dir), ["day"], 1)
    return forecast.message(picked, ["day"], F.col("day")).select("day", "plain")


@query(f"SELECT event_id, round_even(value, 1)::DECIMAL(6,1)::VARCHAR AS mag FROM events WHERE ts >= TIMESTAMP '2024-01-29' AND 2 * 6371.0 * asin(sqrt(pow(sin(radians(user_id % 20 - 10) / 2), 2) + cos(radians(10)) * cos(radians(user_id % 20)) * pow(sin(radians(event_id % 30 - 15) / 2), 2))) <= 900")
def quake_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    quakes = e.select("event_id", F.col("event_id").cast("string").alias("id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("time"), (F.col("user_id") % 20).cast("double").alias("lat"), (F.col("event_id") % 30).cast("double").alias("lon"), "value")
    near = alerts.quakes(quakes, NOW * 1000, 10.0, 15.0, 900.0)
    said = alerts.quake_description(F.lit(None).cast("string"), F.lit(None).cast("bigint"), F.col("value"), F.lit(None).cast("string"))
    return near.select("event_id", F.regexp_extract(said, r"Magnitude (.*)$", 1).alias("mag"))


@query("WITH c AS (SELECT conv_id, turn, trim(text, E' \\t\\n\\r') AS said FROM conversations) SELECT 'at://x/' || conv_id || '-' || turn AS guid, substr(trim(list_filter(string_split(said, chr(10)), lambda l: trim(l) <> '')[1]), 1, 120) AS title, 'https://bsky.app/profile/' || CASE WHEN conv_id % 2 = 0 THEN 'h' || conv_id ELSE 'unknown' END || '/post/' || conv_id || '-' || turn AS link, 1704067200 + turn AS published_at FROM c WHERE said <> ''")
def social_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as pages of posts, read back as items."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    uri = F.concat(F.lit("at://x/"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    made = F.date_format(F.timestamp_seconds(1704067200 + F.col("turn")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    post = F.struct(uri.alias("uri"), F.when(F.col("conv_id") % 2 == 0, F.struct(F.concat(F.lit("h"), F.col("conv_id").cast("string")).alias("handle"))).alias("author"), F.struct("text", made.alias("createdAt")).alias("record"))
    pages = c.groupBy(F.floor(F.col("conv_id") / 20).alias("page")).agg(F.to_json(F.struct(F.collect_list(post).alias("posts"))).alias("body")).withColumn("source_name", F.lit("posts"))
    return feeds.social_posts(pages).select("guid", "title", "link", "published_at")


@query(f"WITH t AS (SELECT doc_id, trim(regexp_replace({TITLE_SQL}, '\\s+', ' ', 'g')) AS title FROM documents) SELECT 'g' || doc_id AS guid, title, 'https://x.test/' || doc_id AS link, 1704067200 + doc_id AS published_at, CASE WHEN doc_id % 2 = 0 THEN 52.5::DOUBLE END AS lat FROM t WHERE title <> ''")
def feed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as feeds of fifty entries, parsed and normalised."""
    rows = items(spark, sf_dir)
    stamp = F.date_format(F.timestamp_seconds(1704067200 + F.col("doc_id")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    part = lambda tag, c: F.concat(F.lit(f"<{tag}>"), text.html_escape(c), F.lit(f"</{tag}>"))
    n = F.col("doc_id").cast("string")
    entry = F.concat(F.lit("<item>"), part("guid", F.concat(F.lit("g"), n)), part("title", text.html_escape(F.col("title"))), part("link", F.concat(F.lit("https://x.test/"), n)), part("pubDate", stamp), F.when(F.col("doc_id") % 2 == 0, F.lit("<p:point>52.5 13.4</p:point>")).otherwise(F.lit("")), F.lit("</item>"))
    made = rows.groupBy(F.floor(F.col("doc_id") / 50).alias("n")).agg(F.concat(F.lit('<rss xmlns:p="urn:p">'), F.array_join(F.collect_list(entry), ""), F.lit("</rss>")).alias("xml")).withColumn("source_name", F.lit("made"))
    return feeds.parse(made).select("guid", "title", "link", "published_at", "lat")


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'https://news.google.com/rss/search?q=' || replace(url_encode(p_name), '%20', '+') || '&hl=de&gl=DE&ceid=DE:de' END AS url FROM part")
def search_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", feeds.search_feed_url(F.when(F.col("p_partkey") % 5 == 0, "  ").otherwise(F.col("p_name"))).alias("url"))


@query(f"SELECT event_id, strftime(ts - INTERVAL 24 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS since, ((7 - event_id % 5 + 48) % 24)::INTEGER AS utc_hour, CASE WHEN event_id % 7 < 2 THEN NULL ELSE (event_id % 24) * 60 + event_id % 60 END::INTEGER AS minutes FROM events")
def hours_and_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = F.col("event_id")
    clock = F.when(n % 7 == 0, "25:00").when(n % 7 == 1, "nonsense").otherwise(F.format_string("%02d:%02d", n % 24, n % 60))
    return e.select("event_id", dates.since(F.col("ts").cast("timestamp"), 24).alias("since"), dates.utc_hour(F.lit(7), n % 5).alias("utc_hour"), dates.time_of_day(clock).cast("int").alias("minutes"))


_ROUND = FilterConfig(area=plan_items.CONFIG.area, places=plan_items.CONFIG.places, required=plan_items.CONFIG.required, blocklist=plan_items.CONFIG.blocklist, elsewhere=plan_items.CONFIG.elsewhere, digest_threshold=3, candidate_min_score=2)


@query()
def poll_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A round over documents and an item for each page: seen items, sources, pages, all evidence, failed
    lookups, last attempts, outcome."""
    n = F.col("doc_id")
    docs = items(spark, sf_dir).select(n.cast("string").alias("guid"), "title", F.when(n % 5 == 0, F.concat(F.lit("p"), (n % 300).cast("string"))).alias("link"), F.when(n % 4 == 1, F.concat(F.lit("Brand in der Hofstraße "), (n % 50).cast("string"))).alias("description"), F.when(n % 5 != 0, F.col("text")).alias("article_text"), "source_name", (F.lit(NOW) - n * 420).alias("published_at"), F.when(n % 9 == 0, F.lit(52.52)).alias("lat"), F.when(n % 9 == 0, F.lit(13.47)).alias("lon"), F.lit(None).cast("string").alias("district"))
    n = F.col("page_id")
    linked = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("p"), n.cast("string")).alias("guid"), F.col("url").alias("title"), F.concat(F.lit("p"), n.cast("string")).alias("link"), F.lit("pages").alias("source_name"), (F.lit(NOW) - n * 420).alias("published_at"))
    docs = docs.unionByName(linked, allowMissingColumns=True)
    names = docs.select(F.col("source_name").alias("name")).distinct().select("name", F.lit(96).cast("bigint").alias("max_age_hours"), (F.col("name") != "src3").alias("filter"), F.when(F.col("name") == "src4", F.lit(900.0)).alias("base_implied_meters"), F.lit(None).cast("array<string>").alias("required"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("url"), "html")
    docs = keep(docs, "docs")
    stored = docs.where(F.try_to_number("guid", F.lit("999999999999")) % 11 == 3).select("guid")
    retries = docs.where("guid like 'p%7'").select("guid", F.lit(routing.MAX_ATTEMPTS).alias("attempts"))
    # answers for house numbers below 40, further away each; lookups of the others failed
    k, name = F.col("id"), F.concat(F.lit("Hofstraße "), F.col("id").cast("string"))
    hits = spark.range(40).select(name.alias("candidate"), F.lit(0).alias("pos"), (F.lit(plan_items.REF[0]) + k / 1000).alias("lat"), F.lit(plan_items.REF[1]).alias("lon"), F.concat(F.lit("Hofstraße, Teil "), k.cast("string")).alias("display_name"), F.lit(None).cast("string").alias("suburb"), F.lit(None).cast("string").alias("borough"), F.array().cast(geo.PATHS).alias("shape"))
    failed = spark.range(40, 50).select(name.alias("candidate"))
    done = enrich.poll_round(docs, stored, retries, names, pages, hits, failed, _ROUND, plan_items.REF, NOW, articles=False)
    return done.select("guid", "outcome", "reason", "score", "location_label")
