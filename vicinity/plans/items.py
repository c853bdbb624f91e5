"""Queries over documents as feed items: text functions, mentions, evidence, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.catalog import query
from vicinity.config import AreaGroup, FilterConfig, Place
from vicinity.functions import geo, text
from vicinity.operators import evidence, routing

NOW = 1706659200  # 2024-01-31 00:00:00 UTC
CONFIG = FilterConfig(
    area=[AreaGroup(800.0, ["thble", "that"]), AreaGroup(1500.0, ["attion", "ering"]), AreaGroup(6000.0, ["die", "los"])],
    places=[Place("anent", 52.51, 13.45), Place("eaing", 52.55, 13.52, ["oning"])],
    required=["the", "der", "les", "los", "un"], blocklist=["esand", "shouha"], elsewhere=["hatio", "nderes"], digest_threshold=3, candidate_min_score=2,
)
REF = (52.52, 13.46)

# The pieces of DuckDB's SQL that the oracles share.
TITLE_SQL = "substr(trim(coalesce(list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: trim(l) <> '')[1], '')), 1, 120)"
ALNUM_SQL = "[\\p{L}\\p{M}\\p{N}]"


def norm_sql(x: str) -> str:
    return f"replace(replace(replace(lower({x}), 'ß', 'ss'), 'strasse', 'str'), 'str.', 'str')"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as feed items: the first line with text is the title."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.col("source").alias("source_name"), title(F.col("text")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))


def title(body: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(body, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    return F.substring(F.trim(F.coalesce(F.get(lines, F.lit(0)), F.lit(""))), 1, 120)


SIGNIFICANT_SQL = f"""list_slice(list_filter(list_transform(list_filter(string_split_regex({norm_sql('title')}, '\\s+'), lambda w: w <> ''), lambda w: regexp_replace(regexp_replace(w, '^[^\\p{{L}}\\p{{N}}]+', ''), '[^\\p{{L}}\\p{{N}}]+$', '')), lambda w: length(w) >= 5 AND NOT list_contains([{', '.join(f"'{w}'" for w in text.SIGNIFICANT_STOP_WORDS)}], w)), 1, 8)"""
_ITEMS = f"WITH items AS (SELECT doc_id, source AS source_name, {TITLE_SQL} AS title, coalesce(text, '') AS text FROM documents)"


@query(f"{_ITEMS} SELECT doc_id, {norm_sql('title')} AS normalized FROM items")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("doc_id", text.normalize(F.col("title")).alias("normalized"))


@query(f"{_ITEMS} SELECT doc_id, array_to_string({SIGNIFICANT_SQL}, ' ') AS words, len({SIGNIFICANT_SQL}) AS n FROM items")
def significant_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = text.significant_words(F.col("title"))
    return items(spark, sf_dir).select("doc_id", F.array_join(words, " ").alias("words"), F.size(words).cast("long").alias("n"))


@query(f"{_ITEMS} SELECT doc_id, array_to_string(regexp_extract_all({norm_sql('title')}, '[\\p{{L}}\\p{{N}}]+'), ' ') AS terms FROM items")
def title_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("doc_id", F.array_join(text.title_terms(F.col("title")), " ").alias("terms"))


_EVENT_TITLE = "(['Demonstration am ', 'Konzert ', 'Ankündigung: ', 'Bericht '])[event_id % 4 + 1] || (1 + event_id % 28) || '.' || (1 + event_id % 12) || '.2024 und 3.11.' || (CASE WHEN event_id % 3 = 0 THEN '2023' ELSE '23' END)"
_EVENT_TITLES = "WITH t AS (SELECT event_id, " + _EVENT_TITLE + " AS title FROM events), w AS (SELECT *, regexp_extract_all(" + norm_sql("title") + ", '[\\p{L}\\p{N}]+') AS terms FROM t)"


def event_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up titles with dates and event words, from event numbers."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.get(F.array(*[F.lit(x) for x in ("Demonstration am ", "Konzert ", "Ankündigung: ", "Bericht ")]), F.pmod("event_id", F.lit(4)).cast("int"))
    return e.select("event_id", F.concat(kind, (F.col("event_id") % 28 + 1).cast("string"), F.lit("."), (F.col("event_id") % 12 + 1).cast("string"), F.lit(".2024 und 3.11."), F.when(F.col("event_id") % 3 == 0, "2023").otherwise("23")).alias("title"))


@query(_EVENT_TITLES + """
SELECT event_id, coalesce(array_to_string(list_sort(list_distinct(list_transform(list_filter(range(1, len(terms) - 1), lambda i: regexp_full_match(terms[i], '[0-9]{1,2}') AND regexp_full_match(terms[i + 1], '[0-9]{1,2}') AND regexp_full_match(terms[i + 2], '[0-9]{4}')),
       lambda i: lpad(terms[i], 2, '0') || '.' || lpad(terms[i + 1], 2, '0') || '.' || terms[i + 2]))), ','), '') AS dates FROM w""")
def title_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_titles(spark, sf_dir).select("event_id", F.array_join(text.title_dates(F.col("title")), ",").alias("dates"))


def _any_sql(words: list[str]) -> str:
    return f"list_has_any(terms, [{', '.join(repr(w) for w in words)}])"


@query(_EVENT_TITLES + f"SELECT event_id, CASE WHEN {_any_sql(text.ANNOUNCEMENT_WORDS)} THEN 'announcement' WHEN {_any_sql(text.PROTEST_WORDS)} THEN 'protest' WHEN {_any_sql(text.EVENT_WORDS)} THEN 'event' END AS class FROM w")
def event_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_titles(spark, sf_dir).select("event_id", text.title_event_class(F.col("title")).alias("class"))


_PARTS = _ITEMS + """, fronts AS (SELECT *, length(coalesce(TRY(decode(array_slice(encode(text), 1, 1200))), TRY(decode(array_slice(encode(text), 1, 1199))), TRY(decode(array_slice(encode(text), 1, 1198))), TRY(decode(array_slice(encode(text), 1, 1197))))) AS front FROM items),
 ends AS (SELECT *, front + length(regexp_extract(substr(text, front + 1), '^[^\\s]*')) AS stop FROM fronts),
 leads AS (SELECT doc_id, source_name, title, text, CASE WHEN octet_length(encode(text)) <= 1200 THEN text ELSE substr(text, 1, stop) END AS lead, CASE WHEN octet_length(encode(text)) <= 1200 THEN '' ELSE substr(text, stop + 1) END AS rest FROM ends)"""


@query(_PARTS + " SELECT doc_id, length(lead) AS lead_chars, length(rest) AS rest_chars, md5(lead) AS lead_md5, md5(rest) AS rest_md5 FROM leads")
def split_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead, rest = text.split_lead(F.col("text"))
    return items(spark, sf_dir).select("doc_id", lead.alias("lead"), rest.alias("rest")).select("doc_id", F.length("lead").cast("long").alias("lead_chars"), F.length("rest").cast("long").alias("rest_chars"), F.md5(F.encode("lead", "utf-8")).alias("lead_md5"), F.md5(F.encode("rest", "utf-8")).alias("rest_md5"))


def find_sql(column: str, term: str, place: bool = False) -> str:
    """A mention in DuckDB's SQL, whose patterns have no lookaround."""
    t = text.normalize_text(term)
    strict = len(t) < 5 or t[-1] in "0123456789"
    edge = "(?:$|[^\\p{L}\\p{N}" + ("-]" if place else "]") + ")"
    tail = edge if strict else ("(?:$|[^-])" if place else "")
    if place:
        tail = f"(?:{tail}|-(?:$|[^\\p{{L}}])|-(?:{'|'.join(text.SAME_PLACE_SUFFIXES)}))"
    return f"regexp_matches({column}, '(?s)(?:^|[^\\p{{L}}\\p{{N}}]){t}{tail}')"


_TEXTS = _PARTS + f", texts AS (SELECT doc_id, source_name, title, {norm_sql(chr(39) + chr(39) + ' || title || ' + repr('  ') + ' || lead')} AS prominent, {norm_sql('rest')} AS rest FROM leads)"
_TERMS = ["thble", "attion", "ering", "the", "der", "die"]


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prominent, rest = evidence.item_text(F.col("title"), F.lit(None).cast("string"), F.col("text"))
    return items(spark, sf_dir).select("doc_id", "source_name", "title", prominent.alias("prominent"), rest.alias("rest"))


@query(_TEXTS + " SELECT doc_id, " + ", ".join(f"CASE WHEN {find_sql('prominent', t, True)} THEN true WHEN {find_sql('rest', t, True)} THEN false END AS m_{t}" for t in _TERMS) + " FROM texts")
def term_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", *[text.mention(F.col("prominent"), F.col("rest"), t, True).alias(f"m_{t}") for t in _TERMS])


def _some_sql(terms: list[str]) -> str:
    return "(" + " OR ".join(f"{find_sql(c, t)}" for t in terms for c in ("prominent", "rest")) + ")"


@query(_TEXTS + f" SELECT doc_id, NOT {_some_sql(CONFIG.blocklist)} AND {_some_sql(CONFIG.required)} AS passes FROM texts")
def required_blocklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", routing.keyword_pass(F.col("prominent"), F.col("rest"), CONFIG).alias("passes"))


def _area_sql() -> str:
    parts = []
    for g, group in enumerate(CONFIG.area):
        arms = [f"WHEN {find_sql('prominent', t, True)} THEN '\"{t}\" ({int(group.implied_meters)}m)'" for t in group.terms] + [f"WHEN {find_sql('rest', t, True)} THEN '\"{t}\" ({int(group.implied_meters)}m, body only)'" for t in group.terms]
        parts.append(f"SELECT doc_id, {group.implied_meters}::DOUBLE AS meters, CASE {' '.join(arms)} END AS label, 1 AS kind, {g} AS pos FROM texts")
    return "areas AS (SELECT *, NOT ends_with(label, 'body only)') AS prominent FROM (" + " UNION ALL ".join(parts) + ") WHERE label IS NOT NULL)"


@query(_TEXTS + ", " + _area_sql() + " SELECT doc_id, meters, label, prominent FROM areas")
def area_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = texts(spark, sf_dir).select("doc_id", F.explode(evidence.area_evidence(F.col("prominent"), F.col("rest"), CONFIG.area)).alias("e"))
    return found.select("doc_id", "e.meters", "e.label", "e.prominent")


def _place_sql() -> str:
    parts = []
    whole = lambda c, t: f"regexp_matches({c}, '(?s)(?:^|[^\\p{{L}}\\p{{N}}]){t}(?:$|[^\\p{{L}}\\p{{N}}])')"
    for p, place in enumerate(CONFIG.places):
        names = [place.name, *place.aliases]
        up, down = (" OR ".join(whole(c, t) for t in names) for c in ("prominent", "rest"))
        meters = f"2 * 6371000.0 * asin(sqrt(pow(sin(radians({place.lat} - {REF[0]}) / 2), 2) + cos(radians({REF[0]})) * cos(radians({place.lat})) * pow(sin(radians({place.lon} - {REF[1]}) / 2), 2)))"
        parts.append(f"SELECT doc_id, {meters} AS meters, '{place.name}' AS label, 2 AS kind, {1000 + p} AS pos, ({up}) AS prominent FROM texts WHERE {up} OR {down}")
    return "named AS (" + " UNION ALL ".join(parts) + ")"


TIER_SQL = "CASE WHEN meters < 200 THEN 5 WHEN meters < 500 THEN 4 WHEN meters < 1000 THEN 3 WHEN meters < 2000 THEN 2 WHEN meters < 10000 THEN 1 ELSE 0 END"
_BEST = _TEXTS + ", " + _area_sql() + ", " + _place_sql() + f""",
 every AS (SELECT doc_id, meters, label, kind, pos, prominent FROM areas UNION ALL SELECT doc_id, meters, label, kind, pos, prominent FROM named),
 away AS (SELECT doc_id, ({' OR '.join(find_sql(norm_sql('title'), t, True) for t in CONFIG.elsewhere)}) AND NOT ({' OR '.join(find_sql(norm_sql('title'), t, True) for t in [x for g in CONFIG.area for x in g.terms] + [x for p in CONFIG.places for x in [p.name, *p.aliases]])}) AS elsewhere FROM texts),
 rated AS (SELECT e.*, greatest(0, {TIER_SQL} - CASE WHEN prominent THEN 0 ELSE 1 END - CASE WHEN elsewhere THEN 1 ELSE 0 END) AS score FROM every e JOIN away USING (doc_id)),
 top AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, kind DESC, meters, pos DESC) = 1),
 best AS (SELECT t.doc_id, coalesce(score, 0)::INTEGER AS score, CASE WHEN kind IN (2, 3, 4) THEN round(meters)::BIGINT END AS distance, CASE WHEN kind > 0 THEN label END AS location_label FROM texts t LEFT JOIN top USING (doc_id))"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = texts(spark, sf_dir)
    p, r = F.col("prominent"), F.col("rest")
    found = F.concat(evidence.area_evidence(p, r, CONFIG.area), evidence.place_evidence(p, r, CONFIG.places, *REF))
    away = evidence.located_elsewhere(F.col("title"), F.lit(None).cast("string"), CONFIG).isNotNull()
    return rows.withColumn("top", evidence.best(evidence.penalise(found, away))).select("doc_id", "source_name", "prominent", "rest", *evidence.final_columns(F.col("top")))


@query(_BEST + " SELECT doc_id, score, distance, location_label FROM best")
def best_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("doc_id", "score", F.round("distance_meters").cast("long").alias("distance"), "location_label")


@query(_BEST + f""", facts AS (SELECT b.*, {NOW} - doc_id * 60 * 7 AS published_at, doc_id % 11 <> 0 AS is_filtered, doc_id % 13 = 0 AS fetch_failed, doc_id % 26 = 0 AS final,
   NOT {_some_sql(CONFIG.blocklist)} AND {_some_sql(CONFIG.required)} AS keyword_ok FROM best b JOIN texts USING (doc_id)),
 routed AS (SELECT *, floor(({NOW} - published_at) / 3600.0)::BIGINT AS age FROM facts)
 SELECT doc_id, score, location_label,
   CASE WHEN age > 96 THEN 'dropped' WHEN is_filtered AND NOT keyword_ok AND fetch_failed AND NOT final THEN 'retry' WHEN is_filtered AND NOT keyword_ok THEN 'dropped'
        WHEN is_filtered AND score < 3 AND fetch_failed AND NOT final THEN 'retry' WHEN is_filtered AND score < 3 AND score >= 2 THEN 'candidate' WHEN is_filtered AND score < 3 THEN 'dropped' ELSE 'queued' END AS outcome,
   CASE WHEN age > 96 THEN 'published ' || age || 'h ago, older than 96h' WHEN is_filtered AND NOT keyword_ok AND fetch_failed AND NOT final THEN 'article fetch failed' WHEN is_filtered AND NOT keyword_ok THEN 'keywords do not match'
        WHEN is_filtered AND score < 3 AND fetch_failed AND NOT final THEN 'article fetch failed' WHEN is_filtered AND score < 3 AND score >= 2 THEN 'below digest threshold' WHEN is_filtered AND score < 3 THEN 'score too low' ELSE '' END AS reason
 FROM routed""")
def route_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: documents to evidence, score and outcome."""
    return routed(spark, sf_dir).select("doc_id", "score", "location_label", "outcome", "reason")


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    facts = scored(spark, sf_dir).withColumns({
        "published_at": F.lit(NOW) - n * 420, "max_age_hours": F.lit(96).cast("bigint"), "filter": n % 11 != 0, "fetch_failed": n % 13 == 0, "final": n % 26 == 0,
        "geo_failed": F.lit(False), "geocoded": F.lit(False), "keyword_ok": routing.keyword_pass(F.col("prominent"), F.col("rest"), CONFIG),
    })
    return routing.outcome(facts, CONFIG, F.lit(NOW))


@query("SELECT p_partkey, replace(url_encode(p_name), '%20', '+') AS encoded FROM part")
def url_encode_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", text.url_encode(F.col("p_name")).alias("encoded"))




@query(f"""{_ITEMS}, s AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS body FROM items),
 f AS (SELECT doc_id, body, list_filter(list_transform(regexp_extract_all(body, '[^.!?]*[.!?][)\\]}}"''”“’‘]*'), lambda x: trim(x)), lambda x: x <> '') AS found FROM s),
 d AS (SELECT doc_id, body, list_filter(found, lambda x, i: list_position(found, x) = i) AS found FROM f)
 SELECT doc_id, CASE WHEN body = '' THEN NULL WHEN len(found) = 0 THEN body ELSE array_to_string(list_slice(found, 1, 2), ' ') END AS summary FROM d""")
def concise_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("doc_id", text.concise_sentences(F.col("text"), 2).alias("summary"))


_POINTS = "WITH p AS (SELECT s_suppkey AS id, 52.4 + (s_suppkey % 1000) / 5000.0 AS lat, 13.3 + (s_suppkey * 7 % 1000) / 3000.0 AS lon FROM supplier)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_suppkey")
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(n.alias("id"), (F.lit(52.4) + (n % 1000) / F.lit(5000.0)).alias("lat"), (F.lit(13.3) + (n * 7 % 1000) / F.lit(3000.0)).alias("lon"))


@query(_POINTS + f", m AS (SELECT id, 2 * 6371000.0 * asin(sqrt(pow(sin(radians(lat - {REF[0]}) / 2), 2) + cos(radians({REF[0]})) * cos(radians(lat)) * pow(sin(radians(lon - {REF[1]}) / 2), 2))) AS meters FROM p) SELECT id, round(meters)::BIGINT AS meters, {TIER_SQL} AS score FROM m")
def haversine_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = geo.haversine(F.lit(REF[0]), F.lit(REF[1]), F.col("lat"), F.col("lon"))
    return points(spark, sf_dir).select("id", m.alias("m")).select("id", F.round("m").cast("long").alias("meters"), geo.distance_score(F.col("m")).alias("score"))


_SQUARE = '{"type":"Polygon","coordinates":[[[13.35,52.42],[13.6,52.44],[13.55,52.58],[13.38,52.56],[13.35,52.42]],[[13.42,52.48],[13.5,52.48],[13.5,52.53],[13.42,52.53]]]}'


def _ring_sql(ring: list[list[float]]) -> str:
    terms = []
    for i in range(len(ring)):
        (ax, ay), (bx, by) = ring[i], ring[i - 1]
        if ay != by:
            terms.append(f"CASE WHEN ({ay} > lat) <> ({by} > lat) AND lon < ({bx} - {ax}) * (lat - {ay}) / ({by} - {ay}) + {ax} THEN 1 ELSE 0 END")
    return f"(({' + '.join(terms)}) % 2 = 1)"


@query(_POINTS + f" SELECT id, {_ring_sql([[13.35, 52.42], [13.6, 52.44], [13.55, 52.58], [13.38, 52.56], [13.35, 52.42]])} AND NOT {_ring_sql([[13.42, 52.48], [13.5, 52.48], [13.5, 52.53], [13.42, 52.53]])} AS inside FROM p")
def polygon_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("id", geo.geometry_contains(F.lit(_SQUARE), F.col("lat"), F.col("lon")).alias("inside"))


@query(_POINTS + """, s AS (SELECT id, cos(radians(lat)) * 111320.0 AS k, lat, lon FROM p), v AS (SELECT id, (13.4 - lon) * k AS ax, (52.5 - lat) * 111320.0 AS ay, (13.5 - 13.4) * k AS dx, (52.53 - 52.5) * 111320.0 AS dy FROM s),
 t AS (SELECT *, greatest(0.0, least(1.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) AS t FROM v) SELECT id, round(sqrt(pow(ax + t * dx, 2) + pow(ay + t * dy, 2)))::BIGINT AS meters FROM t""")
def segment_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = geo.segment_distance(F.col("lat"), F.col("lon"), F.lit(52.5), F.lit(13.4), F.lit(52.53), F.lit(13.5))
    return points(spark, sf_dir).select("id", F.round(m).cast("long").alias("meters"))
