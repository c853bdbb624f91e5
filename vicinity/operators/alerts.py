"""Warnings: reading feeds, families and labels, ranking within a group, life cycle by snapshots.

A warning row has ``bucket``, ``cell_id``, ``region``, ``event``, ``headline``, ``level``, ``start_ms``,
``end_ms``, ``description`` and ``instruction``; times are milliseconds since the epoch.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vicinity.functions import dates, geo, text

# Feeds, families, labels, windows.
WARNINGS, ADVANCE = "warnings", "vorabInformation"
NO_END = 2**63 - 1
QUAKE_HOURS = 48
FAMILIES = [
    ("HITZE", ["HITZE"]), ("GEWITTER", ["GEWITTER"]), ("WIND", ["WIND", "STURM", "ORKAN", "BÖEN", "BOEEN"]), ("REGEN", ["REGEN", "NIEDERSCHLAG"]),
    ("SCHNEE_GLAETTE", ["SCHNEE", "GLÄTTE", "GLAETTE", "GLATTEIS", "EISREGEN"]), ("FROST", ["FROST"]), ("NEBEL", ["NEBEL"]), ("TAUWETTER", ["TAUWETTER"]), ("UV", ["UV"]), ("FIRE_RISK", ["WALDBRAND", "GRASLAND", "FEUERINDEX"]),
]
LEVEL_EMOJI = {1: "🟡", 2: "⚠️", 3: "🟠", 50: "🟠"}
OTHER_EMOJI = "🔴"
LEVEL_LABELS = {1: "Vorinformation", 2: "Warnung", 3: "Starke Warnung", 4: "Unwetterwarnung", 5: "Extreme Unwetterwarnung", 50: "Starke Hitzewarnung", 51: "Extreme Hitzewarnung"}
OTHER_LABEL = "Extremwarnung"
THUNDER_LABELS = {3: "Starke Gewitterwarnung", 4: "Unwetterwarnung Gewitter", 5: "Extreme Gewitterwarnung"}
RAIN_LABELS = {3: "Starkregenwarnung", 4: "Unwetterwarnung Starkregen", 5: "Extreme Starkregenwarnung"}
GEOMETRY_LAYERS = ["Warngebiete_Kreise", "Warngebiete_Gemeinden", "Warngebiete_Bundeslaender", "Warngebiete_Binnenseen", "Warngebiete_Kueste"]
BUILT_IN_REGION_CODES = {"berlin": "110000000000"}
WARNING = "regionName string, event string, headline string, level bigint, start bigint, end bigint, description string, instruction string"


def _map(value: Column, table: dict, other: str | Column) -> Column:
    out = other if isinstance(other, Column) else F.lit(other)
    return reduce(lambda o, kv: F.when(value == kv[0], F.lit(kv[1])).otherwise(o), reversed(list(table.items())), out)


def unwrap_jsonp(body: Column) -> Column:
    """The JSON inside a call, or the body as it is."""
    return F.regexp_replace(F.trim(body), r"(?s)^warnWetter\.loadWarnings\((.*)\);?\s*$", "$1")


def explode_warnings(feeds: DataFrame, body: str = "body") -> DataFrame:
    """Warning rows of feed bodies; buckets, cells and warnings of another shape are passed over."""
    json = unwrap_jsonp(F.col(body))
    kind = f"map<string,array<struct<{', '.join(x.replace(' ', ':', 1) for x in WARNING.split(', '))}>>>"
    buckets = F.array(*[F.struct(F.lit(b).alias("bucket"), F.from_json(F.get_json_object(json, f"$.{b}"), kind).alias("cells")) for b in (WARNINGS, ADVANCE)])
    cells = feeds.select(F.explode(buckets).alias("b")).select("b.bucket", F.explode("b.cells").alias("cell_id", "list"))
    rows = cells.select("bucket", "cell_id", F.explode("list").alias("w"))
    event = F.coalesce("w.event", "w.headline", F.lit("Wetterwarnung"))
    return rows.select(
        "bucket", "cell_id", F.coalesce("w.regionName", F.lit("")).alias("region"), event.alias("event"), F.coalesce("w.headline", event).alias("headline"), F.coalesce("w.level", F.lit(0)).alias("level"),
        F.coalesce("w.start", F.lit(0)).alias("start_ms"), F.coalesce("w.end", F.lit(NO_END)).alias("end_ms"), F.col("w.end").alias("given_end"), "w.description", "w.instruction",
    )


def region_matches(region: Column, keywords: list[str]) -> Column:
    return text.contains_any(F.lower(region), [k.strip().lower() for k in keywords if k.strip()])


def relevant_now(bucket: Column, start_ms: Column, end_ms: Column, now_ms: int, lead_ms: int) -> Column:
    """Not over, and announced in advance or starting within the lead."""
    return (end_ms >= now_ms) & ((bucket == ADVANCE) | (start_ms <= min(now_ms + lead_ms, NO_END)))


def event_family(event: Column) -> Column:
    """The family of an event's name; another name stands for itself."""
    upper = F.upper(text.squeeze_ends(event))
    return reduce(lambda o, f: F.when(text.contains_any(upper, f[1]), F.lit(f[0])).otherwise(o), reversed(FAMILIES), upper)


def stable_key(bucket: Column, region: Column, event: Column, level: Column) -> Column:
    """A key that the refreshed times of a warning do not change."""
    return F.concat_ws(":", F.lit("dwd"), bucket, region, event_family(event), level.cast("string"))


def parse_stable_key(key: Column) -> Column:
    """struct(bucket, region, event, level), null for anything else."""
    part = lambda i: F.regexp_extract(key, r"(?s)^dwd:([^:]*):([^:]*):([^:]*):([+-]?\d+)$", i)
    level = part(4).try_cast("bigint")
    return F.when(level.isNotNull(), F.struct(part(1).alias("bucket"), part(2).alias("region"), part(3).alias("event"), level.alias("level")))


def with_geometry(rows: DataFrame, geometry: DataFrame, lat: float, lon: float) -> DataFrame:
    """Warnings whose cell holds the point.  ``geometry``: (cell_id, layer, geojson); the first layer in
    order counts; cells without one are taken as near."""
    rank = F.array_position(F.array(*[F.lit(x) for x in GEOMETRY_LAYERS]), F.col("layer"))
    cells = geometry.where(F.col("geojson").isNotNull()).groupBy("cell_id").agg(F.min_by("geojson", rank).alias("geojson"))
    cells = cells.select("cell_id", geo.geometry_contains(F.col("geojson"), F.lit(lat), F.lit(lon)).alias("inside"))
    return rows.join(cells, "cell_id", "left").where(F.coalesce("inside", F.lit(True))).drop("inside")


def ranked(rows: DataFrame, now_ms: int) -> DataFrame:
    """``rows`` with ``family``, ``key`` and ``place``: 1 is the primary of its region and family: active
    warnings first, then active ones, then level, then the earlier start (then the key)."""
    active = (F.col("start_ms") <= now_ms) & (F.col("end_ms") >= now_ms)
    order = [F.desc(active & (F.col("bucket") == WARNINGS)), F.desc(active), F.desc("level"), F.asc("start_ms"), F.asc("key"), F.asc("end_ms")]
    keyed = rows.withColumns({"family": event_family(F.col("event")), "key": stable_key(F.col("bucket"), F.col("region"), F.col("event"), F.col("level"))})
    return keyed.withColumn("place", F.row_number().over(W.partitionBy("region", "family").orderBy(*order)))


def active_levels(rows: DataFrame) -> DataFrame:
    return rows.groupBy("region", event_family(F.col("event")).alias("family")).agg(F.max("level").alias("level"))


def follow_up(primary_start: Column, primary_end: Column, start: Column, end: Column) -> Column:
    """Whether a secondary warning says more than the primary: it outlasts it, or starts after it and is
    not over before it begins.  Missing ends count as 0 here."""
    p, q = F.coalesce(primary_end, F.lit(0)), F.coalesce(end, F.lit(0))
    overlaps = start < p
    return F.when(overlaps, q > p).otherwise(q > primary_start)


def secondary_notes(groups: DataFrame, now: Column, zone: str = "UTC") -> DataFrame:
    """(region, family, notes): what follows the primary, by start, then level."""
    first = groups.where("place = 1").select("region", "family", F.col("start_ms").alias("p_start"), F.col("end_ms").alias("p_end"))
    rest = groups.where("place > 1").join(first, ["region", "family"]).where(follow_up(F.col("p_start"), F.col("p_end"), F.col("start_ms"), F.col("end_ms")))
    label = secondary_label(F.col("bucket"), F.col("event"), F.col("level"))
    note = F.concat(F.lit("(danach: "), level_emoji(F.col("level")), F.lit(" "), label, F.when(F.col("end_ms") < NO_END, F.concat(F.lit(" bis "), dates.end_label(F.col("end_ms"), now, zone))).otherwise(F.lit("")), F.lit(")"))
    got = rest.groupBy("region", "family").agg(F.array_sort(F.collect_list(F.struct("start_ms", (-F.col("level")).alias("level"), note.alias("note")))).alias("n"))
    return got.select("region", "family", F.transform("n", lambda x: x["note"]).alias("notes"))


def level_emoji(level: Column) -> Column:
    return _map(level, LEVEL_EMOJI, OTHER_EMOJI)


def level_label(level: Column) -> Column:
    return _map(level, LEVEL_LABELS, OTHER_LABEL)


def label_for_warning(bucket: Column, level: Column) -> Column:
    return F.when(bucket == ADVANCE, F.when(level.isin(4, 5), "Vorabinformation Unwetter").otherwise("Vorabinformation")).otherwise(level_label(level))


def secondary_label(bucket: Column, event: Column, level: Column) -> Column:
    own, family = label_for_warning(bucket, level), event_family(event)
    return F.when(family == "GEWITTER", _map(level, THUNDER_LABELS, own)).when(family == "REGEN", _map(level, RAIN_LABELS, own)).otherwise(own)


def snapshot_diff(current: DataFrame, active: DataFrame) -> DataFrame:
    """(key, old_key, action) for each group and for what has ended.

    ``current``: primaries of :func:`ranked` plus all keys that are in the feed (``place`` over 1);
    ``active``: id, region, event, level, start_ms, end_ms.  Actions: noop, update (another window),
    up, down or replace (another key of the group was active), new, all_clear.
    """
    held = active.select(F.col("id").alias("old_key"), F.col("region").alias("r"), event_family(F.col("event")).alias("f"), F.col("level").alias("old_level"), F.col("start_ms").alias("old_start"), F.col("end_ms").alias("old_end"))
    first = current.where("place = 1").select("key", "region", "family", "level", "start_ms", "end_ms")
    same = first.join(held.drop("r", "f"), first["key"] == held["old_key"], "left")
    known = same.where("old_key is not null").select("key", "old_key", F.when((F.col("start_ms") == F.col("old_start")) & (F.col("end_ms") == F.col("old_end")), "noop").otherwise("update").alias("action"))
    unknown = same.where("old_key is null").select("key", "region", "family", "level")
    former = held.groupBy("r", "f").agg(F.min(F.struct("old_key", "old_level")).alias("old"))  # the first by key, where several were active
    moved = unknown.join(former, (F.col("region") == F.col("r")) & (F.col("family") == F.col("f")), "left")
    step = F.when(F.col("old").isNull(), "new").when(F.col("level") > F.col("old.old_level"), "up").when(F.col("level") < F.col("old.old_level"), "down").otherwise("replace")
    begun = moved.select("key", F.col("old.old_key").alias("old_key"), step.alias("action"))
    groups = current.select(F.col("region").alias("r"), F.col("family").alias("f")).distinct()
    ended = held.join(current.select(F.col("key").alias("old_key")).distinct(), "old_key", "left_anti").join(groups, ["r", "f"], "left_anti")
    return known.unionByName(begun).unionByName(ended.select(F.lit(None).cast("string").alias("key"), "old_key", F.lit("all_clear").alias("action")))


def next_active(current: DataFrame, active: DataFrame, diff: DataFrame) -> DataFrame:
    """The next snapshot of active warnings: ended and replaced ones go, primaries come with their
    window of now, whether or not their message could be edited."""
    gone = diff.where("old_key is not null and action <> 'noop'").select(F.col("old_key").alias("id"))
    fresh = current.where("place = 1").join(diff.where("action in ('new', 'update', 'up', 'down', 'replace')").select("key"), "key")
    return active.join(gone.distinct(), "id", "left_anti").unionByName(fresh.select(F.col("key").alias("id"), "region", "event", "level", "start_ms", "end_ms"))


RECONCILE_MS = 3_600_000


def reconcile_due(last_ms: Column, now_ms: Column) -> Column:
    """Whether messages of unchanged warnings are to be compared again: never done, or an hour ago."""
    return last_ms.isNull() | (now_ms - last_ms >= RECONCILE_MS)


def reconciled(diff: DataFrame, active: DataFrame, due: Column) -> DataFrame:
    """``diff`` with ``reconcile`` in place of ``noop`` where it is due and the warning has a message
    (``active``: id, event_ids): its text is written again, and a lost message is found out."""
    held = active.where(F.col("event_ids").isNotNull()).select(F.col("id").alias("old_key"), F.lit(True).alias("_held"))
    step = F.when((F.col("action") == "noop") & F.coalesce("_held", F.lit(False)) & due, "reconcile").otherwise(F.col("action"))
    return diff.join(held, "old_key", "left").select("key", "old_key", step.alias("action"))


def after_edit(action: Column, result: Column) -> Column:
    """What follows an attempt (ok, missing_original or failed): store, repost (the message is gone), end
    (an all-clear, also where its message is gone), or retry in the next round."""
    ended = action == "all_clear"
    return F.when(result == "failed", "retry").when(ended, "end").when((result == "missing_original") & ~action.isin("new", "post"), "repost").when(result == "ok", "store").otherwise("retry")


# -- civil warnings --------------------------------------------------------------------------------


def is_weather_id(id_: Column) -> Column:
    """Weather warnings come by their own feed."""
    return id_.startswith("dwd.") | id_.contains(".DWD.")


def civil_active_key(id_: Column) -> Column:
    return F.regexp_replace(id_, "-[0-9]{3}$", "")


def civil_alert_key(id_: Column, data: Column) -> Column:
    field = lambda n: F.coalesce(F.get_json_object(data, f"$.{n}"), F.lit(""))
    return F.concat_ws(":", F.lit("nina"), id_, *[field(n) for n in ("sent", "effective", "expires", "severity")])


def civil_region(data: Column) -> Column:
    return F.coalesce(F.get_json_object(data, "$.area[0].areaDesc"), F.lit("Region unbekannt"))


def civil_diff(current: DataFrame, active: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(id, action): ``current`` has id, key and msg_type, ``active`` has id and key, ``seen`` the keys (id)
    that are handled.  A cancelled warning with a message: all_clear; without one: forget; another version
    of a posted one: edit; without a message: post; else noop.  A warning that leaves the feed without a
    cancellation keeps its message."""
    new = current.select("id", F.col("key").alias("new"), "msg_type")
    if seen is not None:
        new = new.join(seen.select(F.col("id").alias("new")), "new", "left_anti")
    both = new.join(active.select("id", F.col("key").alias("old")), "id", "left")
    cancelled = F.coalesce(F.col("msg_type") == "Cancel", F.lit(False))
    step = F.when(cancelled, F.when(F.col("old").isNull(), "forget").otherwise("all_clear")).when(F.col("old").isNull(), "post").when(F.col("old") != F.col("new"), "edit").otherwise("noop")
    return both.select("id", step.alias("action"))


def civil_description(data: Column, zone: str = "UTC") -> Column:
    field = lambda n: F.get_json_object(data, f"$.{n}")
    line = lambda mark, c: F.concat(F.lit(mark + " "), c)
    return F.concat_ws("\n", line("📍", field("area[0].areaDesc")), line("🕒", dates.validity_open(field("effective"), field("expires"), zone)), line("ℹ️", text.concise_sentences(F.coalesce(field("description"), F.lit("")), 2)), line("💡", text.concise_sentences(F.coalesce(field("instruction"), F.lit("")), 2)))


# -- quakes and disasters --------------------------------------------------------------------------


def quakes(features: DataFrame, now_ms: int, lat: float | None, lon: float | None, max_km: float | None) -> DataFrame:
    """Features (id, time, lat, lon, …) that are recent and near enough; unknown times pass, unknown
    places do not where a distance is asked for."""
    ok = F.col("id").isNotNull() & (F.col("time").isNull() | (F.col("time") >= now_ms - QUAKE_HOURS * 3_600_000))
    return features.where(ok & _near(lat, lon, max_km))


def disasters(entries: DataFrame, now: int, lat: float | None, lon: float | None, max_km: float | None) -> DataFrame:
    """Entries (title, published_at, lat, lon, …) above green that are recent and near enough."""
    ok = ~F.lower("title").startswith("green") & (F.col("published_at").isNull() | (F.col("published_at") >= now - QUAKE_HOURS * 3600))
    return entries.where(ok & _near(lat, lon, max_km))


def _near(lat: float | None, lon: float | None, max_km: float | None) -> Column:
    if lat is None or lon is None or max_km is None:
        return F.lit(True)
    return F.coalesce(geo.haversine_km(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")) <= max_km, F.lit(False))


def quake_description(place: Column, time_ms: Column, magnitude: Column, alert: Column, zone: str = "UTC") -> Column:
    size = F.concat(F.lit("Magnitude "), F.bround(magnitude, 1).cast("decimal(6,1)").cast("string"))
    detail = F.concat_ws(" · ", size, F.when(F.trim(alert) != "", F.concat(F.lit("USGS alert: "), alert)))
    when = F.date_format(F.from_utc_timestamp(F.timestamp_millis(time_ms), zone), dates.FULL)
    return F.concat_ws("\n", F.when(F.trim(place) != "", F.concat(F.lit("📍 "), place)), F.concat(F.lit("🕒 "), when), F.when(detail != "", F.concat(F.lit("ℹ️ "), detail)))


def disaster_description(lat: Column, lon: Column, published_at: Column, description: Column, zone: str = "UTC") -> Column:
    two = lambda c: F.bround(c, 2).cast("decimal(9,2)").cast("string")
    when = F.date_format(F.from_utc_timestamp(F.timestamp_seconds(published_at), zone), dates.FULL)
    return F.concat_ws("\n", F.concat(F.lit("📍 "), two(lat), F.lit(", "), two(lon)), F.concat(F.lit("🕒 "), when), F.concat(F.lit("ℹ️ "), text.concise_sentences(F.coalesce(description, F.lit("")), 2)))


# -- messages --------------------------------------------------------------------------------------


def warning_description(region: Column, bucket: Column, level: Column, start_ms: Column, end_ms: Column, description: Column, instruction: Column, notes: Column, zone: str = "UTC") -> Column:
    line = lambda mark, c: F.concat(F.lit(mark + " "), c)
    head = F.concat(level_emoji(level), F.lit(" "), label_for_warning(bucket, level))
    valid = dates.validity(start_ms, F.when(end_ms < NO_END, end_ms), zone)
    said = [text.concise_sentences(F.coalesce(c, F.lit("")), n) for c, n in ((description, 2), (instruction, 1))]
    return F.concat_ws("\n", head, line("📍", region), line("🕒", valid), line("ℹ️", said[0]), line("💡", said[1]), F.nullif(F.array_join(F.coalesce(notes, F.array().cast("array<string>")), "\n"), F.lit("")))


def alert_message(source: Column, event: Column, description: Column, link: Column) -> tuple[Column, Column]:
    """(plain, html)."""
    esc = text.html_escape
    plain = F.concat(F.lit("🚨 "), event, F.lit("\n"), description, F.coalesce(F.concat(F.lit("\n🔗 "), link), F.lit("")), F.lit("\n📰 Source: "), source)
    anchor = F.coalesce(F.concat(F.lit('<br>🔗 <a href="'), esc(link), F.lit('">'), esc(link), F.lit("</a>")), F.lit(""))
    return plain, F.concat(F.lit("<b>🚨 "), esc(event), F.lit("</b><br>"), F.replace(esc(description), F.lit("\n"), F.lit("<br>")), anchor, F.lit("<br><em>📰 Source: "), esc(source), F.lit("</em>"))


def all_clear_suffix(plain: Column, html: Column, time: Column) -> tuple[Column, Column]:
    note = F.concat(F.lit("✅ Entwarnung ("), time, F.lit("): Diese Warnung gilt nicht mehr."))
    return F.concat(plain, F.lit("\n\n---\n"), note), F.concat(html, F.lit("<hr><em>"), note, F.lit("</em>"))


def all_clear_message(headline: Column, region: Column) -> tuple[Column, Column]:
    """A message of its own, where the warning's is not known."""
    esc, source = text.html_escape, "📰 Source: DWD Weather Warnings"
    body = F.concat(F.lit("📍 "), region, F.lit("\nDie Warnung ist nicht mehr aktiv."))
    return F.concat(F.lit("✅ Entwarnung: "), headline, F.lit("\n"), body, F.lit("\n" + source)), F.concat(F.lit("<b>✅ Entwarnung: "), esc(headline), F.lit("</b><br>"), F.replace(esc(body), F.lit("\n"), F.lit("<br>")), F.lit(f"<br><em>{source}</em>"))


def level_change_suffix(plain: Column, html: Column, old: Column, new: Column, event: Column, time: Column) -> tuple[Column, Column]:
    up = new > old
    note = F.when(F.trim(event) != "", F.concat(F.lit("; jetzt: "), F.trim(event))).otherwise(F.lit(""))

    def line(e: Column) -> Column:
        return F.concat(F.when(up, "⬆️").otherwise("⬇️"), F.lit(" Warnung aktualisiert: Warnstufe "), F.when(up, "erhöht").otherwise("reduziert"), F.lit(" auf "), level_emoji(new), F.lit(" "), level_label(new), e, F.lit(" ("), time, F.lit(")."))

    return F.concat(plain, F.lit("\n\n---\n"), line(note)), F.concat(html, F.lit("<br><br><hr><em>"), line(text.html_escape(note)), F.lit("</em>"))


def post_key(stable: Column, end_ms: Column, replaces: Column) -> Column:
    return F.concat(stable, F.lit("|end="), end_ms.cast("string"), F.coalesce(F.concat(F.lit("|replaces="), replaces), F.lit("")))


def transaction_id(alert_key: Column, room: Column, prefix: str = "vicinity-alert-") -> Column:
    """The same for each attempt to post an alert in a room."""
    return F.concat(F.lit(prefix), text.fnv1a_64(F.concat(alert_key, F.lit("|"), room)))
