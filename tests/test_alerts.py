import json

import pytest
from pyspark.sql import functions as F

from vicinity.operators import alerts, forecast
from vicinity.sources import hazards, outbox

HOUR = 3_600_000


@pytest.mark.parametrize(("name", "family"), [("STURMBÖEN", "WIND"), ("Schwere Sturmböen", "WIND"), ("ORKANBÖEN", "WIND"), ("STARKREGEN", "REGEN"), ("DAUERREGEN", "REGEN"), ("SCHNEEFALL", "SCHNEE_GLAETTE"), ("GLATTEIS", "SCHNEE_GLAETTE"), ("FROST", "FROST"), ("NEBEL", "NEBEL"), ("TAUWETTER", "TAUWETTER"), ("UV-STRAHLUNG", "UV"), ("WALDBRANDGEFAHR", "FIRE_RISK"), (" Neue Art ", "NEUE ART")])
def test_families(value, name, family):
    assert value(alerts.event_family(F.lit(name))) == family


def test_relevance(value):
    now, lead = 100 * HOUR, 3 * HOUR
    r = lambda b, s, e: value(alerts.relevant_now(F.lit(b), F.lit(now + s * HOUR), F.lit(now + e * HOUR), now, lead))
    assert [r(alerts.ADVANCE, 20, 30), r(alerts.WARNINGS, 2, 5), r(alerts.WARNINGS, 4, 6), r(alerts.ADVANCE, -5, -1)] == [True, True, False, False]


@pytest.mark.parametrize(("start", "end", "shown"), [(-2, 0, False), (2, 30, True), (8, 30, True), (-1, 8, False), (-1, 9, True)])
def test_secondary_intervals(value, start, end, shown):
    assert value(alerts.follow_up(F.lit(0), F.lit(8 * HOUR), F.lit(start * HOUR), F.lit(end * HOUR))) is shown


ROW = "bucket string, region string, event string, level bigint, start_ms bigint, end_ms bigint"


def test_ranking_and_notes(spark):
    now = 1_782_036_000_000
    rows = spark.createDataFrame([("warnings", "R", "SCHWERES GEWITTER mit STARKREGEN", 4, now - HOUR, now + HOUR), ("warnings", "R", "STARKES GEWITTER", 3, now - HOUR, now + 2 * HOUR), ("vorabInformation", "R", "GEWITTER", 5, now + 3 * HOUR, now + 9 * HOUR), ("warnings", "R", "FROST", 1, now, now + HOUR)], ROW)
    got = alerts.ranked(rows, now)
    assert {(r["family"], r["level"]) for r in got.where("place = 1").collect()} == {("GEWITTER", 4), ("FROST", 1)}
    notes = alerts.secondary_notes(got, F.timestamp_millis(F.lit(now))).collect()
    assert len(notes) == 1 and notes[0]["notes"][0].startswith("(danach: 🟠 Starke Gewitterwarnung bis ") and len(notes[0]["notes"]) == 2
    assert {r["family"]: r["level"] for r in alerts.active_levels(rows).collect()} == {"GEWITTER": 5, "FROST": 1}


def test_life_cycle(spark):
    now = 10 * HOUR
    first = alerts.ranked(spark.createDataFrame([("warnings", "R", "FROST", 2, 0, 20 * HOUR), ("warnings", "S", "NEBEL", 1, 0, 20 * HOUR), ("warnings", "T", "UV", 1, 0, 20 * HOUR)], ROW), now)
    active = spark.createDataFrame([], "id string, region string, event string, level bigint, start_ms bigint, end_ms bigint")
    d = alerts.snapshot_diff(first, active)
    assert {r["action"] for r in d.collect()} == {"new"}
    held = alerts.next_active(first, active, d)
    then = alerts.ranked(spark.createDataFrame([("warnings", "R", "FROST", 3, 0, 20 * HOUR), ("warnings", "S", "NEBEL", 1, 0, 30 * HOUR)], ROW), now)
    d = alerts.snapshot_diff(then, held)
    assert {(r["key"], r["old_key"], r["action"]) for r in d.collect()} == {("dwd:warnings:R:FROST:3", "dwd:warnings:R:FROST:2", "up"), ("dwd:warnings:S:NEBEL:1",) * 2 + ("update",), (None, "dwd:warnings:T:UV:1", "all_clear")}
    assert {r["id"] for r in alerts.next_active(then, held, d).collect()} == {"dwd:warnings:R:FROST:3", "dwd:warnings:S:NEBEL:1"}
    assert {r["action"] for r in alerts.snapshot_diff(then, alerts.next_active(then, held, d)).collect()} == {"noop"}


def test_keys(value):
    assert tuple(value(alerts.parse_stable_key(F.lit("dwd:warnings:Kreis X:FROST:2")))) == ("warnings", "Kreis X", "FROST", 2)
    assert value(alerts.parse_stable_key(F.lit("dwd:a:b:c:d"))) is None and value(alerts.parse_stable_key(F.lit("x"))) is None
    assert value(alerts.post_key(F.lit("k"), F.lit(5), F.lit(None).cast("string"))) == "k|end=5" and value(alerts.post_key(F.lit("k"), F.lit(5), F.lit("{}"))) == "k|end=5|replaces={}"
    assert value(alerts.civil_active_key(F.lit("mow.DE-BE-001"))) == "mow.DE-BE" and value(alerts.civil_active_key(F.lit("mow-1"))) == "mow-1"


def test_feed_bodies(spark):
    body = "warnWetter.loadWarnings(" + json.dumps({"warnings": {"1": [{"regionName": "Kreis X", "event": "FROST", "level": 2, "start": 1, "end": None}], "2": "x"}, "vorabInformation": {"3": [{"headline": "H"}]}, "other": 1}) + ");"
    rows = {r["cell_id"]: r for r in alerts.explode_warnings(spark.createDataFrame([(body,), ("kaputt",)], "body string")).collect()}
    assert rows["3"]["event"] == "H" and rows["3"]["bucket"] == alerts.ADVANCE and rows["3"]["level"] == 0
    geometry = spark.createDataFrame([("3", "Warngebiete_Gemeinden", '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,1]]]}'), ("3", "Warngebiete_Kreise", '{"type":"Polygon","coordinates":[[[5,5],[6,5],[6,6]]]}')], "cell_id string, layer string, geojson string")
    cells = spark.createDataFrame([("3",), ("9",)], "cell_id string")
    assert [r["cell_id"] for r in alerts.with_geometry(cells, geometry, 0.5, 0.5).collect()] == ["9"]
    assert alerts.with_geometry(cells, geometry, 5.2, 5.9).count() == 2


def test_civil_warnings(spark, value):
    data = json.dumps({"id": "mow.X-001", "sent": "2024-01-15T08:00:00Z", "effective": "2024-01-15T08:00:00Z", "severity": "Minor", "area": [{"areaDesc": "Stadt"}], "description": "Eins. Zwei. Drei.", "instruction": "Fenster zu."})
    assert value(alerts.civil_alert_key(F.lit("i"), F.lit(data))) == "nina:i:2024-01-15T08:00:00Z:2024-01-15T08:00:00Z::Minor"
    assert value(alerts.civil_description(F.lit(data))) == "📍 Stadt\n🕒 from Mon, 15 Jan 08:00\nℹ️ Eins. Zwei.\n💡 Fenster zu."
    assert value(alerts.civil_region(F.lit("{}"))) == "Region unbekannt"
    page = json.dumps([json.loads(data), {"id": "dwd.1"}, {"id": "2.DWD.3"}])
    assert [r["id"] for r in hazards.civil_dashboard(spark.createDataFrame([(page,), ("{}",)], "body string")).collect()] == ["mow.X-001"]
    now = spark.createDataFrame([("a", "k2", "Update"), ("b", "k", "Cancel"), ("c", "k", "Alert"), ("e", "k", "Alert"), ("f", "k", "Cancel")], "id string, key string, msg_type string")
    then = spark.createDataFrame([("a", "k1"), ("b", "k"), ("d", "k"), ("e", "k")], "id string, key string")
    assert {r["id"]: r["action"] for r in alerts.civil_diff(now, then).collect()} == {"a": "edit", "b": "all_clear", "c": "post", "e": "noop", "f": "forget"}
    assert {r["id"] for r in alerts.civil_diff(now, then, spark.createDataFrame([("k2",), ("k",)], "id string")).collect()} == set()


def test_what_follows_an_attempt(spark, value):
    next_ = lambda a, r: value(alerts.after_edit(F.lit(a), F.lit(r)))
    assert [next_(a, "missing_original") for a in ("edit", "update", "reconcile", "up", "all_clear")] == ["repost"] * 4 + ["end"]
    assert [next_(a, "failed") for a in ("edit", "all_clear", "post")] == ["retry"] * 3 and next_("new", "ok") == "store"
    diff = spark.createDataFrame([("k1", "k1", "noop"), ("k2", "k2", "noop"), ("k3", "k3", "update"), (None, "k4", "all_clear")], "key string, old_key string, action string")
    active = spark.createDataFrame([("k1", "{}"), ("k2", None), ("k3", "{}")], "id string, event_ids string")
    got = lambda due: {r["old_key"]: r["action"] for r in alerts.reconciled(diff, active, F.lit(due)).collect()}
    assert got(True) == {"k1": "reconcile", "k2": "noop", "k3": "update", "k4": "all_clear"} and got(False)["k1"] == "noop"
    due = lambda last: value(alerts.reconcile_due(F.lit(last).cast("bigint"), F.lit(10_000_000)))
    assert due(None) and due(6_400_000) and not due(6_400_001)


def test_reposts_keep_the_first_attempts_window(spark):
    kind = "id string, source string, key string, start_ms bigint, end_ms bigint, created_at bigint"
    gone = lambda end: spark.createDataFrame([("w", "dwd", 5, end, '{"!a":"$1"}', "p", "h")], "id string, source string, start_ms bigint, end_ms bigint, event_ids string, plain string, html string")
    rooms = outbox.rooms(spark, ["!a", "!b"])
    keys, first = outbox.reposts(gone(9), spark.createDataFrame([], kind), rooms, 1)
    keys, second = outbox.reposts(gone(12), keys, rooms, 2)
    assert {r["txn_id"] for r in first.collect()} == {r["txn_id"] for r in second.collect()}
    answer = lambda lost: outbox.send_all(second, lambda r: (None, "down") if r["room"] == lost else (f"${r['room']}", None))
    assert outbox.reposted(keys, answer("!b")).count() == 0
    done = outbox.reposted(keys, answer(None)).first()
    assert (done["id"], done["start_ms"], done["end_ms"]) == ("w", 5, 9) and set(json.loads(done["event_ids"])) == {"!a", "!b"}


def test_a_sink_writes_what_came_of_each_message(spark, tmp_path):
    rows = outbox.posts(spark.createDataFrame([("k", "p", "h"), ("l", "p", "h")], "alert_key string, plain string, html string"), outbox.rooms(spark, ["!a", "!b"]))
    sink = outbox.room_sink(lambda r: (None, "M_UNKNOWN") if (r["alert_key"], r["room"]) == ("l", "!b") else ("$" + r["txn_id"], None), str(tmp_path))
    sink(rows, 3)
    sink(rows, 3)
    results = spark.read.parquet(f"{tmp_path}/batch=3")
    assert results.count() == 4 and {r["alert_key"]: r["all_ok"] for r in outbox.delivered(results).collect()} == {"k": True, "l": False}


def test_quakes_and_disasters(spark, value):
    page = json.dumps({"features": [{"id": "q", "properties": {"time": 1705305600000, "place": "See", "mag": 4.25, "alert": "green"}, "geometry": {"coordinates": [13.4, 52.5, 9]}}, {"id": "r", "properties": {"time": None}, "geometry": None}]})
    f = hazards.quake_features(spark.createDataFrame([(page,), ("{}",)], "body string"))
    assert [r["id"] for r in alerts.quakes(f, 1705305600000, 52.0, 13.0, 100.0).collect()] == ["q"] and alerts.quakes(f, 1705305600000, None, None, None).count() == 2
    assert alerts.quakes(f, 1705305600000 + 49 * HOUR, 52.0, 13.0, 100.0).count() == 0
    assert value(alerts.quake_description(F.lit("See"), F.lit(1705305600000), F.lit(4.26), F.lit("green"))) == "📍 See\n🕒 Mon, 15 Jan 08:00\nℹ️ Magnitude 4.3 · USGS alert: green"
    d = spark.createDataFrame([("Green flood", 100, 1.0, 1.0), ("Red flood", None, None, None)], "title string, published_at bigint, lat double, lon double")
    assert [r["title"] for r in alerts.disasters(d, 100, None, None, None).collect()] == ["Red flood"] and alerts.disasters(d, 100, 1.0, 1.0, 9.0).count() == 0
    assert value(alerts.disaster_description(F.lit(1.005), F.lit(2.5), F.lit(1705305600), F.lit("A. B. C."))) .endswith("🕒 Mon, 15 Jan 08:00\nℹ️ A. B.")


def test_messages(value):
    plain, html = value(*alerts.alert_message(F.lit("S"), F.lit("<E>"), F.lit("a\nb"), F.lit("http://x?a&b")))
    assert plain == "🚨 <E>\na\nb\n🔗 http://x?a&b\n📰 Source: S" and "&lt;E&gt;" in html and "a<br>b" in html
    plain, _ = value(*alerts.level_change_suffix(F.lit("P"), F.lit("H"), F.lit(2), F.lit(3), F.lit(" FROST "), F.lit("09:00")))
    assert plain == "P\n\n---\n⬆️ Warnung aktualisiert: Warnstufe erhöht auf 🟠 Starke Warnung; jetzt: FROST (09:00)."
    assert value(*alerts.all_clear_suffix(F.lit("P"), F.lit("H"), F.lit("09:00")))[1].startswith("H<hr><em>✅ Entwarnung (09:00)")
    assert "Die Warnung ist nicht mehr aktiv." in value(*alerts.all_clear_message(F.lit("h"), F.lit("r")))[0]
    got = value(alerts.warning_description(F.lit("R"), F.lit("warnings"), F.lit(2), F.lit(1705305600000), F.lit(alerts.NO_END), F.lit("Kalt. Sehr."), F.lit(None).cast("string"), F.array(F.lit("(danach)"))))
    assert got == "⚠️ Warnung\n📍 R\nℹ️ Kalt. Sehr.\n(danach)"


def test_outbox(spark):
    messages = spark.createDataFrame([("k", "p", "h")], "alert_key string, plain string, html string")
    rows = outbox.posts(messages, outbox.rooms(spark, ["!a", "!b"])).collect()
    assert len({r["txn_id"] for r in rows}) == 2
    results = spark.createDataFrame([("k", "!a", "$1", None), ("k", "!b", None, "Event not found")], "alert_key string, room string, event_id string, error string")
    d = outbox.delivered(results).first()
    assert not d["all_ok"] and json.loads(d["event_ids"]) == {"!a": "$1"} and outbox.edit_results(results).first()["result"] == "missing_original"
    e = outbox.edits(messages.withColumn("event_ids", F.lit('{"!a":"$1"}'))).collect()
    assert [(r["room"], r["event_id"]) for r in e] == [("!a", "$1")]
    v = outbox.posted_version(spark.createDataFrame([("i", "k1")], "id string, key string"), spark.createDataFrame([("i", "k2", True), ("j", "k", True), ("l", "k", False)], "id string, key string, all_ok boolean"))
    assert {r["id"]: r["result"] for r in v.collect()} == {"i": "earlier_version", "j": "this_version", "l": "failed"}


def test_forecast(spark, value):
    body = json.dumps({"weather": [{"timestamp": f"2024-01-15T{h:02d}:00:00+00:00", "temperature": h + 0.5, "precipitation_probability": None, "wind_speed": 3.5, "icon": "rain"} for h in range(24)]})
    days = spark.createDataFrame([("2024-01-15", body), ("2024-01-16", body.replace('"temperature": 12.5', '"temperature": null'))], "day string, body string")
    picked = forecast.pick_hours(hazards.hourly_list(days), ["day"], 1)
    assert [(r["day"], r["local_hour"], r["temperature"]) for r in picked.orderBy("local_hour").collect()] == [("2024-01-15", h, h - 0.5) for h in (7, 13, 18, 22)]
    m = forecast.message(picked, ["day"], F.lit("Monday, 15 Jan")).first()["plain"].split("\n")
    assert m[0] == "🌦️ Weather · Monday, 15 Jan" and m[1] == "🌅 Morning: 🌧️ 6°C  💧 0%  💨 4 km/h"
    lists = json.dumps({"hourly": {"time": [f"2024-01-15T{h:02d}:00" for h in range(24)], "temperature_2m": [1.0] * 24, "precipitation_probability": [5] * 24, "wind_speed_10m": [2.0] * 24, "weathercode": [95] * 24}})
    assert forecast.pick_hours(hazards.hourly_lists(spark.createDataFrame([("d", lists)], "day string, body string")), ["day"]).count() == 4
    assert value(*forecast.weather_code(F.lit(86))) == ("🌨️", "Snow showers") and value(*forecast.icon(F.lit("?"))) == ("🌡️", "Unknown")
    assert value(hazards.region_code(F.lit("DE"), F.lit(None).cast("string"), F.lit("Berlin"), F.lit("x"), F.array(F.lit("9")))) == "110000000000" and value(hazards.region_code(F.lit("de"), F.lit("Jena"), F.lit("x"), F.lit("x"), F.array(F.lit("9")))) == "9"
