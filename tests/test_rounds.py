import json

from pyspark.sql import functions as F

from vicinity import config
from vicinity.functions import markup, streets
from vicinity.operators import enrich
from vicinity.sources import geocoder
from vicinity.sources.session import LIFE_SECONDS, Session, Tokens
from vicinity.streaming import timers

ITEM = "guid string, title string, link string, description string, article_text string, source_name string, published_at bigint, lat double, lon double, district string"
NOW = 1_705_400_000
CONF = config.FilterConfig(area=[config.AreaGroup(1500.0, ["Hafentor"])], places=[config.Place("Alter Turm", 52.51, 13.45)], required=["stadt"], blocklist=["sport"], digest_threshold=3, candidate_min_score=2)


def _round(spark, rows, pages=(), hits=None, failed=(), retries=(), stored=()):
    sources = config.sources(spark, config.Config(sources=[config.Source("F", max_age_hours=48), config.Source("U", filter=False), config.Source("B", base_implied_meters=900.0, filter=False), config.Source("R", required=[])]))
    hits = hits if hits is not None else spark.createDataFrame([], "candidate string, pos int, lat double, lon double, display_name string, suburb string, borough string, shape array<array<struct<lat:double,lon:double>>>")
    out = enrich.poll_round(
        spark.createDataFrame(rows, ITEM), spark.createDataFrame([(s,) for s in stored], "guid string"), spark.createDataFrame(list(retries), "guid string, attempts int"), sources,
        spark.createDataFrame(list(pages), "url string, html string"), hits, spark.createDataFrame([(c,) for c in failed], "candidate string"), CONF, (52.51, 13.45), NOW,
    )
    return {r["guid"]: r for r in out.collect()}


def _item(guid, title="Neues aus der Stadt", link=None, text="Text der Stadt", source="F", at=NOW - 60, lat=None, lon=None):
    return (guid, title, link, None, text, source, at, lat, lon, None)


def test_a_round_routes_by_all_evidence(spark):
    page = "<article><p>" + "In der Stadt am Hafentor. " * 20 + '</p></article><meta name="date" content="2024-01-16T01:00:00">'
    hit = ("Lange Gasse 5", 0, 52.511, 13.451, "Lange Gasse, Ost, Stadt, Land", None, None, [])
    hits = spark.createDataFrame([hit], "candidate string, pos int, lat double, lon double, display_name string, suburb string, borough string, shape array<array<struct<lat:double,lon:double>>>")
    got = _round(
        spark,
        [_item("seen"), _item("page", link="https://x.test/a", text=None, at=None), _item("gone", link="https://x.test/weg", text=None), _item("old", at=NOW - 50 * 3600), _item("sport", text="Sport in der Stadt"), _item("weak"), _item("place", text="Stadt: Fest am Alter Turm"), _item("coords", lat=52.5101, lon=13.4501), _item("free", source="U", text="x"), _item("base", source="B", text="x"), _item("own", source="R", text="nichts davon"), _item("street", title="Brand in Lange Gasse 5 Stadt"), _item("later", title="Brand in Kurze Gasse Stadt"), _item("last", title="Brand in Kurze Gasse Stadt")],
        [("https://x.test/a", page)], hits, ["Kurze Gasse"], [("last", 6)], ["seen"],
    )
    want = {"page": ("candidate", 2), "gone": ("retry", 0), "old": ("dropped", 0), "sport": ("dropped", 0), "weak": ("dropped", 0), "place": ("queued", 5), "coords": ("queued", 5), "free": ("queued", 0), "base": ("queued", 3), "own": ("dropped", 0), "street": ("queued", 5), "later": ("retry", 0), "last": ("dropped", 0)}
    assert {g: (r["outcome"], r["score"]) for g, r in got.items()} == want
    assert got["page"]["published_at"] == 1705366800 and got["page"]["location_label"] == '"Hafentor" (1500m)' and got["page"]["distance_meters"] is None
    assert got["coords"]["location_label"] == "source coordinates" and got["base"]["location_label"] is None and got["street"]["location_label"] == "Lange Gasse, Ost, Stadt"


def test_lookups_are_kept_and_failures_asked_again(spark):
    body = json.dumps([{"lat": "52.5", "lon": "13.4", "name": "", "display_name": "D", "address": {"road": "Lange Gasse", "city": "Stadt"}, "geojson": {"type": "LineString", "coordinates": [[13.4, 52.5], [13.5, 52.5]]}}])
    known = spark.createDataFrame([("a", True, "[]"), ("b", False, None)], geocoder.ANSWERS)
    new = geocoder.ask(spark.createDataFrame([("a",), ("b",), ("Lange Gasse 3",), ("b",)], "candidate string"), known, lambda c: None if c == "b" else body, 0).collect()
    assert {r["candidate"]: r["ok"] for r in new} == {"b": False, "Lange Gasse 3": True}
    table = spark.createDataFrame(new, geocoder.ANSWERS)
    hits = streets.validated_hits(geocoder.answers(table), "Stadt").collect()
    assert [(h["candidate"], len(h["shape"][0])) for h in hits] == [("Lange Gasse 3", 2)] and [r["candidate"] for r in geocoder.failed(table).collect()] == ["b"]
    assert "q=a+b%2C+Jena&" in spark.range(1).select(geocoder.address("https://g", F.lit("a b"), "Jena")).first()[0]


def test_tokens_are_held_refreshed_or_asked_for_anew():
    now, calls = [0.0], []
    logins = iter([Tokens("a1", "r1"), None, Tokens("a3", "r3")])
    refreshed = iter([Tokens("a2", "r2"), None, None])
    s = Session(lambda: calls.append("login") or next(logins), lambda r: calls.append(r) or next(refreshed), lambda: now[0])
    assert s.token() == s.token() == "a1" and calls == ["login"]
    now[0] = LIFE_SECONDS - 200
    assert s.token() == "a2" and calls[-1] == "r1"
    now[0] += LIFE_SECONDS
    assert s.token() is None and calls[-2:] == ["r2", "login"]
    assert s.token() == "a3"


def test_xml_pieces():
    xml = '<a/><a x="1"/><a x="2"><![CDATA[ <b>&amp;</b> ]]></a><c>&auml; </c><d></d>'
    assert markup.xml_text(xml, "a") == "<b>&amp;</b>" and markup.xml_text(xml, "c") == "ä" and markup.xml_text(xml, "d") is None and markup.xml_text(xml, "e") is None
    assert markup.xml_attribute(xml, "a", "x") == "1" and markup.xml_attribute(xml, "c", "x") is None


def _stream(spark, tmp_path, f, schema, batches):
    feed, out, state = (str(tmp_path / n) for n in ("feed", "out", "state"))
    for rows in batches:
        spark.createDataFrame(rows, schema).select("guid", *[c for c in schema.replace(" string", "").split(", ") if c not in ("guid",) and " " not in c], F.timestamp_seconds("at").alias("at")).coalesce(1).write.mode("append").parquet(feed)
        kind = spark.read.parquet(feed).schema
        f(spark.readStream.schema(kind).parquet(feed)).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def test_candidates_expire_by_event_time(spark, tmp_path):
    hour = 3600
    got = _stream(spark, tmp_path, timers.candidate_expiry, "guid string, state string, at bigint", [[("a", "candidate", hour // 2), ("b", "candidate", hour)], [("a", "queued", 5 * hour), ("c", "queued", 6 * hour)], [("z", "candidate", 40 * hour)], [("z", "queued", 41 * hour)]])
    assert sorted((r["guid"], r["state"], int(r["at"].timestamp())) for r in got.collect()) == [("a", "queued", 5 * hour), ("b", "dropped", 25 * hour), ("z", "queued", 41 * hour)]


def test_retry_counters_end_and_are_forgotten(spark, tmp_path):
    day = 86400
    got = _stream(spark, tmp_path, timers.retry_counters, "guid string, at bigint", [[("a", day + i) for i in range(5)], [("a", day + 10), ("b", day)], [("a", 20 * day)]])
    assert sorted((r["guid"], r["attempts"], r["final"]) for r in got.collect()) == [("a", 1, False), ("a", 1, False), ("a", 2, False), ("a", 3, False), ("a", 4, False), ("a", 5, False), ("a", 6, True), ("b", 1, False)]
