import json

import pytest
from pyspark.sql import functions as F

from vicinity import config
from vicinity.functions import markup, streets
from vicinity.sources import feeds
from vicinity.sources.datasource import FeedSource

RSS = """<?xml version="1.0" encoding="utf-8"?><rss version="2.0" xmlns:georss="http://www.georss.org/georss" xmlns:geo="http://www.w3.org/2003/01/geo/wgs84_pos#"><channel><title>C</title>
<item><guid>g1</guid><title>Eins &amp; &lt;b&gt;zwei&lt;/b&gt;</title><link>https://x.test/1</link><description><![CDATA[<p>Text&nbsp;hier</p>]]></description><pubDate>Mon, 15 Jan 2024 10:30:00 +0000</pubDate><georss:point>52.5 13.4</georss:point></item>
<item><title></title><description>Nur eine Zusammenfassung</description><geo:lat>1.5</geo:lat><geo:long>2.5</geo:long></item><item><title> </title></item></channel></rss>"""
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>a1</id><title>T</title><link rel="self" href="https://x.test/self"/><link rel="alternate" href=" https://x.test/a "/><updated>2024-01-15T10:30:00Z</updated></entry></feed>'
JSON_FEED = json.dumps({"items": [{"id": 7, "url": "https://x.test/j", "title": "J", "date_published": "2024-01-15T10:30:00Z"}, "x"]})


def test_feeds_of_three_kinds(spark):
    rows = feeds.parse(spark.createDataFrame([("S", RSS), ("A", ATOM), ("J", JSON_FEED), ("K", "<rss><kaputt"), ("N", None), ("E", " ")], "source_name string, xml string")).collect()
    got = {r["guid"]: r for r in rows}
    assert set(got) == {"g1", "S::Nur eine Zusammenfassung", "a1", "7"}
    one = got["g1"]
    assert (one["title"], one["description"], one["published_at"], one["lat"], one["lon"]) == ("Eins & zwei", "Text hier", 1705314600, 52.5, 13.4)
    assert (got["S::Nur eine Zusammenfassung"]["lat"], got["a1"]["link"], got["a1"]["published_at"], got["7"]["link"]) == (1.5, "https://x.test/a", 1705314600, "https://x.test/j")


def test_social_posts(spark):
    body = json.dumps({"posts": [{"uri": "at://did/app/3k", "author": {"handle": "h.test"}, "record": {"text": "\n Erste Zeile \nzweite", "createdAt": "2024-01-15T10:30:00Z"}}, {"uri": None, "record": {"text": "x"}}, {"uri": "at://d/app/4", "record": {"text": "  "}}, {"uri": "at://d/app/5", "record": {"text": "y"}}]})
    rows = feeds.social_posts(spark.createDataFrame([("S", body)], "source_name string, body string")).collect()
    assert [(r["title"], r["link"].rsplit("/", 3)[1:]) for r in rows] == [("Erste Zeile", ["h.test", "post", "3k"]), ("y", ["unknown", "post", "5"])]
    assert rows[0]["description"] == rows[0]["article_text"] == "Erste Zeile \nzweite"


def test_search_addresses(value):
    assert "q=a+b%26%C3%A9~%2A&" in value(feeds.search_feed_url(F.lit("a b&é~*"))) and value(feeds.search_feed_url(F.lit(" "))) == ""


def test_coordinates_by_guid_then_link(spark):
    items = spark.createDataFrame([("g", "l", None, None), ("h", "l", None, None), ("i", None, 9.0, 9.0)], "guid string, link string, lat double, lon double")
    points = spark.createDataFrame([("g", 1.0, 2.0), ("l", 3.0, 4.0)], "key string, lat double, lon double")
    assert {r["guid"]: (r["lat"], r["lon"]) for r in feeds.attach_coordinates(items, points).collect()} == {"g": (1.0, 2.0), "h": (3.0, 4.0), "i": (9.0, 9.0)}


def test_configured_sources_from_saved_responses(spark, tmp_path):
    (tmp_path / "S.xml").write_text(RSS)
    (tmp_path / "B.json").write_text(json.dumps({"posts": [{"uri": "at://d/a/1", "record": {"text": "Post"}}]}))
    conf = config.Config(sources=[config.Source("S"), config.Source("B", type="bluesky"), config.Source("fehlt")])
    rows = feeds.read(spark, config.sources(spark, conf), str(tmp_path)).collect()
    assert sorted(r["source_name"] for r in rows) == ["B", "S", "S"]


def test_data_source_batch_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/S.xml").write_text(RSS)
    (tmp_path / "in/A.xml").write_text(ATOM)
    spark.dataSource.register(FeedSource)
    assert spark.read.format("feed_documents").load(str(tmp_path / "in")).count() == 4
    q = spark.readStream.format("feed_documents").load(str(tmp_path / "in")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start()
    q.awaitTermination()
    assert {r["source_name"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"A", "S"}
    (tmp_path / "in/0-first-by-name.xml").write_text(ATOM)
    q = spark.readStream.format("feed_documents").load(str(tmp_path / "in")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start()
    q.awaitTermination()
    got = [r["source_name"] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == ["0-first-by-name", "A", "S", "S", "S"]


def test_entities():
    assert markup.decode("&amp;lt; &#228;&#xE4;&#X41; &nix; &auml &shy;&euro;") == "&lt; ääA &nix; &auml €"
    assert markup.decode("&#0; &#1114112; &#xD800;") == "&#0; &#1114112; &#xD800;"


PAGE = """<html><head><link rel="x Canonical" href="https://x.test/c"><meta property="og:url" content="https://x.test/og"><meta name="date" content="2024-03-01">
<script type="application/ld+json">{kaputt</script><script type="application/ld+json">{"@graph":[{"@type":"WebPage"},{"@type":["Thing","MusicEvent"],"location":[{"geo":{"latitude":"52.5","longitude":13.4},"address":{"streetAddress":" Weg 1 ","postalCode":"30447","addressLocality":""}}]}]}</script></head>
<body><nav>Menü</nav><p title="Ereignisort">Nord &amp; Süd</p><div class="teaser ad">%s</div><div class="content">%s</div></body></html>""" % ("anderes " * 40, "Inhalt steht hier. " * 30)


def test_page_metadata():
    assert markup.event_location(PAGE) == {"lat": 52.5, "lon": 13.4, "address": "Weg 1 30447"}
    assert markup.published_text(PAGE) == "2024-03-01" and markup.district(PAGE) == "Nord & Süd" and markup.link_rel(PAGE, "canonical") == "https://x.test/c"
    assert markup.published_text('<script>{"datePublished" : "2024-01-01"}</script>') == "2024-01-01" and markup.published_text("") is None
    assert markup.event_location('<script type="application/ld+json">{"@type":"Event","location":{"geo":{"latitude":99,"longitude":1}}}</script>') is None
    assert markup.event_location('<script type="application/ld+json">[{"@type":"Event","location":"Halle"}]</script>') == {"lat": None, "lon": None, "address": "Halle"}


def test_article_body(spark):
    assert markup.article_body(PAGE).startswith("Inhalt steht hier.") and markup.article_body("<p>kurz</p>") == "kurz"
    row = spark.createDataFrame([(PAGE,), (None,)], "html string").select(markup.page_columns(F.col("html")).alias("p")).collect()
    assert row[0]["p"]["address"] == "Weg 1 30447" and row[1]["p"]["text"] is None


def test_links(value):
    assert markup.article_link("https://f.test/", PAGE) == "https://x.test/c" and markup.article_link("https://f.test/", "") == "https://f.test/"
    wrapped = '<a href="https://news.google.com/x">g</a><a href="/url?q=https%3A%2F%2Fziel.test%2Fa&x=1">z</a>'
    assert markup.article_link("https://news.google.com/rss/1", wrapped) == "https://ziel.test/a"
    assert markup.url_parameter("u?a&url=https://x", ["url"]) is None and markup.percent_decode("%zz%41%C3") == "%zzA�"
    note = lambda u, t: value(markup.link_note(F.lit(u), F.lit(u), F.lit("Feuer in der Scheune"), F.lit(t)))
    assert note("https://x/liveticker", "Scheune brennt") == "rolling source link" and note("https://x/a", "x") is None
    assert note("https://x/ticker", "Regenwetter dauert an") == "rolling source link may no longer show this item"


@pytest.mark.parametrize(("body", "names"), [("Sperrung Quittenberger Straße 31", ["Quittenberger Straße 31"]), ("Rohrbruch in der Kupferbachgasse.", ["Kupferbachgasse"]), ("Sperre Wolfsteiner Allee/Rappacher Straße", ["Wolfsteiner Allee", "Rappacher Straße"]), ("Umzug durch die Ida Korn Allee", ["Ida Korn Allee"]), ("Rohrbruch (Alte Torstraße 12)", ["Alte Torstraße 12"]), ("der Kommunalplan ist fertig", []), ("bei der Allee", []), ("Torstraße und TORSTRASSE und torstraße, 99990", ["Torstraße", "TORSTRASSE"])])
def test_street_names(body, names):
    assert streets.candidates(body) == names


def _answers(spark):
    kind = "candidate string, pos int, lat string, lon string, name string, display_name string, address map<string,string>, geojson string"
    rows = [("", "Stille Straße", "Suhl"), ("Quittenberger Straße", "Quittenberger Straße", "Plauen"), ("Quittenberger Straße", "Quittenberger Straße", "Suhl"), ("", "Quittenberger Straße", "Suhl")]
    return lambda asked: spark.createDataFrame([(asked, i, "52.5", "13.4", n, n, {"road": r, "city": c} | ({"quarter": "Nord"} if i == 2 else {}), None) for i, (n, r, c) in enumerate(rows)], kind)


def test_geocoder_answers_are_the_street_in_the_city(spark):
    answers = _answers(spark)
    hits = streets.validated_hits(answers("Sperrung Quittenberger Straße 31"), "Suhl, DE").orderBy("pos").collect()
    assert [h["pos"] for h in hits] == [2, 3] and hits[0]["suburb"] == "Nord" and hits[0]["shape"] == []
    assert streets.validated_hits(answers("Parkplatz"), "Suhl").count() == 0 and streets.validated_hits(answers("x"), "").count() == 4


def test_nearest_street_and_districts(spark):
    """Along the equator: a thousandth of a degree is 111.2 m; the reference point is 0, 0."""
    line = "array<struct<lat:double,lon:double>>"
    hit = lambda i, c, west, east, suburb: (c, i, 0.0, west, f"{c}, {suburb}", suburb, None, [[(0.0, west), (0.0, east)]])
    hits = spark.createDataFrame([hit(0, "Breite Allee", 0.03, 0.035, "Amsel"), hit(1, "Breite Allee", 0.001, 0.02, "Drossel"), hit(2, "Breite Allee", 0.04, 0.045, "Amsel"), hit(0, "Späte Gasse", 2.0, 2.1, "Fink")], f"candidate string, pos int, lat double, lon double, display_name string, suburb string, borough string, shape array<{line}>")
    mentions = spark.createDataFrame([(1, "Breite Allee", 5, True, 0), (2, "Breite Allee", 5, True, 0), (3, "Späte Gasse", 5, True, 0), (4, "Breite Allee", 2, False, 0)], "id int, candidate string, confidence int, prominent boolean, pos int")
    texts = spark.createDataFrame([(1, "rohrbruch", "", None), (2, "rohrbruch in amsel", "", None), (3, "x", "", None), (4, "y", "", None)], "id int, prominent_text string, rest_text string, district string")
    got = {r["id"]: r for r in streets.nearest_street(mentions, hits, texts, 0.0, 0.0).collect()}
    assert set(got) == {1, 2} and abs(got[1]["meters"] - 111.2) < 1 and got[1]["label"].endswith("Drossel") and got[1]["penalty"] == 2
    assert abs(got[2]["meters"] - 3335.8) < 2 and got[2]["label"].endswith("Amsel")


def test_street_evidence_keeps_the_first_mention(spark):
    rows = spark.createDataFrame([(1, "Feuer Hofgasse", "An der hofgasse und Neue Hofgasse", "Lange Zeile. " * 120 + "Am Ende die Torallee.")], "id int, title string, description string, article_text string")
    got = {r["candidate"]: (r["confidence"], r["prominent"]) for r in streets.street_evidence(rows).collect()}
    assert got == {"Hofgasse": (6, True), "Neue Hofgasse": (3, True), "Torallee": (2, False)}
