"""A source's own terms, unknown sources, pages of a link, and sessions in another zone."""

from pyspark.sql import functions as F

from vicinity.functions import dates
from vicinity.operators import enrich, schedule

SOURCES = "name string, max_age_hours bigint, filter boolean, base_implied_meters double, required array<string>"


def test_own_terms_are_mentioned_as_keywords_are(spark):
    sources = spark.createDataFrame([("a", None, True, None, ["uhr", "Brücke"]), ("b", None, True, None, [""]), ("c", None, True, None, [])], SOURCES)
    texts = [("a", "an der ruhr"), ("a", "um acht uhr"), ("a", "brückenbau"), ("a", "die hochbrücke"), ("b", "alles"), ("c", "alles")]
    rows = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(texts)], "id int, source_name string, up string")
    own = enrich.own_terms_pass(F.col("required"), F.col("up"), F.lit(""), sources)
    got = {r["id"]: r["ok"] for r in enrich.with_sources(rows, sources).select("id", own.alias("ok")).collect()}
    assert got == {0: False, 1: True, 2: True, 3: False, 4: False, 5: True}


def test_items_of_unknown_sources_stay(spark):
    sources = spark.createDataFrame([("a", 5, False, None, None)], SOURCES)
    items = spark.createDataFrame([("1", "a"), ("2", "new"), ("3", None)], "guid string, source_name string")
    assert {r["guid"]: (r["filter"], r["max_age_hours"]) for r in enrich.with_sources(items, sources).collect()} == {"1": (False, 5), "2": (True, None), "3": (True, None)}


def test_of_several_pages_of_a_link_always_the_same_counts(spark):
    items = spark.createDataFrame([("1", "t", "l", None), ("2", "t", None, None), ("3", "t", "l", "has text")], "guid string, title string, link string, article_text string").withColumns({"filter": F.lit(True), "base_implied_meters": F.lit(None).cast("double"), "lat": F.lit(None).cast("double"), "lon": F.lit(None).cast("double"), "district": F.lit(None).cast("string"), "published_at": F.lit(None).cast("bigint")})
    pages = spark.createDataFrame([("l", f"<article><p>{w * 60}</p></article>") for w in ("one ", "two ", "three ")], "url string, html string")
    a, b = ({r["guid"]: r["article_text"] for r in enrich.with_pages(items, p).collect()} for p in (pages, pages.orderBy(F.desc("html")).coalesce(1)))
    assert a == b and set(a) == {"1", "2", "3"} and a["1"] and a["2"] is None and a["3"] == "has text"


def test_local_times_do_not_depend_on_the_session(spark):
    def read():
        page = spark.range(1).select(dates.parse_page_date(F.lit("2024-03-01T09:30:00"), "Europe/Berlin"), dates.parse_page_date(F.lit("2024-03-01T09:30:00")), dates.parse_page_date(F.lit("2024-03-01 x"))).first()
        slots = schedule.daily_slots(spark, "2024-03-30", "2024-03-31", ["02:30", "08:00"], "Europe/Berlin").collect()
        return tuple(page), sorted((r["slot"], r["at"]) for r in slots)

    first = read()
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert read() == first
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert first[0] == (1709281800, 1709285400, 1709294400)
    assert dict(first[1]) == {"2024-03-30 02:30": 1711762200, "2024-03-30 08:00": 1711782000, "2024-03-31 02:30": 1711848600, "2024-03-31 08:00": 1711864800}


def test_slot_posts_are_tried_within_their_windows(spark):
    rows = [("a", 0, 0, None, False), ("b", 0, 0, 599, True), ("c", 0, 0, 600, True), ("d", 0, 0, 10, False), ("e", 0, 10_000, 10_000, False)]
    posts = spark.createDataFrame(rows, "id string, slot_at bigint, started_at bigint, failed_at bigint, transient boolean")
    assert {r["id"]: (r["step"], r["at"]) for r in schedule.next_attempt(posts).collect()} == {"a": ("done", None), "b": ("now", 599), "c": ("later", 1500), "d": ("later", 910), "e": ("missed", None)}
