from pyspark.sql import functions as F

from vicinity.functions import dates
from vicinity.operators import schedule


def test_feed_and_page_dates(value):
    f = lambda s: value(dates.parse_feed_date(F.lit(s)))
    assert f("Mon, 15 Jan 2024 10:30:00 +0000") == f("2024-01-15T11:30:00+01:00") == f(" 15 Jan 2024 10:30:00 GMT ") == 1705314600
    assert f("2024-01-15") is None and f("gestern") is None and f("") is None
    p = lambda s, z="UTC": value(dates.parse_page_date(F.lit(s), z))
    assert p("2024-03-01") == p("2024-03-01 irgendwann") == 1709294400
    assert p("2024-07-01T12:00:00", "Europe/Berlin") == 1719828000 and p("x") is None


def test_validity(value):
    assert value(dates.validity(F.lit(1705305600000), F.lit(1705312800000))) == "Mon, 15 Jan 08:00-10:00"
    assert value(dates.validity(F.lit(1705305600000), F.lit(1705399200000))) == "Mon, 15 Jan 08:00 - Tue, 16 Jan 10:00"
    assert value(dates.validity_open(F.lit(None).cast("string"), F.lit("2024-01-15T08:00:00Z"))) == "until Mon, 15 Jan 08:00"
    assert value(dates.validity_open(F.lit("2024-01-15T08:00:00Z"), F.lit(None).cast("string"))) == "from Mon, 15 Jan 08:00"


def test_times_of_day(value):
    t = lambda s: value(dates.time_of_day(F.lit(s)))
    assert t("08:30") == 510 and t("7:05") == 425 and t("25:00") is None and t("unsinn") is None


def test_slots_follow_local_time_over_clock_changes(spark):
    slots = {r["slot"]: r["at"] for r in schedule.daily_slots(spark, "2026-10-24", "2026-10-25", ["08:00", "nichts", "20:00"], "Europe/Berlin").collect()}
    assert slots["2026-10-24 08:00"] == 1792821600 and slots["2026-10-25 08:00"] - slots["2026-10-24 08:00"] == 25 * 3600
    spring = {r["slot"]: r["at"] for r in schedule.daily_slots(spark, "2026-03-28", "2026-03-29", ["08:00"], "Europe/Berlin").collect()}
    assert spring["2026-03-29 08:00"] - spring["2026-03-28 08:00"] == 23 * 3600


def test_due_slots_seed_and_retry(spark):
    slots = schedule.daily_slots(spark, "2026-10-24", "2026-10-25", ["08:00", "20:00"], "UTC")
    empty = spark.createDataFrame([], "id string, source string, sent_at bigint")
    now = 1792915200  # 2026-10-25 08:00
    seeded = schedule.seed(empty, slots, "digest", now)
    assert [r["id"] for r in seeded.collect()] == ["digest:2026-10-25 08:00"]
    assert schedule.seed(seeded, slots, "digest", now + 86400).count() == 1
    assert schedule.due(slots, seeded, "digest", now).isEmpty()
    assert [r["slot"] for r in schedule.due(slots, seeded, "digest", now + 13 * 3600).collect()] == ["2026-10-25 20:00"]
    assert schedule.due(slots, seeded, "digest", now + 20 * 3600).isEmpty()  # missed by more than three hours
    assert schedule.retry_at(now + 60, now) == now + 960 and schedule.retry_at(now + 11000, now) is None
    assert schedule.forecast_time(None, ["07:15"]) == "07:15" and schedule.forecast_time(None, []) == "08:00"
