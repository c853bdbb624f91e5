"""Dates of feeds and pages, local hours, validity texts and daily slots as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTES = "HH:mm"
FULL = "EEE, dd MMM HH:mm"


def local_seconds(text: Column, zone: str, form: str) -> Column:
    """Seconds since the epoch of a local date and time in ``zone``, whatever the session's zone is; null
    for anything of another form.  A time that a clock change skips moves on by the change."""
    at = F.try_to_timestamp(F.concat(text, F.lit(" +0000")), F.lit(f"{form} Z"))  # the wall clock, read as if it were UTC
    return F.unix_seconds(F.to_utc_timestamp(at, zone)) if zone.upper() != "UTC" else F.unix_seconds(at)


def _try(text: Column, *formats: str) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def parse_feed_date(c: Column) -> Column:
    """Seconds since the epoch of an RFC 3339 or RFC 2822 date; null for anything else."""
    text = F.trim(c)
    iso = F.when(text.rlike(r"(?i)^\d{4}-\d{2}-\d{2}[t ]\d{2}:\d{2}:\d{2}(\.\d+)?(z|[+-]\d{2}:\d{2})$"), F.upper(text))
    iso = F.try_to_timestamp(F.replace(iso, F.lit(" "), F.lit("T")))
    mail = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3},\s*", ""), r"(?i)\s(?:GMT|UT|UTC|Z)$", " +0000")
    mail = F.when(mail.rlike(r"^\d{1,2}\s+[A-Za-z]{3}\s+\d{4}\s+\d{1,2}:\d{2}(:\d{2})?\s[+-]\d{4}$"), F.initcap(F.regexp_replace(mail, r"\s+", " ")))
    return F.unix_seconds(F.coalesce(iso, _try(mail, "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z")))


def parse_page_date(c: Column, zone: str = "UTC") -> Column:
    """A feed date, else a local date and time, else the first ten characters as a day at noon UTC."""
    text = F.trim(c)
    local = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$"), F.replace(text, F.lit("T"), F.lit(" ")))
    local = local_seconds(local, zone, "yyyy-MM-dd HH:mm:ss")
    day = F.when(F.substring(text, 1, 10).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.substring(text, 1, 10))
    return F.coalesce(parse_feed_date(text), local, local_seconds(F.concat(day, F.lit(" 12:00:00")), "UTC", "yyyy-MM-dd HH:mm:ss"))


def since(now: Column, hours: int) -> Column:
    """RFC 3339 seconds, so many hours before a timestamp."""
    return F.date_format(now - F.expr(f"interval {int(hours)} hours"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _local(ms: Column, zone: str) -> Column:
    return F.from_utc_timestamp(F.timestamp_millis(ms), zone)


def validity(start_ms: Column, end_ms: Column, zone: str = "UTC") -> Column:
    """``Mon, 01 Jan 08:00-12:00`` in one day, else both ends in full; null without either."""
    a, b = _local(start_ms, zone), _local(end_ms, zone)
    same = F.to_date(a) == F.to_date(b)
    return F.when(same, F.concat(F.date_format(a, FULL), F.lit("-"), F.date_format(b, MINUTES))).otherwise(F.concat(F.date_format(a, FULL), F.lit(" - "), F.date_format(b, FULL)))


def validity_open(start: Column, end: Column, zone: str = "UTC") -> Column:
    """As :func:`validity` from RFC 3339 strings; with one end only, ``from`` or ``until`` it."""
    a, b = F.unix_seconds(F.timestamp_seconds(parse_feed_date(start))) * 1000, parse_feed_date(end) * 1000
    return F.coalesce(validity(a, b, zone), F.concat(F.lit("from "), F.date_format(_local(a, zone), FULL)), F.concat(F.lit("until "), F.date_format(_local(b, zone), FULL)))


def end_label(end_ms: Column, now: Column, zone: str = "UTC") -> Column:
    """``HH:MM`` if it is on the day of ``now``, else with the weekday."""
    at = _local(end_ms, zone)
    return F.when(F.to_date(at) == F.to_date(F.from_utc_timestamp(now, zone)), F.date_format(at, MINUTES)).otherwise(F.date_format(at, "EEE HH:mm"))


def utc_hour(local_hour: Column, offset_hours: Column) -> Column:
    return F.pmod(local_hour - offset_hours, F.lit(24)).cast("int")


def time_of_day(c: Column) -> Column:
    """Minutes since midnight of ``HH:MM``; null if it is none."""
    text = F.trim(c)
    hour, minute = F.regexp_extract(text, r"^(\d{1,2}):(\d{2})$", 1), F.regexp_extract(text, r"^(\d{1,2}):(\d{2})$", 2)
    value = hour.try_cast("int") * 60 + minute.try_cast("int")
    return F.when((hour.try_cast("int") < 24) & (minute.try_cast("int") < 60), value)
