"""Saved responses of hazard and forecast services as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinity.functions import text
from vicinity.operators import alerts, forecast


def civil_dashboard(pages: DataFrame, body: str = "body") -> DataFrame:
    """(id, data) of a dashboard's list; anything else gives no rows.  ``data``: the warning as JSON."""
    rows = pages.select(F.explode(F.from_json(F.col(body), "array<string>")).alias("data"))
    named = rows.select(F.get_json_object("data", "$.id").alias("id"), "data")
    return named.where(F.col("id").isNotNull() & ~alerts.is_weather_id(F.col("id")))


def quake_features(pages: DataFrame, body: str = "body") -> DataFrame:
    """(id, time, lat, lon, place, mag, alert, url) of a feature collection."""
    kind = "features array<struct<id:string,properties:struct<time:bigint,place:string,mag:double,alert:string,url:string,title:string>,geometry:struct<coordinates:array<double>>>>"
    f = pages.select(F.explode(F.from_json(F.col(body), kind)["features"]).alias("f"))
    at = F.col("f.geometry.coordinates")
    return f.select("f.id", "f.properties.time", F.get(at, F.lit(1)).alias("lat"), F.get(at, F.lit(0)).alias("lon"), "f.properties.place", "f.properties.mag", "f.properties.alert", "f.properties.url")


def region_code(country: Column, city: Column, town: Column, village: Column, found: Column) -> Column:
    """The code of a place's warning region: built in, else the first search result; in one country only."""
    name = F.coalesce(city, town, village)
    known = F.lit(None).cast("string")
    for place, code in alerts.BUILT_IN_REGION_CODES.items():
        known = F.when(F.lower(name) == place, F.lit(code)).otherwise(known)
    return F.when((F.lower(country) == "de") & name.isNotNull(), F.coalesce(known, F.get(found, F.lit(0))))


def borough(address: Column) -> Column:
    """The borough in a reverse geocoder's address map."""
    return F.coalesce(address["borough"], address["city_district"], address["suburb"])


def hourly_list(pages: DataFrame, body: str = "body") -> DataFrame:
    """Readings of a response that lists hours."""
    r = pages.select("day", F.posexplode(forecast.listed_hours(F.col(body))).alias("n", "r"))
    return r.select("day", F.hour(F.to_timestamp("r.timestamp")).alias("utc_hour"), "n", "r.temperature", F.col("r.precipitation_probability").alias("precipitation"), F.col("r.wind_speed").alias("wind"), "r.icon")


def hourly_lists(pages: DataFrame, body: str = "body") -> DataFrame:
    """Readings of a response of parallel lists, in local time; ``icon`` is the weather code's emoji."""
    r = pages.select("day", F.posexplode(forecast.zipped_hours(F.col(body))).alias("n", "r"))
    return r.select("day", F.substring("r.time", 12, 2).cast("int").alias("utc_hour"), "n", "r.temperature", "r.precipitation", "r.wind", forecast.weather_code(F.col("r.code"))[0].alias("icon"))


def search_url(query: Column, limit: Column, since: Column, base: str) -> Column:
    """The address of a post search, newest first, a hundred results at most."""
    return F.concat(F.lit(f"{base}?q="), text.url_encode(query), F.lit("&limit="), F.least(limit, F.lit(100)).cast("string"), F.lit("&sort=latest&since="), since)
