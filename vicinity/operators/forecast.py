"""Forecasts: hourly readings, the four hours of a day, and the message."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinity.functions import dates

# Hours, labels, icons and weather codes.
LOCAL_HOURS = [7, 13, 18, 22]
PERIODS = {7: "🌅 Morning", 13: "🌞 Midday", 18: "🌆 Evening", 22: "🌙 Night"}
OTHER_PERIOD = "⏰"
ICONS = {
    "clear-day": ("☀️", "Clear"), "clear-night": ("🌙", "Clear"), "partly-cloudy-day": ("⛅", "Partly cloudy"), "partly-cloudy-night": ("🌤️", "Partly cloudy"), "cloudy": ("☁️", "Cloudy"), "fog": ("🌫️", "Fog"),
    "wind": ("🌬️", "Windy"), "rain": ("🌧️", "Rain"), "sleet": ("🌨️", "Sleet"), "snow": ("❄️", "Snow"), "hail": ("🌨️", "Hail"), "thunderstorm": ("⛈️", "Thunderstorm"),
}
CODES = [
    ([0], "☀️", "Clear"), ([1], "🌤️", "Mainly clear"), ([2], "⛅", "Partly cloudy"), ([3], "☁️", "Overcast"), ([45, 48], "🌫️", "Fog"), ([51, 53, 55], "🌦️", "Drizzle"), ([56, 57], "🌦️", "Freezing drizzle"), ([61, 63, 65], "🌧️", "Rain"),
    ([66, 67], "🌧️", "Freezing rain"), ([71, 73, 75], "🌨️", "Snowfall"), ([77], "🌨️", "Snow grains"), ([80, 81, 82], "🌦️", "Rain showers"), ([85, 86], "🌨️", "Snow showers"), ([95], "⛈️", "Thunderstorm"), ([96, 99], "⛈️", "Thunderstorm with hail"),
]
UNKNOWN = ("🌡️", "Unknown")


def icon(name: Column) -> tuple[Column, Column]:
    """(emoji, words) of a named icon."""
    pick = lambda k: reduce(lambda o, kv: F.when(name == kv[0], F.lit(kv[1][k])).otherwise(o), ICONS.items(), F.lit(UNKNOWN[k]))
    return pick(0), pick(1)


def weather_code(code: Column) -> tuple[Column, Column]:
    """(emoji, words) of a weather code."""
    pick = lambda k: reduce(lambda o, c: F.when(code.isin(c[0]), F.lit(c[k])).otherwise(o), CODES, F.lit(UNKNOWN[k - 1]))
    return pick(1), pick(2)


def period(local_hour: Column) -> Column:
    return reduce(lambda o, kv: F.when(local_hour == kv[0], F.lit(kv[1])).otherwise(o), PERIODS.items(), F.lit(OTHER_PERIOD))


def zipped_hours(body: Column) -> Column:
    """An array of hourly structs from a response of parallel lists."""
    kind = "hourly struct<time:array<string>,temperature_2m:array<double>,precipitation_probability:array<bigint>,wind_speed_10m:array<double>,weathercode:array<bigint>>"
    h = F.from_json(body, kind)["hourly"]
    return F.arrays_zip(h["time"].alias("time"), h["temperature_2m"].alias("temperature"), h["precipitation_probability"].alias("precipitation"), h["wind_speed_10m"].alias("wind"), h["weathercode"].alias("code"))


def listed_hours(body: Column) -> Column:
    """An array of hourly structs from a response with a list of readings."""
    return F.from_json(body, "weather array<struct<timestamp:string,temperature:double,precipitation_probability:bigint,wind_speed:double,icon:string>>")["weather"]


def pick_hours(readings: DataFrame, day: list[str], offset_hours: Column | int = 0, hours: list[int] | None = None) -> DataFrame:
    """The readings of the chosen local hours, for days that have them all with a temperature.

    ``readings``: the columns ``day`` and utc_hour, temperature, precipitation, wind, icon; the first
    by ``n`` counts where an hour is there twice.
    """
    hours = hours or LOCAL_HOURS
    offset = offset_hours if isinstance(offset_hours, Column) else F.lit(offset_hours)
    wanted = readings.withColumn("local_hour", F.explode(F.array(*[F.lit(h) for h in hours]))).where(F.col("utc_hour") == dates.utc_hour(F.col("local_hour"), offset))
    first = wanted.groupBy(*day, "local_hour").agg(F.min_by(F.struct("temperature", "precipitation", "wind", "icon"), "n").alias("r"))
    whole = first.where("r.temperature is not null").groupBy(*day).agg(F.count("*").alias("found")).where(F.col("found") == len(hours)).select(*day)
    return first.join(whole, day, "left_semi").select(*day, "local_hour", "r.temperature", F.coalesce("r.precipitation", F.lit(0)).alias("precipitation"), F.coalesce("r.wind", F.lit(0.0)).alias("wind"), F.coalesce("r.icon", F.lit("")).alias("icon"))


def line(local_hour: Column, emoji: Column, temperature: Column, precipitation: Column, wind: Column, html: bool = False) -> Column:
    gap = " &nbsp; " if html else "  "
    whole = lambda c: F.bround(c).cast("long").cast("string")
    return F.concat(period(local_hour), F.lit(": "), emoji, F.lit(" "), whole(temperature), F.lit(f"°C{gap}💧 "), precipitation.cast("string"), F.lit(f"%{gap}💨 "), whole(wind), F.lit(" km/h"))


def message(picked: DataFrame, day: list[str], date: Column) -> DataFrame:
    """(day, plain, html): a header and four lines."""
    emoji = icon(F.col("icon"))[0]
    args = (F.col("local_hour"), emoji, F.col("temperature"), F.col("precipitation"), F.col("wind"))
    rows = picked.select(*day, date.alias("date"), F.struct("local_hour", line(*args).alias("plain"), line(*args, html=True).alias("html")).alias("l"))
    got = rows.groupBy(*day, "date").agg(F.array_sort(F.collect_list("l")).alias("l"))
    join = lambda name, sep: F.array_join(F.transform("l", lambda x: x[name]), sep)
    return got.select(*day, F.concat(F.lit("🌦️ Weather · "), "date", F.lit("\n"), join("plain", "\n")).alias("plain"), F.concat(F.lit("🌦️ <strong>Weather · "), "date", F.lit("</strong><br>"), join("html", "<br>")).alias("html"))
