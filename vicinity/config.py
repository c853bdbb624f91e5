"""Configuration: defaults, TOML loading, and the small tables that queries join to."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


@dataclass
class AreaGroup:
    implied_meters: float
    terms: list[str]


@dataclass
class Place:
    name: str
    lat: float
    lon: float
    aliases: list[str] = field(default_factory=list)


@dataclass
class Source:
    name: str
    type: str = "rss"
    url: str = ""
    query: str = ""
    limit: int = 25
    max_age_hours: int | None = 24
    filter: bool = True
    base_implied_meters: float | None = None
    required: list[str] | None = None


@dataclass
class FilterConfig:
    area: list[AreaGroup] = field(default_factory=list)
    places: list[Place] = field(default_factory=list)
    required: list[str] = field(default_factory=list)
    blocklist: list[str] = field(default_factory=list)
    elsewhere: list[str] = field(default_factory=list)
    home_borough: str | None = None
    address: str | None = None
    geocode_city: str | None = None
    max_age_hours: int | None = None
    digest_threshold: int = 1
    candidate_min_score: int = 1
    candidate_min_sources: int = 2
    candidate_retention_hours: int = 24


@dataclass
class AlertConfig:
    max_distance_km: float | None = 500.0
    poll_seconds: int = 120


@dataclass
class WeatherConfig:
    region_keywords: list[str] | None = None
    lead_hours: int = 3
    provider: str = "brightsky"
    post_time: str | None = None


@dataclass
class ScheduleConfig:
    poll_minutes: int = 30
    digest_times: list[str] = field(default_factory=lambda: ["08:00"])
    zone: str = "UTC"


@dataclass
class Config:
    filter: FilterConfig = field(default_factory=FilterConfig)
    alerts: AlertConfig = field(default_factory=AlertConfig)
    weather: WeatherConfig = field(default_factory=WeatherConfig)
    schedule: ScheduleConfig = field(default_factory=ScheduleConfig)
    sources: list[Source] = field(default_factory=list)


_NESTED = {("FilterConfig", "area"): AreaGroup, ("FilterConfig", "places"): Place, ("Config", "sources"): Source}
_PARTS = {"filter": FilterConfig, "alerts": AlertConfig, "weather": WeatherConfig, "schedule": ScheduleConfig}


def _build(kind: type, values: dict):
    known = {f.name for f in fields(kind)}
    args = {}
    for name, value in values.items():
        if name not in known:
            continue
        inner = _NESTED.get((kind.__name__, name))
        if inner:
            value = [_build(inner, v) for v in value]
        elif kind is Config and name in _PARTS:
            value = _build(_PARTS[name], value)
        args[name] = value
    return kind(**args)


def load(path: str | Path) -> Config:
    """A configuration file; what it leaves out has its default, what it has more is ignored."""
    return _build(Config, tomllib.loads(Path(path).read_text()))


def region_keywords(config: Config) -> list[str]:
    """Words that a warning's region must have: those given, else the city, else the first word with a
    letter in the last part of the address."""
    if config.weather.region_keywords is not None:
        return config.weather.region_keywords
    city = (config.filter.geocode_city or "").split(",")[0].strip()
    if city:
        return [city]
    last = (config.filter.address or "").split(",")[-1].split()
    return [w for w in last if any(c.isalpha() for c in w)][:1]


def area_terms(spark: SparkSession, config: FilterConfig) -> DataFrame:
    rows = [(g, a.implied_meters, t, term) for g, a in enumerate(config.area) for t, term in enumerate(a.terms)]
    return spark.createDataFrame(rows, "group_ix int, implied_meters double, term_ix int, term string")


def places(spark: SparkSession, config: FilterConfig) -> DataFrame:
    rows = [(i, p.name, p.lat, p.lon, p.aliases) for i, p in enumerate(config.places)]
    return spark.createDataFrame(rows, "place_ix int, name string, lat double, lon double, aliases array<string>")


def sources(spark: SparkSession, config: Config) -> DataFrame:
    rows = [(s.name, s.type, s.url, s.query, s.limit, s.max_age_hours, s.filter, s.base_implied_meters, s.required) for s in config.sources]
    return spark.createDataFrame(rows, "name string, type string, url string, query string, limit int, max_age_hours bigint, filter boolean, base_implied_meters double, required array<string>")
