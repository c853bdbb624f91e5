"""Location evidence of items: collected, scored, and the best of it chosen."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinity.config import AreaGroup, FilterConfig, Place
from vicinity.functions import geo, terms, text

# Kinds in rising rank; the rank breaks ties of score.
SOURCE_DEFAULT, KEYWORD, PLACE, GEOCODED, COORDINATES = range(5)
EVIDENCE = "struct<meters:double,label:string,kind:int,prominent:boolean,penalty:int,pos:int>"


def item_text(title: Column, description: Column, article: Column) -> tuple[Column, Column]:
    """(prominent, rest): normalised title, description and lead; and what follows the lead."""
    lead, rest = text.split_lead(text.relevant_article_text(article))
    return text.normalize(F.concat(title, F.lit(" "), F.coalesce(description, F.lit("")), F.lit(" "), lead)), text.normalize(rest)


def evidence(meters: Column, label: Column, kind: int, prominent: Column, penalty: Column, pos: int) -> Column:
    return F.struct(meters.cast("double").alias("meters"), label.alias("label"), F.lit(kind).alias("kind"), prominent.alias("prominent"), penalty.cast("int").alias("penalty"), F.lit(pos).alias("pos"))


def _table(rows: list[dict], schema: str) -> Column:
    """Rows of the configuration as one constant array."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")


def area_evidence(prominent: Column, rest: Column, groups: list[AreaGroup]) -> Column:
    """An array with one entry for each area group that is mentioned: its first term in the prominent
    part, else its first in the rest."""
    if not groups:
        return F.array().cast(f"array<{EVIDENCE}>")
    listed = [(pos, float(g.implied_meters), t) for pos, g in enumerate(groups) for t in g.terms]
    rows = [{"meters": m, "up": f'"{t}" ({int(m)}m)', "down": f'"{t}" ({int(m)}m, body only)', "pos": pos} for pos, m, t in listed]
    codes = terms.found_in(prominent, rest, [t for *_, t in listed], place=True, owners=[pos for pos, *_ in listed])
    table = _table(rows, "meters:double,up:string,down:string,pos:int")

    def entry(code: Column) -> Column:
        row, up = F.get(table, F.floor(code / 2).cast("int")), code % 2 == 1
        return F.struct(row["meters"].alias("meters"), F.when(up, row["up"]).otherwise(row["down"]).alias("label"), F.lit(KEYWORD).alias("kind"), up.alias("prominent"), F.lit(0).alias("penalty"), row["pos"].alias("pos")).cast(EVIDENCE)

    return F.transform(codes, entry)


def place_evidence(prominent: Column, rest: Column, places: list[Place], lat: float, lon: float, first: int = 1000) -> Column:
    """An array with one entry for each configured place that is named as whole words."""
    if not places:
        return F.array().cast(f"array<{EVIDENCE}>")
    named = [(pos, name) for pos, p in enumerate(places) for name in [p.name, *p.aliases]]
    codes = terms.found_in(prominent, rest, [n for _, n in named], whole=True, owners=[pos for pos, _ in named])
    table = _table([{"name": places[pos].name, "lat": float(places[pos].lat), "lon": float(places[pos].lon), "pos": first + pos} for pos, _ in named], "name:string,lat:double,lon:double,pos:int")

    def entry(code: Column) -> Column:
        row = F.get(table, F.floor(code / 2).cast("int"))
        meters = geo.haversine(F.lit(lat), F.lit(lon), row["lat"], row["lon"])
        return F.struct(meters.cast("double").alias("meters"), row["name"].alias("label"), F.lit(PLACE).alias("kind"), (code % 2 == 1).alias("prominent"), F.lit(0).alias("penalty"), row["pos"].alias("pos")).cast(EVIDENCE)

    return F.transform(codes, entry)


def source_evidence(base_meters: Column) -> Column:
    """The source's own distance, without a label, if it has one."""
    return F.filter(F.array(F.when(base_meters.isNotNull(), evidence(base_meters, F.lit(""), SOURCE_DEFAULT, F.lit(True), F.lit(0), -1))), lambda e: e.isNotNull())


def coordinate_evidence(lat: Column, lon: Column, venue: Column, ref_lat: float, ref_lon: float) -> Column:
    meters = geo.haversine(F.lit(ref_lat), F.lit(ref_lon), lat, lon)
    return F.filter(F.array(F.when(lat.isNotNull() & lon.isNotNull(), evidence(meters, F.coalesce(venue, F.lit("source coordinates")), COORDINATES, F.lit(True), F.lit(0), 3000))), lambda e: e.isNotNull())


def is_measured(kind: Column) -> Column:
    return kind.isin(PLACE, GEOCODED, COORDINATES)


def is_textual(kind: Column) -> Column:
    return kind.isin(KEYWORD, PLACE, GEOCODED)


def penalise(found: Column, elsewhere: Column) -> Column:
    """A point off what texts say, where the item seems to be about another place."""
    less = F.transform(found, lambda e: e.withField("penalty", F.when(is_textual(e["kind"]), e["penalty"] + 1).otherwise(e["penalty"])))
    return F.when(elsewhere, less).otherwise(found)


def score(e: Column) -> Column:
    return F.greatest(F.lit(0), geo.distance_score(e["meters"]) - F.when(e["prominent"], 0).otherwise(1) - e["penalty"])


def best(found: Column) -> Column:
    """The entry with the highest score, then kind, then nearness; of equals the last."""
    keyed = F.transform(found, lambda e: F.struct(score(e).alias("score"), e["kind"].alias("rank"), (-e["meters"]).alias("near"), e["pos"].alias("last"), e.alias("evidence")))
    return F.array_max(keyed)


def final_columns(top: Column) -> list[Column]:
    """score, max_score, distance_meters (measured only) and location_label (none for a source's own)."""
    e = top["evidence"]
    return [
        F.coalesce(top["score"], F.lit(0)).alias("score"), F.lit(geo.MAX_SCORE).alias("max_score"),
        F.when(is_measured(e["kind"]), e["meters"]).alias("distance_meters"),
        F.when(e["kind"] != SOURCE_DEFAULT, e["label"]).alias("location_label"),
    ]


def best_of_rows(rows: DataFrame, item: str) -> DataFrame:
    """As :func:`best` for evidence in rows: one row an item, by one aggregation."""
    e = F.struct("meters", "label", "kind", "prominent", "penalty", "pos")
    order = F.struct(score(e).alias("score"), F.col("kind"), (-F.col("meters")).alias("near"), F.col("pos"))
    return rows.groupBy(item).agg(F.max_by(F.struct(score(e).alias("score"), e.alias("evidence")), order).alias("top"))


# District labels that point nowhere in particular.
NON_SPECIFIC_DISTRICTS = ["bezirksübergreifend", "berlinweit", "landesweit"]


def located_elsewhere(title: Column, district: Column, config: FilterConfig) -> Column:
    """Why an item seems to be about another place, or null."""
    filed = F.lit(None).cast("string")
    if config.home_borough is not None:
        home = text.normalize_text(config.home_borough).strip()
        d = text.normalize(district)
        specific = ~text.contains_any(d, [text.normalize_text(x) for x in NON_SPECIFIC_DISTRICTS])
        filed = F.when(specific & (text.squeeze_ends(d) != home), F.concat(F.lit("filed under "), district, F.lit(f", not {config.home_borough}")))
    t = text.normalize(title)
    own = [x for g in config.area for x in g.terms] + [x for p in config.places for x in [p.name, *p.aliases]]
    # one look-up for both lists: other places first, as the first of them is named
    found = terms.found_in(t, F.lit(""), config.elsewhere + own, place=True)
    first, last = F.get(found, F.lit(0)), F.get(found, F.size(found) - 1)
    names_own = F.coalesce(last >= 2 * len(config.elsewhere), F.lit(False))
    listed = F.get(_table([{"term": x} for x in config.elsewhere], "term:string"), F.floor(first / 2).cast("int"))["term"]
    other = F.when(first < 2 * len(config.elsewhere), F.concat(F.lit("title names "), listed))
    return F.coalesce(filed, F.when(~names_own, other))
