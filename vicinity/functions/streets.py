"""Street mentions and geocoder answers: candidates, confidence, validation, nearest distance."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vicinity.functions import geo, text
from vicinity.functions.shared import evaluated
from vicinity.functions.text import STREET_SUFFIXES

# Words, limits and fields that results depend on.
CANNOT_LEAD = """auf der die das dem den des ein eine einen einem einer eines am im zur zum vom von an in zu bei nach über unter vor durch entlang bis um seit ab außer gegenüber nahe neben hinter
zwischen und oder sowie bzw diese dieser diesem diesen jede jeder jedem ecke höhe kreuzung richtung""".split()
ADJECTIVES = "neue neuer alte alter kleine kleiner große grosse großer grosser lange langer hohe hoher obere oberer untere unterer".split()
LEADING_EDGE, TRAILING_EDGE = "(\"'„“‚»«[#", ",.;:!?)\"'“”«»]"
EVENT_STEMS = "brand feuer unfall verletz polizei sperr einsatz warnung raub diebstahl überfall messer schuss verkehr störung rettung evaku gefähr".split()
STREET_FIELDS = "road pedestrian footway path square cycleway bridge place".split()
CITY_FIELDS = "city town village municipality state county".split()
LEAST_CONFIDENCE = 3
VENUE_CONFIDENCE = 7
SECTIONS = ["title", "description", "lead", "rest"]


#: A word from its first letter on that may be a capital: street names end in a capitalised word.
_CAPITAL = re.compile("[A-Z\x80-\U0010ffff][^\\s/]*")
#: A word with a street suffix, in lower case; texts without one among their capitalised words are not cut into words.
_SUFFIXED = re.compile(f"(?:{'|'.join(map(re.escape, STREET_SUFFIXES))})[{re.escape(TRAILING_EDGE)}]*(?:[\\s/]|\\Z)")


def _trimmed(word: str) -> str:
    return word.lstrip(LEADING_EDGE).rstrip(TRAILING_EDGE)


def candidates(value: str) -> list[str]:
    """Street names in a text, in order, each spelling once whatever its case.

    A capitalised word with a street suffix takes up to two words before it along: before a bare
    suffix any capitalised word that can stand there, up to one with an adjective's ending; before a
    compound, one of the adjectives.  A bare suffix alone names nothing.  A house number follows.
    """
    if not _SUFFIXED.search("\n".join(_CAPITAL.findall(value)).lower()):
        return []
    words = [w for w in map(_trimmed, value.replace("/", " ").split()) if w]
    lows = [w.lower() for w in words]

    def start(i: int) -> int:
        """Where the name that ends at word ``i`` begins."""
        capital = lambda k: k >= 0 and words[k][0].isupper() and lows[k] not in CANNOT_LEAD
        if lows[i] not in STREET_SUFFIXES:
            return i - 1 if capital(i - 1) and lows[i - 1] in ADJECTIVES else i
        if not capital(i - 1):
            return i
        return i - 1 if lows[i - 1].endswith(("er", "sche", "sch")) or not capital(i - 2) else i - 2

    found: dict[str, str] = {}
    for i, low in enumerate(lows):
        if not words[i][0].isupper() or not low.endswith(tuple(STREET_SUFFIXES)):
            continue
        first = start(i)
        if first == i and low in STREET_SUFFIXES:
            continue
        numbered = i + 1 < len(words) and words[i + 1][0] in "0123456789" and len(words[i + 1].encode()) <= 4
        name = " ".join(words[first : i + 1 + numbered])
        if len(name.encode()) >= 5:
            found.setdefault(name.lower(), name)
    return list(found.values())


def street_candidates(c: Column | str) -> Column:
    """An array of the street names in a string column."""

    @F.pandas_udf("array<string>")
    def find(values: pd.Series) -> pd.Series:
        return pd.Series([candidates(v or "") for v in values], dtype=object)

    return find(c)


def confidence(section: Column, value: Column) -> Column:
    """How sure a mention is: by its section, and two more where the section tells of an event."""
    base = F.when(section == "title", 4).when(section.isin("description", "lead"), 3).otherwise(2)
    return base + F.when(text.contains_any_normalized(value, EVENT_STEMS), 2).otherwise(0)


def _mention(at: int):
    return lambda c, n: F.struct(F.lit(at).alias("at"), n.alias("n"), c.alias("candidate"), F.col(f"_c{at}").alias("confidence"))


def with_named_streets(rows: DataFrame) -> DataFrame:
    """Rows with ``named``: an array of (at, n, candidate, confidence) of all streets in title, description,
    _lead and _rest, in order.  Texts stay in their row; whether they tell of an event is asked once for a
    section, and only where a street is named."""
    sections = [F.col("title"), F.coalesce("description", F.lit("")), F.col("_lead"), F.col("_rest")]
    found = rows.withColumns({f"_s{i}": street_candidates(c) for i, c in enumerate(sections)})
    sure = evaluated(found, **{f"_c{i}": F.when(F.size(f"_s{i}") > 0, confidence(F.lit(s), c)) for i, (s, c) in enumerate(zip(SECTIONS, sections, strict=True))})
    each = [F.transform(f"_s{i}", _mention(i)) for i in range(len(sections))]
    return sure.withColumn("named", F.flatten(F.array(*each))).drop(*[f"_{k}{i}" for k in "sc" for i in range(len(sections))])


def first_mentions(rows: DataFrame, item: str = "id") -> DataFrame:
    """(item, candidate, confidence, prominent, pos) from ``named`` of :func:`with_named_streets`: the first
    mention of each name counts."""
    each = rows.select(item, F.inline("named"))
    first = each.withColumn("k", F.row_number().over(W.partitionBy(item, F.lower("candidate")).orderBy("at", "n"))).where("k = 1")
    return first.select(item, "candidate", "confidence", (F.col("at") < SECTIONS.index("rest")).alias("prominent"), (F.col("at") * 1000 + F.col("n")).alias("pos"))


def with_sections(items: DataFrame) -> DataFrame:
    """Items with ``_lead`` and ``_rest`` of their article_text, each worked out once a row."""
    low = evaluated(items, _low=F.lower(F.coalesce("article_text", F.lit(""))))
    body = evaluated(low, _body=text.relevant_article_text(F.col("article_text"), F.col("_low"))).drop("_low")
    front = evaluated(body, _front=text.lead_front(F.col("_body")))
    end = evaluated(front, _end=text.lead_end(F.col("_body"), F.col("_front")))
    lead, rest = text.split_at(F.col("_body"), F.col("_end"))
    return evaluated(end, _lead=lead, _rest=rest).drop("_body", "_front", "_end")


def street_evidence(items: DataFrame, item: str = "id") -> DataFrame:
    """(item, candidate, confidence, prominent, pos) from the columns title, description and article_text:
    the first mention of each name counts."""
    rows = with_sections(items.select(item, "title", "description", "article_text"))
    return first_mentions(with_named_streets(rows), item)


def validated_hits(answers: DataFrame, city: str | None) -> DataFrame:
    """Geocoder answers (candidate, pos, lat, lon, name, display_name, address, geojson) that lie in the
    city and are the street asked for; without a city all with a place are kept."""
    anchor = text.normalize_text((city or "").split(",")[0]).strip()
    a = F.col("address")
    if anchor:
        in_city = F.exists(F.array(*[a[f] for f in CITY_FIELDS]), lambda v: F.coalesce(text.squeeze_ends(text.normalize(v)) == anchor, F.lit(False)))
        street = text.street_without_number(F.col("candidate"))
        named = F.exists(F.array(F.col("name"), *[a[f] for f in STREET_FIELDS]), lambda v: text.street_matches(street, v))
        answers = answers.where(in_city & named)
    lat, lon = F.col("lat").try_cast("double"), F.col("lon").try_cast("double")
    hits = answers.select("candidate", "pos", lat.alias("lat"), lon.alias("lon"), "display_name", F.coalesce(a["suburb"], a["quarter"]).alias("suburb"), F.coalesce(a["borough"], a["city_district"]).alias("borough"), geo.geojson_paths(F.col("geojson")).alias("shape"))
    return hits.where("lat is not null and lon is not null")


def nearest_street(mentions: DataFrame, hits: DataFrame, texts: DataFrame, ref_lat: float, ref_lon: float, item: str = "id") -> DataFrame:
    """(item, meters, label, penalty, prominent, confidence): the surest, then nearest street of each item.

    ``texts``: (item, prominent_text, rest_text, district).  Of a street's hits the first in the item's
    district, or else in a suburb or borough that it names, is meant; parts of the street are the hits
    of that area, or else within five kilometres.  All mentions are looked up: the limit of 60 that a
    service with one request a second asks for has no place where the answers are a table.
    """
    kept = mentions.where(F.col("confidence") >= LEAST_CONFIDENCE)
    area = F.coalesce("suburb", "borough")
    whole = F.concat_ws("\n", F.lit(" "), "prominent_text", "rest_text", F.lit(" "))
    named = lambda c: F.coalesce(text.normalize(F.col(c)) != "", F.lit(False)) & F.coalesce(F.contains(whole, text.normalize(F.col(c))), F.lit(False))
    in_district = F.coalesce(text.normalize(F.col("borough")) == text.normalize(F.col("district")), F.lit(False)) | F.coalesce(text.normalize(F.col("suburb")) == text.normalize(F.col("district")), F.lit(False))
    rank = F.when(in_district, 0).when(named("suburb") | named("borough"), 1).otherwise(2)
    one = W.partitionBy(item, "candidate")
    # texts are only read for hits with a suburb or borough that they might name
    found = kept.drop("pos").join(hits.withColumnRenamed("pos", "hit_pos"), "candidate")
    zoned = F.col("suburb").isNotNull() | F.col("borough").isNotNull()
    given = [item, "candidate", "confidence", "prominent", "hit_pos", "lat", "lon", "display_name", area.alias("area"), "shape"]
    marked = found.where(zoned).join(texts, item).select(*given, rank.alias("rank")).unionByName(found.where(~zoned).join(texts.select(item), item, "left_semi").select(*given, F.lit(2).alias("rank")))
    picked = marked.withColumn("p", F.first(F.struct("lat", "lon", "area", "rank", "display_name")).over(one.orderBy("rank", "hit_pos").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    same = F.when(F.col("p.rank") < 2, F.col("area").eqNullSafe(F.col("p.area"))).otherwise(geo.haversine(F.col("p.lat"), F.col("p.lon"), F.col("lat"), F.col("lon")) <= geo.SAME_STREET_METERS)
    ranged = picked.where(same).withColumn("d", geo.distance_range(F.lit(ref_lat), F.lit(ref_lon), F.col("lat"), F.col("lon"), F.col("shape")))
    streets = ranged.groupBy(item, "candidate").agg(F.min("d.near").alias("meters"), F.max("d.far").alias("far"), F.first("confidence").alias("confidence"), F.first("prominent").alias("prominent"), F.min_by("display_name", F.struct("d.near", "hit_pos")).alias("name"), F.min("hit_pos").alias("at"))
    near = streets.where(F.col("meters") < geo.DROP_METERS)
    numbered = F.col("candidate") != text.street_without_number(F.col("candidate"))
    label = F.coalesce(text.short_location(F.col("name")), F.col("candidate"))
    rows = near.select(item, "meters", label.alias("label"), F.when(numbered, 0).otherwise(geo.vagueness_penalty(F.col("meters"), F.col("far"))).alias("penalty"), "prominent", "confidence", "candidate")
    return rows.withColumn("k", F.row_number().over(W.partitionBy(item).orderBy(F.desc("confidence"), "meters", "candidate"))).where("k = 1").drop("k", "candidate")
