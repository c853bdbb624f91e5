"""A poll round as one plan: new items, their pages, evidence of all kinds, score and outcome."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinity.config import FilterConfig
from vicinity.functions import dates, markup, streets, terms, text
from vicinity.functions.shared import evaluated, keep
from vicinity.operators import evidence, routing, store


def with_sources(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Items with their source's settings; the table of sources is configuration, a row each.  Items of
    an unknown or null source stay: they are filtered, under the common limits."""
    own = sources.select(F.col("name").alias("source_name"), "max_age_hours", "filter", "base_implied_meters", "required")
    return items.join(F.broadcast(own), "source_name", "left").withColumn("filter", F.coalesce("filter", F.lit(True)))


def own_terms_pass(required: Column, prominent: Column, rest: Column, sources: DataFrame) -> Column:
    """Whether a source's own list is empty or one of its terms is mentioned, as keywords are.  Terms come
    from the table of sources, which is configuration; all are looked up at once."""
    listed = sorted(r[0] for r in sources.select(F.explode("required")).distinct().collect() if r[0] is not None)
    table = F.from_json(F.lit(json.dumps(listed)), "array<string>")
    named = F.transform(terms.found_in(prominent, rest, listed), lambda c: F.get(table, F.floor(c / 2).cast("int")))
    return (F.size(required) == 0) | F.coalesce(F.arrays_overlap(required, named), F.lit(False))


def with_pages(items: DataFrame, pages: DataFrame, zone: str = "UTC") -> DataFrame:
    """Items with what their pages (url, html) give; ``fetch_failed`` where a page was needed and gave
    no text.  The feed's own coordinates and district come first, the older date counts."""
    wanted = routing.needs_article(F.col("filter"), F.col("base_implied_meters"), F.col("article_text"), F.col("link"))
    asked = items.withColumn("_asked", wanted)
    found = pages.select(F.col("url").alias("link"), "html").join(asked.where("_asked").select("link").distinct(), "link", "left_semi")
    read = found.groupBy("link").agg(F.min_by("html", F.xxhash64("html")).alias("html"))  # of several pages of a link always the same
    parsed = read.select("link", markup.page_columns(F.col("html")).alias("_page"), markup.article_link_column(F.col("link"), F.col("html")).alias("_link"))
    got = asked.where("_asked").join(parsed, "link", "left")
    rest = asked.where("not _asked")  # these, many without a link, meet nothing and stay where they are
    both = got.unionByName(rest.select("*", *[F.lit(None).cast(got.schema[c].dataType).alias(c) for c in ("_page", "_link")])).withColumn("_got", F.col("_asked") & F.col("_page.text").isNotNull())
    page = lambda n: F.when(F.col("_got"), F.col(f"_page.{n}"))
    moved = both.withColumns({
        "fetch_failed": F.col("_asked") & ~F.coalesce("_got", F.lit(False)), "article_text": F.coalesce("article_text", page("text")), "lat": F.coalesce("lat", page("lat")), "lon": F.coalesce("lon", page("lon")),
        "venue": page("address"), "district": F.coalesce("district", page("district")), "published_at": routing.merged_published(F.col("published_at"), dates.parse_page_date(page("published"), zone)),
        "link_note": F.when(F.col("_got"), markup.link_note(F.col("link"), F.col("_link"), F.col("_page.text"), F.col("title"))),
    })
    return moved.withColumn("link", F.when(F.col("_got"), F.coalesce("_link", "link")).otherwise(F.col("link"))).drop("_asked", "_got", "_page", "_link")


def with_street(items: DataFrame, hits: DataFrame, failed: DataFrame, lat: float, lon: float) -> DataFrame:
    """Items (guid, named, venues, prominent, rest, district, …) with ``geocoded`` evidence, or null, and
    ``geo_failed``: a candidate's lookup failed for now and no other gave a street.  ``named``: as of
    :func:`streets.with_named_streets`; ``venues``: streets of the venue; ``hits``: validated answers;
    ``failed``: (candidate) of lookups to try again."""
    keyed = items.withColumn("id", F.col("guid"))
    venue = keyed.select("id", F.explode("venues").alias("candidate"), F.lit(streets.VENUE_CONFIDENCE).alias("confidence"), F.lit(True).alias("prominent"), F.lit(-1).alias("pos"))
    mentions = venue.unionByName(streets.first_mentions(keyed))
    texts = keyed.select("id", F.col("prominent").alias("prominent_text"), F.col("rest").alias("rest_text"), "district")
    found = streets.nearest_street(mentions, hits, texts, lat, lon).select(F.col("id").alias("guid"), evidence.evidence(F.col("meters"), F.col("label"), evidence.GEOCODED, F.col("prominent"), F.col("penalty"), 2000).alias("geocoded"))
    missed = mentions.where(F.col("confidence") >= streets.LEAST_CONFIDENCE).join(failed.select("candidate"), "candidate", "left_semi").select(F.col("id").alias("guid")).distinct().withColumn("_missed", F.lit(True))
    both = items.join(found, "guid", "left").join(missed, "guid", "left")
    return both.withColumn("geo_failed", F.coalesce("_missed", F.lit(False)) & F.col("geocoded").isNull()).drop("_missed")


def with_findings(items: DataFrame, sources: DataFrame, config: FilterConfig, ref: tuple[float, float]) -> DataFrame:
    """Items with all that their texts say, in one pass without a shuffle: ``_area`` and ``_named``
    evidence, ``_away``, ``keyword_ok``, and ``named`` and ``venues`` for :func:`with_street`.
    ``prominent`` and ``rest`` stay where a street may be looked up, and are null elsewhere."""
    cut = streets.with_sections(items)
    up = text.normalize(F.concat("title", F.lit(" "), F.coalesce("description", F.lit("")), F.lit(" "), "_lead"))
    worded = evaluated(cut, prominent=up, rest=text.normalize(F.col("_rest")))
    p, r = F.col("prominent"), F.col("rest")
    own = own_terms_pass(F.col("required"), p, r, sources)
    read = streets.with_named_streets(worded).withColumns({
        "_area": F.when(F.col("filter"), evidence.area_evidence(p, r, config.area)).otherwise(F.array().cast(f"array<{evidence.EVIDENCE}>")),
        "_named": evidence.place_evidence(p, r, config.places, *ref),
        "_away": evidence.located_elsewhere(F.col("title"), F.col("district"), config).isNotNull(),
        "keyword_ok": F.when(F.col("required").isNull(), routing.keyword_pass(p, r, config)).otherwise(own & ~terms.any_of(p, r, config.blocklist)),
        "venues": streets.street_candidates("venue"),
    })
    asked = (F.size("venues") > 0) | F.exists("named", lambda m: m["confidence"] >= streets.LEAST_CONFIDENCE)
    return read.withColumns({"prominent": F.when(asked, p), "rest": F.when(asked, r)}).drop("_lead", "_rest")


def poll_round(items: DataFrame, stored: DataFrame, retries: DataFrame, sources: DataFrame, pages: DataFrame, hits: DataFrame, failed: DataFrame, config: FilterConfig, ref: tuple[float, float], now: int, articles: bool = True) -> DataFrame:
    """New items with score, outcome and reason.

    ``items``: guid, title, link, description, article_text, source_name, published_at, lat, lon,
    district.  Items seen before go first, so nothing is read or matched for them.  Texts are dealt by guid
    once and gone through once; what they say is saved, and joins after that have no texts.  Without
    ``articles`` the result has no article_text, which is then not saved either.
    """
    fresh = store.unseen(items.repartition("guid"), stored)
    counted = fresh.join(retries.select("guid", "attempts"), "guid", "left").withColumn("final", routing.final_attempt(F.col("attempts"))).drop("attempts")
    read = with_pages(with_sources(counted, sources), pages)
    found = with_findings(read, sources, config, ref)
    saved = keep(found if articles else found.drop("article_text"), "round")
    placed = with_street(saved, hits, failed, *ref)
    filed = evidence.coordinate_evidence(F.col("lat"), F.col("lon"), F.col("venue"), *ref)
    geocoded = F.filter(F.array("geocoded"), lambda e: e.isNotNull())
    every = F.concat("_area", evidence.source_evidence(F.col("base_implied_meters")), geocoded, filed, "_named")
    scored = placed.withColumn("top", evidence.best(evidence.penalise(every, F.col("_away"))))
    ready = scored.select("*", *evidence.final_columns(F.col("top"))).withColumn("geocoded", F.col("geocoded").isNotNull())
    return routing.outcome(ready, config, F.lit(now)).drop("top", "prominent", "rest", "named", "venues", "_area", "_named", "_away")
