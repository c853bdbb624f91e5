"""Routing of scored items: queued, candidate, dropped or retry, with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinity.config import FilterConfig
from vicinity.functions import terms

MAX_ATTEMPTS = 6


def too_old(published: Column, now: Column, max_age_hours: Column) -> Column:
    """Whole hours of age beyond the limit; unknown dates and limits never are."""
    return F.coalesce(F.floor((now - published) / 3600) > max_age_hours, F.lit(False))


def within_age(published: Column, now: Column, hours: int | None) -> Column:
    """The scan's own rule, exact to the second; unknown dates pass."""
    return F.lit(True) if hours is None else published.isNull() | (published >= now - hours * 3600)


def needs_article(is_filtered: Column, base_meters: Column, article: Column, link: Column) -> Column:
    return (is_filtered | base_meters.isNotNull()) & article.isNull() & link.isNotNull()


def merged_published(feed: Column, page: Column) -> Column:
    return F.least(feed, page)


def keyword_pass(prominent: Column, rest: Column, config: FilterConfig, required: list[str] | None = None) -> Column:
    """Nothing of the block list, and something of the required terms if there are any; a source's own
    list stands in for the common one, also if it is empty."""
    wanted = config.required if required is None else required
    blocked = terms.any_of(prominent, rest, config.blocklist)
    return ~blocked & (terms.any_of(prominent, rest, wanted) if wanted else F.lit(True))


def final_attempt(attempts: Column) -> Column:
    return F.coalesce(attempts, F.lit(0)) >= MAX_ATTEMPTS


def outcome(items: DataFrame, config: FilterConfig, now: Column) -> DataFrame:
    """``items`` with ``outcome`` and ``reason``.

    Columns read: published_at, max_age_hours, filter, keyword_ok, fetch_failed, geo_failed, geocoded,
    final, score.  Sources that are not filtered are always queued once they are fresh.
    """
    age = F.floor((now - F.col("published_at")) / 3600).cast("string")
    limit = F.coalesce(F.col("max_age_hours"), F.lit(config.max_age_hours).cast("bigint"))
    old = too_old(F.col("published_at"), now, limit)
    unread = F.col("fetch_failed") & ~F.col("final")
    weak = F.col("filter") & (F.col("score") < config.digest_threshold)
    retry_geo = F.col("geo_failed") & ~F.col("geocoded") & ~F.col("final")
    candidate = (F.col("score") >= config.candidate_min_score) & (F.col("score") > 0)
    steps = [
        (old, "dropped", F.concat(F.lit("published "), age, F.lit("h ago, older than "), limit.cast("string"), F.lit("h"))),
        (F.col("filter") & ~F.col("keyword_ok") & unread, "retry", F.lit("article fetch failed")),
        (F.col("filter") & ~F.col("keyword_ok"), "dropped", F.lit("keywords do not match")),
        (retry_geo, "retry", F.lit("geocoder unavailable")),
        (weak & unread, "retry", F.lit("article fetch failed")),
        (weak & candidate, "candidate", F.lit("below digest threshold")),
        (weak, "dropped", F.lit("score too low")),
    ]
    state, why = F.lit("queued"), F.lit("")
    for holds, name, reason in reversed(steps):
        state, why = F.when(holds, F.lit(name)).otherwise(state), F.when(holds, reason).otherwise(why)
    return items.withColumns({"outcome": state, "reason": why})


def poll_health(panicked: Column, sources: Column, fetched: Column, new: Column) -> Column:
    return F.when((panicked > 0) | ((sources > 0) & (fetched == 0)), "failed").when(new > 0, "ok").otherwise("idle")


def round_health(failures: DataFrame, name: str, error: str) -> DataFrame:
    """One row: ok, or the names of what failed and the first error."""
    got = failures.agg(F.sort_array(F.collect_list(F.struct(name, error))).alias("f"))
    return got.select((F.size("f") == 0).alias("ok"), F.array_join(F.transform("f", lambda x: x[name]), ", ").alias("failed"), F.get("f", F.lit(0))[error].alias("error"))


def outcome_counts(items: DataFrame, sources: DataFrame, source: str = "source_name") -> DataFrame:
    """Counts by source and outcome, zeros for sources without items."""
    counts = items.groupBy(source).agg(F.count("*").alias("total"), *[F.count_if(F.col("outcome") == o).alias(n) for o, n in (("queued", "queued"), ("candidate", "candidate"), ("dropped", "dropped"), ("retry", "retry_later"))])
    return sources.select(source).distinct().join(counts, source, "left").na.fill(0)


def reason_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("outcome", "reason").agg(F.count("*").alias("n"))
