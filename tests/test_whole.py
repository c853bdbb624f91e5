"""Queries whose rows are not all among the first ones."""

import duckdb
from oracle import rows
from pyspark.sql import functions as F

from vicinity import catalog
from vicinity.functions import streets, terms, text
from vicinity.operators import enrich, routing
from vicinity.plans import more, stores


def test_outcomes_of_all_sources_are_counted(spark, tmp_path):
    spark.range(900).select(F.col("id").alias("event_id"), (F.col("id") % 450).alias("user_id"), F.lit("click").alias("event_type")).write.parquet(f"{tmp_path}/events.parquet")
    got = {r["source_name"]: r["total"] for r in stores.outcome_counts_by_source(spark, str(tmp_path)).collect()}
    assert got == {f"user {i}": 2 for i in range(450)}


def test_the_round_asks_for_every_page(spark, sf_dir, monkeypatch):
    seen, read = [], enrich.with_pages
    monkeypatch.setattr(enrich, "with_pages", lambda items, pages, *a: seen.append(items) or read(items, pages, *a))
    got = {r["guid"] for r in more.poll_round(spark, sf_dir).select("guid").collect()}
    asked = seen[0].where(routing.needs_article(F.col("filter"), F.col("base_implied_meters"), F.col("article_text"), F.col("link"))).select("link").distinct()
    pages = {f"p{r['page_id']}" for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id").collect()}
    assert pages and pages <= {r["link"] for r in asked.collect()} and pages <= got



def test_the_sql_of_the_counts_takes_all_sources_too(spark, tmp_path):
    spark.range(900).select(F.col("id").alias("event_id"), (F.col("id") % 450).alias("user_id"), F.lit("click").alias("event_type")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        want = c.sql(catalog.oracle_sql()["outcome_counts_by_source"])
        columns, found = want.columns, want.fetchall()
    got = stores.outcome_counts_by_source(spark, str(tmp_path))
    assert len(found) == 450 and rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, found)


def test_sources_without_events_are_counted_too(spark, tmp_path):
    spark.range(30).select(F.col("id").alias("event_id"), (F.col("id") % 3 + 198).alias("user_id"), F.lit("click").alias("event_type")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        want = c.sql(catalog.oracle_sql()["outcome_counts_by_source"])
        columns, found = want.columns, want.fetchall()
    got = stores.outcome_counts_by_source(spark, str(tmp_path)).collect()
    assert {r["source_name"]: r["total"] for r in got} == {f"user {i}": 10 if i > 197 else 0 for i in range(201)}
    assert rows(list(got[0].asDict()), [tuple(r) for r in got]) == rows(columns, found)


def test_a_street_counts_after_sixty_others(spark):
    mentions = spark.range(90).select(F.lit("a").alias("id"), F.concat(F.lit("Gasse "), "id").alias("candidate"), F.lit(5).alias("confidence"), F.lit(True).alias("prominent"), F.col("id").alias("pos"))
    hits = spark.createDataFrame([("Gasse 80", 0, 0.0, 0.01, "Ferne Gasse", None, None, []), ("Gasse 89", 0, 0.0, 0.001, "Letzte Gasse", None, None, [])], "candidate string, pos int, lat double, lon double, display_name string, suburb string, borough string, shape array<array<struct<lat:double,lon:double>>>")
    texts = spark.createDataFrame([("a", "x", "", None)], "id string, prominent_text string, rest_text string, district string")
    got = streets.nearest_street(mentions, hits, texts, 0.0, 0.0).collect()
    assert [(r["id"], r["label"]) for r in got] == [("a", "Letzte Gasse")]


def test_texts_of_a_round_are_gone_through_once(spark, sf_dir):
    """What they say is saved: the plan behind it neither calls Python nor reads articles."""
    plan = more.poll_round(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "find(" not in plan and "codes(" not in plan and "article_text" not in plan


def test_sections_are_those_of_split_lead(spark):
    texts = ["", None, "kurz", "ä" * 599 + " ende", "ä" * 600 + "b c", "ä" * 601, "a" * 1200, "a" * 1199 + "ß x", "a" * 1500 + " b", "a" * 1400 + "\u00a0b", "a" * 1300 + " b" + "c d" * 300, "wort " * 400 + "Impressum weg", "Newsletter", "a" * 1190 + "😀" * 5 + " z"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, article_text string")
    lead, rest = text.split_lead(text.relevant_article_text(F.col("article_text")))
    want = {r["i"]: (r["l"], r["r"]) for r in rows.select("i", lead.alias("l"), rest.alias("r")).collect()}
    assert {r["i"]: (r["_lead"], r["_rest"]) for r in streets.with_sections(rows).collect()} == want


def test_few_terms_are_those_of_the_index():
    index = terms.TermIndex(["ort", "--foo", "alte post", "hof", "a-bcd", "(x", "größe"], place=True)
    for value in ("ort", "orte", "der ort-park", "x--foobar", " --foobar", "alte postille", "a-bcde", "(xy", "(x", "grösse größen", "hof-laden", "", None):
        assert index.mentioned(value) == index.found(value)
    assert index.found(" --foobar") == {1}


def test_capitals_that_are_not_ascii_name_streets():
    assert streets.candidates("an der Ölbergstraße, im „Ärztering“ und Über Allee/ÄUSSERER RING 5 bring ring") == ["Ölbergstraße", "Ärztering", "ÄUSSERER RING 5"]
