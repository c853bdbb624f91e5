"""Queries over similar reports: pairs, clusters, promotion, repeats, chunks, rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.catalog import query
from vicinity.functions import text
from vicinity.functions.shared import keep
from vicinity.operators import digest, similarity
from vicinity.plans.items import SIGNIFICANT_SQL, TITLE_SQL, items

_S = "doc_id % 5 + 1"
_D = "(doc_id * 37 % 4000)::DOUBLE"


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reports with made-up links, scores and places."""
    n = F.col("doc_id")
    return items(spark, sf_dir).select(
        n.alias("id"), n.alias("rank"), "title", F.concat(F.lit("https://www.example.org/s/"), (n % 400).cast("string"), F.lit("?utm_source=x")).alias("link"), "source_name", F.lit(None).cast("string").alias("link_note"),
        F.concat(F.lit("Quarter "), (n % 50).cast("string")).alias("location_label"), (n * 37 % 4000).cast("double").alias("distance_meters"),
        (n % 5 + 1).cast("int").alias("score"), F.lit(5).alias("max_score"), F.when(n % 3 == 0, "queued").otherwise("candidate").alias("state"),
    )


_REPORTS = f"""WITH RECURSIVE items AS (SELECT doc_id, source AS source_name, {TITLE_SQL} AS title FROM documents),
 r AS (SELECT doc_id AS id, title, source_name, doc_id % 400 AS link, doc_id % 50 AS place, {_D} AS d, ({_S})::INTEGER AS score, CASE WHEN doc_id % 3 = 0 THEN 'queued' ELSE 'candidate' END AS state,
       list_sort(list_distinct({SIGNIFICANT_SQL})) AS words FROM items),
 w AS (SELECT id, unnest(words) AS word FROM r),
 shared AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM w a JOIN w b ON a.word = b.word AND a.id > b.id GROUP BY ALL),
 titled AS (SELECT s.a, s.b, n, least(len(x.words), len(y.words)) AS m, x.place = y.place OR abs(x.d - y.d) <= 300 AS near FROM shared s JOIN r x ON x.id = s.a JOIN r y ON y.id = s.b),
 e AS (SELECT a, b FROM titled WHERE (n >= 3 AND 3 * n >= 2 * m) OR (n >= 2 AND 2 * n >= m AND near) UNION SELECT x.id, y.id FROM r x JOIN r y ON x.link = y.link AND x.id > y.id)"""
_CLUSTERS = _REPORTS + """,
 reach(id, root) AS (SELECT id, id FROM r WHERE id NOT IN (SELECT a FROM e) UNION SELECT e.a, reach.root FROM reach JOIN e ON e.b = reach.id),
 c AS (SELECT id, min(root) AS cluster FROM reach GROUP BY id)"""


@query(_REPORTS + " SELECT a, b FROM e")
def title_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.edges(reports(spark, sf_dir)).select("a", "b")


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keep(reports(spark, sf_dir), "reports")
    return rows.join(similarity.clusters(rows).select("id", "cluster"), "id")


@query(_CLUSTERS + " SELECT id, cluster FROM c")
def cluster_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.clusters(keep(reports(spark, sf_dir), "reports")).select("id", "cluster")


_MERGED = _CLUSTERS + """, named AS (SELECT cluster, lower(source_name) AS k, arg_min(source_name, id) AS name, min(id) AS first FROM r JOIN c USING (id) GROUP BY ALL),
 names AS (SELECT cluster, string_agg(name, ' + ' ORDER BY first) AS source_name, count(*)::INTEGER AS source_count FROM named GROUP BY cluster),
 merged AS (SELECT cluster, string_agg(id::VARCHAR, ',' ORDER BY id) AS guids, arg_min(title, id) AS title, arg_min(d, id) AS d, arg_min(place, id) AS place, arg_min(link, id) AS link, max(score) AS best FROM r JOIN c USING (id) GROUP BY cluster),
 entries AS (SELECT m.*, source_name, source_count, (CASE WHEN source_count > 1 THEN least(best + 1, 5) ELSE best END)::INTEGER AS score FROM merged m JOIN names USING (cluster))"""


@query(_MERGED + " SELECT cluster, guids, source_name, source_count, title, score, round(d)::BIGINT AS distance FROM entries")
def cluster_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = digest.merge(clustered(spark, sf_dir))
    return e.select("cluster", F.array_join(F.transform("guids", lambda g: g.cast("string")), ",").alias("guids"), "source_name", "source_count", "title", "score", F.round("distance_meters").cast("long").alias("distance"))


@query(_MERGED + " SELECT id FROM r JOIN c USING (id) JOIN entries x USING (cluster) WHERE r.state = 'candidate' AND source_count >= 2 AND x.score >= 4")
def promote_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.promoted(clustered(spark, sf_dir), 4, 2)


@query(_REPORTS.replace("a.id > b.id", "a.id <> b.id").replace("x.id > y.id", "x.id <> y.id").replace("OR (n >= 2 AND 2 * n >= m AND near)", "") + " SELECT id, EXISTS (SELECT 1 FROM e WHERE e.a = r.id AND e.b % 10 = 0) AS repeated FROM r WHERE id % 10 <> 0")
def split_already_posted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keep(reports(spark, sf_dir), "reports")
    fresh, repeats = similarity.split_posted(rows.where("id % 10 <> 0"), rows.where("id % 10 = 0"))
    return fresh.select("id", F.lit(False).alias("repeated")).unionByName(repeats.select("id", F.lit(True).alias("repeated")))


_ENTRIES = f"""WITH RECURSIVE items AS (SELECT doc_id, source AS source_name, {TITLE_SQL} AS title FROM documents),
 e AS (SELECT doc_id, title, source_name, 'https://www.example.org/s/' || doc_id % 400 AS link, ({_S})::INTEGER AS score, (doc_id % 3 + 1)::INTEGER AS source_count, doc_id % 20 AS digest, {_D} AS d, CASE WHEN doc_id % 4 > 0 THEN 'Quarter ' || doc_id % 50 END AS label FROM items),
 p AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY score DESC, doc_id) AS place, octet_length(encode(title)) + octet_length(encode(source_name)) + octet_length(encode(link)) + source_count * 8 + 50 AS bytes FROM e),
 f AS (SELECT digest, place, doc_id, 0 AS chunk, bytes AS used, 1 AS n FROM p WHERE place = 1
   UNION ALL SELECT p.digest, p.place, p.doc_id, CASE WHEN f.used + p.bytes > 8000 OR f.n >= 15 THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.used + p.bytes > 8000 OR f.n >= 15 THEN p.bytes ELSE f.used + p.bytes END, CASE WHEN f.used + p.bytes > 8000 OR f.n >= 15 THEN 1 ELSE f.n + 1 END
   FROM f JOIN p ON p.digest = f.digest AND p.place = f.place + 1)"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    return items(spark, sf_dir).select(
        "doc_id", "title", "source_name", F.concat(F.lit("https://www.example.org/s/"), (n % 400).cast("string")).alias("link"), F.lit(None).cast("string").alias("link_note"), (n % 5 + 1).cast("int").alias("score"), F.lit(5).alias("max_score"),
        (n % 3 + 1).cast("int").alias("source_count"), (n % 20).alias("digest"), (n * 37 % 4000).cast("double").alias("distance_meters"), F.when(n % 4 > 0, F.concat(F.lit("Quarter "), (n % 50).cast("string"))).alias("location_label"),
    )


@query(_ENTRIES + " SELECT doc_id, digest, chunk FROM f")
def chunk_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.chunks(entries(spark, sf_dir), [F.desc("score"), F.asc("doc_id")], ["digest"]).select("doc_id", "digest", "chunk")


@query(_ENTRIES + """ SELECT doc_id, (['⚪', '🔵', '🟢', '🟡', '🟠', '🔴'])[score + 1] || ' ' || title || chr(10) || '📰 ' || source_name || ' · ⭐ ' || score || '/5' || CASE WHEN source_count > 1 THEN ' · 👥 ' || source_count || ' sources' ELSE '' END
   || chr(10) || '📍 ' || CASE WHEN d < 1000 THEN '~' || d::BIGINT || 'm' ELSE '~' || round_even(d / 1000, 1)::DECIMAL(18,1) || 'km' END || coalesce(' · ' || label, '') || chr(10) || '🔗 ' || link AS plain FROM e""")
def format_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.render(entries(spark, sf_dir), F.lit("Digest")).select("doc_id", "plain")


CANONICAL_SQL = """(SELECT base || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(kept, '&') END FROM (SELECT lower(regexp_replace(regexp_replace(split_part(cut, '?', 1), '^(https://)*(http://)*(www\\.)*', ''), '/+$', '')) AS base,
   list_filter(string_split(CASE WHEN contains(cut, '?') THEN substr(cut, strpos(cut, '?') + 1) ELSE '' END, '&'), lambda p: p <> '' AND NOT (lower(split_part(p, '=', 1)) LIKE 'utm\\_%' ESCAPE '\\' OR lower(split_part(p, '=', 1)) LIKE 'at\\_%' ESCAPE '\\' OR lower(split_part(p, '=', 1)) IN ('fbclid', 'gclid', 'ref', 'source', 'wt_mc'))) AS kept))"""


@query(f"WITH cuts AS (SELECT page_id, split_part(trim(url), '#', 1) AS cut FROM pages) SELECT page_id, {CANONICAL_SQL} AS link FROM cuts")
def canonical_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", text.canonical_link(F.col("url")).alias("link"))


@query(f"WITH cuts AS (SELECT page_id, split_part(trim(url), '#', 1) AS cut FROM pages), l AS (SELECT page_id, {CANONICAL_SQL} AS link FROM cuts) SELECT link, count(*) AS n, min(page_id) AS first_page FROM l GROUP BY link HAVING count(*) > 1")
def same_link_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", text.canonical_link(F.col("url")).alias("link"))
    return links.groupBy("link").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page")).where("n > 1")
