"""The registered queries of this subpackage, over whole tables, and their SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.llm import htmltext, idplanes, matroska, minhash, mixing, packing, quality, rules, simhash, tokencount, trie, urlfilter, whitening
from vicinity.llm.common import documents, save
from vicinity.llm.tokens import default_path


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op2_matroska_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = save(matroska.media_table(documents(spark, sf_dir)), "media", "zstd")
    return matroska.media_digests(stored)


def op3_bit_plane_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idplanes.read_id_files(idplanes.write_id_files(documents(spark, sf_dir), default_path("word_bpe_49k.json")))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(documents(spark, sf_dir), default_path("byte_bpe_50k.json"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), default_path("word_bpe_49k.json"))


#: Fixed by the query: (verdict, rule).
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES, urlfilter.train(urlfilter.default_labelled()))


def held_out(key: str = "doc_id") -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return rules.judge(docs, rules.fit(docs, _labels(spark, sf_dir), only=~held_out()))


def op8_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_epoch").alias("epoch"), F.col("mix_block").alias("block"), F.col("mix_rank").alias("block_rank"))


def mix_to_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents mixed to an entropy of ``ENTROPY`` in place of a repetition limit."""
    mixed = mixing.mix(documents(spark, sf_dir), repetition=None, entropy=ENTROPY)
    return mixed.select("doc_id", "source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_epoch").alias("epoch"), F.col("mix_block").alias("block"), F.col("mix_rank").alias("block_rank"))


#: Natural logarithm: some six sources of equal weight.
ENTROPY = 1.8


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = quality.score(docs, quality.fit(docs, _labels(spark, sf_dir), only=~held_out()))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_patricia_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash_near_dedup, op2_matroska_media, op3_bit_plane_ids, op4_token_counts, op5_best_fit_packing, op6_url_filter, op7_quality_rules, op8_temperature_mixing, mix_to_entropy, op9_quality_classifier, op10_html_extraction, op11_patricia_trie, op12_minhash_near_dedup, op13_embedding_whitening)}


#: The tables that the SQL of ``op7`` learns its list from: those that it will run on.
ORACLE_DIR = "ORACLE_SF_DIR"


def op7_sql(sf_dir: str) -> str:
    """The SQL for the tables in ``sf_dir``: statistics are SQL of their own, the list is learned from
    these by the same sequential covering, and its conditions are ordered arms of one expression."""
    import hashlib
    import zlib

    import duckdb
    import numpy as np

    with duckdb.connect() as c:
        c.sql("SET enable_progress_bar = false")
        c.sql(f"CREATE VIEW labels AS SELECT * FROM '{sf_dir}/labels.parquet'")
        c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet' WHERE doc_id IN (SELECT doc_id FROM labels)")
        got = c.sql(f"WITH {rules.statistics_sql()} SELECT s.doc_id, quality, {', '.join(rules.FEATURES)} FROM stats s JOIN labels USING (doc_id) WHERE quality IN (0, 1)").fetchall()
    if len(got) > rules.MOST_LABELLED:
        raise ValueError("the bounded sample of labelled rows is not said in SQL")
    got = [r for r in got if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    held = np.array([int(hashlib.md5(f"held:{r[0]}".encode()).hexdigest()[:8], 16) % 3 == 0 for r in got], bool)
    learned = rules.learn(np.array([r[2:] for r in got], float).reshape(-1, len(rules.FEATURES)), np.array([1 - r[1] for r in got], int), held)
    return rules.judge_sql(learned)


def oracle_sql() -> dict[str, str]:
    import os

    out = {
        "op11_patricia_trie": trie.conversation_trie_sql(),
        "op12_minhash_near_dedup": minhash.near_duplicates_sql(),
        "op6_url_filter": urlfilter.judge_sql(URL_RULES, urlfilter.train(urlfilter.default_labelled())),
        "op8_temperature_mixing": mixing.mix_sql(),
        "mix_to_entropy": mixing.mix_sql(repetition=None, entropy=ENTROPY),
    }
    sf_dir = os.environ.get(ORACLE_DIR, "/root/testdata/sf0.01")
    if os.path.isdir(sf_dir):
        out["op7_quality_rules"] = op7_sql(sf_dir)
    return out
