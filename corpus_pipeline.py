"""A pipeline over the documents table: rules, classifier, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept; all but the
last return the columns of ``documents``.  The rules and the classifier learn from the labels in
``sf_dir`` joined to the documents they are given.

All stages: null texts count as empty; rows without a doc_id are worked on like others and never
labelled; repeated rows are judged, linked, mixed and packed each; columns that have the names of columns
in use inside are kept; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.llm import mixing, packing, quality, rules, similar
from vicinity.llm.common import documents, new_path
from vicinity.llm.tokens import default_path


def _learned_from() -> Column:
    """Labelled rows that may be learned from; the others measure what has been learned."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: by the base rule (empty and very short texts are among them) or by the first
    rule of the learned list that holds.  Repeated rows go or stay together."""
    return rules.keep(docs, rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), only=_learned_from()))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold go, a score equal to it stays; none goes if there was no
    labelled row to learn from.  Equal texts have equal scores."""
    return quality.keep(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), only=_learned_from()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id (rows without one come last, and of
    rows with equal ids one): similarity 0.8 or more in five-word shingles, whole texts.  All empty texts
    are one group.  Texts with too few shingles in any other text are set aside first; candidates among the
    rest come from a multi-index SimHash (48 segments of 32 bits, balls of two bits) and from nothing else;
    each link is checked on whole sets."""
    return similar.drop_similar(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; those of small sources are repeated as the weights ask, so rows of the result
    may be equal.  A null source is one source; rows with equal ids and texts are repeated together."""
    return mixing.mix(docs).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of at most 4096; only longer documents are cut, an empty
    text is its end id alone.  Ties between equal lengths go by id, piece and ids."""
    return packing.pack_documents(docs, default_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the classifier nor the tokenizer; tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage is written to the shared folder and read again as the next one's documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
