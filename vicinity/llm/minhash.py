"""MinHash near-duplicates: many universal hash minima, bands, signatures, exact sets, alternating stars.

A text's set are its distinct shingles of four words, as 64-bit hashes.  ``BANDS * ROWS`` universal hash
functions, a * x + b modulo 2^64 with odd a, give a minimum each.  Sets whose minima agree in all rows of
a band are candidates: a pair at 0.8 shares none of the 32 bands with a probability of 5e-8, a closer pair
with less.  Two bits of each minimum are the signature: candidates are verified by it within the join (one
at 0.8 has over ``APART`` of 128 places unlike with a probability of some 1e-6), then by a longer one
where a bucket still has texts of several groups, and each link is confirmed on the full sets.

Equal sets are one node, named by 128 bits, so a group of copies has no pairs; buckets of near copies are
compared with hubs first (see :mod:`vicinity.llm.buckets`).  Components come from large-star and
small-star steps (see :mod:`vicinity.llm.components`).

Nulls count as empty texts.  A text without words has an empty set and is linked with nothing, not even
with another one; one of fewer words than a shingle is one shingle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinity.llm import buckets
from vicinity.llm.common import bounded_batches, discard_saved, look_up, own_names, save, shingles

WORDS = 4
SEED = 42
BANDS, ROWS = 32, 4
#: Places of 128 in which the signatures of a pair may differ.
APART = 40
#: Bits of the longer signature, and how many of a pair's may differ.
FINE, FINE_APART = 2048, 270

_rng = np.random.default_rng(SEED)
_A, _B = (_rng.integers(0, 2**64, BANDS * ROWS, np.uint64) for _ in "ab")
_FINE_A, _FINE_B = (_rng.integers(0, 2**64, FINE, np.uint64) for _ in "ab")
_ODD = np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_RUN = 1 << 18


def minima(hashes: np.ndarray, a: np.ndarray = _A, b: np.ndarray = _B) -> np.ndarray:
    """The least value of a set under each function."""
    least, run = np.full(len(a), np.iinfo(np.uint64).max, np.uint64), max(1, _RUN // len(a))
    for at in range(0, len(hashes), run):
        np.minimum(least, (hashes[at : at + run, None] * (a | _ODD) + b).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit value for each band of the minima, the number of the band in it."""
    rows, out = least.reshape(BANDS, ROWS), np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = (out ^ rows[:, k]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def signature(least: np.ndarray) -> np.ndarray:
    """Two bits of each minimum, as four 64-bit words: first bits, then second ones."""
    mixed = least * _MIX  # high bits of a minimum are mostly zero
    return np.concatenate([np.packbits((mixed >> np.uint64(k)).astype(np.uint8) & 1).view(np.uint64) for k in (40, 41)])


def longer(hashes: np.ndarray) -> np.ndarray:
    """``FINE`` bits, one of each of as many minima, in 64-bit words."""
    mixed = minima(hashes, _FINE_A, _FINE_B) * _MIX
    return np.packbits((mixed >> np.uint64(40)).astype(np.uint8) & 1).view(np.int64)


def _signed(words_each: int):
    bounded_batches(SparkSession.getActiveSession())

    @F.pandas_udf("name binary, n long, keys array<long>, words array<long>")
    def signed(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for x in texts:
            s = shingles(x, words_each)
            least = minima(s)
            rows.append((hashlib.md5(s.tobytes()).digest(), len(s), band_keys(least).view(np.int64), signature(least).view(np.int64)))
        return pd.DataFrame(rows, columns=["name", "n", "keys", "words"])

    return signed


def set_of(words_each: int):
    """A column function: the shingles of a text as 64-bit numbers in a row of bytes."""

    @F.pandas_udf(T.BinaryType())
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(x, words_each).tobytes() for x in texts], dtype=object)

    return made


@F.pandas_udf(T.ArrayType(T.LongType()))
def _longer(sets: pd.Series) -> pd.Series:
    return pd.Series([longer(np.frombuffer(x, np.uint64)) for x in sets], dtype=object)


def _unlike_places() -> Column:
    """Places in which two signatures differ in one of their two bits."""
    pair = lambda i: F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"hs{i}")).bitwiseOR(F.col(f"s{i + 2}").bitwiseXOR(F.col(f"hs{i + 2}"))))
    return pair(0) + pair(1)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words_each: int = WORDS) -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row of ``docs``.

    component_id: the smallest non-null key of the component (null if it has none); ``kept``: whether it
    is the row's own.  Rows without a key are linked like others and never kept.  Repeated rows give a row
    each; an empty table gives none; other columns are ignored, whatever their names."""
    own_names(key, "n_shingles", "component_id", "kept")
    rows = save(docs.select(F.col(key).alias("key"), F.col(text).alias("body")).withColumn("s", _signed(words_each)("body")).withColumn("uid", F.monotonically_increasing_id()), "signed", "zstd")
    full = rows.where("s.n > 0")
    nodes = save(
        full.groupBy(F.col("s.name").alias("name")).agg(F.min("key").alias("first"), F.count("*").alias("copies"), F.min("uid").alias("uid"), F.first("s.n").alias("n"), F.first("s.keys").alias("keys"), F.first("s.words").alias("words")).withColumn("id", F.monotonically_increasing_id()),
        "nodes",
    )
    words = [f"s{i}" for i in range(4)]
    members = buckets.sharing(nodes.select(F.explode("keys").alias("key"), "id"), nodes.select("id", "n", *[F.get("words", F.lit(i)).alias(w) for i, w in enumerate(words)]))
    firsts = nodes.select("id", "name", "copies", F.col("first").alias("least"))
    if not members.isEmpty():
        asked = members.select("id").distinct().join(nodes.select("id", "uid"), "id")
        sets = save(rows.select("uid", "body").join(asked, "uid").select("id", set_of(words_each)("body").alias("set")), "sets")

        def refine(keys: DataFrame) -> tuple[DataFrame, Column]:
            apart = F.aggregate(F.zip_with("fine", "hfine", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
            return keys.join(sets, "id").select("id", "keys", _longer("set").alias("fine")), apart <= FINE_APART

        none = nodes.select(F.col("id").alias("a"), F.col("id").alias("b")).where("false")
        found = buckets.links(members, words, _unlike_places() <= APART, sets, none, refine)
        linked = save(buckets.rooted(firsts.select("id", "name", "copies", "least"), found), "linked")
        discard_saved(sets)
        least = linked.groupBy("root").agg(F.min("least").alias("least"))
        firsts = linked.drop("least").join(least, "root")
    table = save(firsts.select("name", "copies", "least"), "named")
    discard_saved(nodes)
    got = look_up(rows.select("key", "uid", F.col("s.n").alias("n"), F.when(F.col("s.n") > 0, F.col("s.name")).alias("name")), table, "name", "copies", ["uid"])
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("key"))
    return got.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"))


def near_duplicates_sql() -> str:
    """The same rows from the exact similarity of all pairs that share a shingle."""
    return f"""
WITH RECURSIVE t AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - {WORDS - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))) END AS g FROM t
), e AS MATERIALIZED (SELECT rid, len(g) AS n, unnest(g) AS x FROM s),
l AS MATERIALIZED (
  SELECT a.rid AS a, b.rid AS b FROM e AS a JOIN e AS b ON a.x = b.x AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
  GROUP BY a.rid, b.rid, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), r(rid, peer) AS (SELECT rid, rid FROM s UNION SELECT r.rid, l.b FROM r JOIN l ON l.a = r.peer),
c AS (SELECT r.rid, min(s.doc_id) AS component_id FROM r JOIN s ON s.rid = r.peer GROUP BY r.rid)
SELECT doc_id, len(g)::BIGINT AS n_shingles, component_id, coalesce(doc_id = component_id, false) AS kept FROM s JOIN c USING (rid)"""
