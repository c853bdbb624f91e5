"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has 64 bits, each set if it is set in over half of the XXH64 values of the
text's word shingles.  Texts are linked if their fingerprints differ in few bits.  The fingerprint
is cut into two 32-bit segments: if two fingerprints differ in three bits or fewer, they differ in
one bit or none in at least one of the segments.  So each fingerprint looks up, for both segments,
the segment itself and the segments one bit away, and the whole fingerprints of what it finds are
compared.  Every pair one bit apart is looked up from the side that has the bit at 0 only.

Segment values that very many fingerprints share (large groups of near copies) are compared in
blocks of bounded size instead, and each block gives its components rather than its pairs.  So no
link is lost, and no group is emitted as all its pairs.

Nulls count as empty texts; an empty text has fingerprint 0 and is linked like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from vicinity.llm.common import bounded_batches, fresh, save
from vicinity.llm.components import components, forest

BITS_APART = 3
SEED = 42
#: Segment values with more fingerprints than this are compared in blocks.
DENSE = 256
#: Fingerprints on either side of a block.
BLOCK = 4096

_LANES = np.uint64(0x0101010101010101)
_SHIFTS = np.arange(8, dtype=np.uint64)
_RUN = 1 << 16


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set; entry 8 * byte + bit."""
    starts, total = np.arange(0, len(hashes), 255), np.zeros((8, 8), np.int64)
    for k in range(8):  # eight byte-wide counters a word, emptied before they overflow
        lanes = np.add.reduceat((hashes >> _SHIFTS[k]) & _LANES, starts)
        total[:, k] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return total.reshape(64)


def fingerprint(text: str | None, words_each: int = 3) -> int:
    """The fingerprint of a text as a signed 64-bit integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    if len(words) <= words_each:
        shingles, n = iter([b" ".join(words)]), 1
    else:
        shingles, n = map(b" ".join, zip(*(words[i:] for i in range(words_each)), strict=False)), len(words) - words_each + 1
    counts, hashes = np.zeros(64, np.int64), map(xxh64_intdigest, shingles, repeat(SEED))
    for at in range(0, n, _RUN):
        counts += _bit_counts(np.fromiter(hashes, np.uint64, min(_RUN, n - at)))
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprint_of(hashes: np.ndarray) -> int:
    """The fingerprint of shingles whose hashes are at hand, as a signed 64-bit integer."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _RUN):
        counts += _bit_counts(hashes[at : at + _RUN])
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint_column(text: str, words_each: int = 3):
    """A column with the fingerprint of the string column ``text``."""

    bounded_batches(SparkSession.getActiveSession())

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(x, words_each) for x in texts], dtype="int64")

    return prints(F.col(text))


def _segments(prints: DataFrame) -> DataFrame:
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(0xFFFFFFFF)
    return prints.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("seg"), high.alias("key")), F.struct(F.lit(1).alias("seg"), low.alias("key")))).alias("s")).select("fp", "s.seg", "s.key")


def _compare(group: pd.DataFrame) -> pd.DataFrame:
    """Star links among the fingerprints of one block: stored ones against those looking them up."""
    stored = np.unique(group.loc[group["role"] == 0, "fp"].to_numpy(np.int64))
    asking = np.unique(group.loc[group["role"] == 1, "fp"].to_numpy(np.int64))
    a = b = np.empty(0, np.int64)
    for at in range(0, len(asking), 512):
        rows = asking[at : at + 512]
        i, j = np.nonzero(np.bitwise_count((rows[:, None] ^ stored[None, :]).view(np.uint64)) <= BITS_APART)
        a, b = forest(np.concatenate([a, rows[i]]), np.concatenate([b, stored[j]]))
    return pd.DataFrame({"a": a, "b": b})


def links(prints: DataFrame, dense: int = DENSE, block: int = BLOCK) -> DataFrame:
    """(a, b): links whose components are those of all pairs of ``prints.fp`` (distinct longs) that
    differ in three bits or fewer.  Pairs themselves outside dense segments, stars within them."""
    stored = _segments(prints)
    flips = F.expr("transform(filter(sequence(0, 31), i -> (shiftright(key, i) & 1) = 0), i -> key + shiftleft(1L, i))")
    asking = stored.select("fp", "seg", F.col("key").alias("own"), F.explode(F.concat(F.array("key"), flips)).alias("key"))
    counts = stored.groupBy("seg", "key").agg(F.count("*").alias("n"))
    crowded = save(counts.where(F.col("n") > dense), "crowded")
    near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= BITS_APART
    once = (F.col("x.own") != F.col("x.key")) | (F.col("x.fp") < F.col("y.fp"))
    sparse = stored.join(crowded, ["seg", "key"], "left_anti")
    plain = asking.alias("x").join(sparse.alias("y"), (F.col("x.seg") == F.col("y.seg")) & (F.col("x.key") == F.col("y.key")) & near & once).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    if crowded.isEmpty():
        return plain
    # blocks: stored ones are dealt to ceil(n / block) parts, asking ones likewise; each part meets each
    held = stored.join(crowded, ["seg", "key"])
    heard = asking.join(crowded, ["seg", "key"])
    asked = save(heard.groupBy("seg", "key", "n").agg(F.count("*").alias("m")), "asked")
    parts = asked.select("seg", "key", F.ceil(F.col("n") / block).cast("int").alias("p"), F.ceil(F.col("m") / block).cast("int").alias("q"))

    def dealt(rows: DataFrame, own: str, other: str, role: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("fp"), F.col(own)).cast("int")
        return rows.select("fp", "seg", "key").join(parts, ["seg", "key"]).select("fp", "seg", "key", mine.alias(own), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other), F.lit(role).alias("role")).select("fp", "seg", "key", "p", "q", "role")

    blocks = dealt(held, "p", "q", 0).unionByName(dealt(heard, "q", "p", 1)).groupBy("seg", "key", "p", "q").applyInPandas(_compare, "a long, b long")
    return plain.unionByName(blocks)


def _classes(prints: DataFrame, first) -> DataFrame:
    """(fp, first): for each fingerprint the least ``first`` of its component."""
    nodes = save(prints.groupBy("fp").agg(F.min(first).alias("first")), "nodes")
    roots = components(save(links(nodes.select("fp")), "links"), "a", "b")
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    linked = rooted.join(roots.select("root").distinct(), "root", "left_semi")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    return rooted.join(least, "root", "left").select("fp", F.coalesce("least", "first").alias("first"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words_each: int = 3) -> DataFrame:
    """(key, fingerprint, component_id) for each row of ``docs``.

    component_id: the smallest non-null key of the component (null if it has none).  Repeated keys
    give a row each; other columns are ignored, whatever their names.
    """
    prints = save(docs.select(F.col(key).alias("id"), F.col(text).alias("body")).select("id", fingerprint_column("body", words_each).alias("fp")), "prints")
    classes = _classes(prints, F.col("id"))
    return prints.join(classes, "fp").select(F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words_each: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns, one of each component: that with the smallest key (rows
    without one come last), and of several such rows one."""
    uid, fp = fresh(docs, "uid", "fp")
    kept = save(docs.withColumn(uid, F.monotonically_increasing_id()).withColumn(fp, fingerprint_column(text, words_each)), "kept")
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col(uid).alias("uid"))
    classes = _classes(kept.select(F.col(fp).alias("fp"), order.alias("order")), F.col("order"))
    firsts = classes.select(F.col("first.uid").alias(uid)).distinct()
    return kept.join(firsts, uid, "left_semi").drop(uid, fp)
