"""Links among the ids that share a bucket, without all pairs of a bucket.

A bucket is a key that several ids have, with a sketch each.  Pairs of a bucket are compared by sketch
within the join, and those that pass are checked exactly.  Pairs within a group that is linked already say
nothing new: so each bucket first compares its ids with a few hubs of it, twice, and contracts what has
been linked; only buckets with several roots left are compared pair by pair, without pairs of one root.
Large buckets are dealt over tasks, ``PART`` ids in each, for the hubs as for the rest.

Nothing is cut off: the links that come out have the components of all pairs that share a bucket, are
close by sketch and pass the check.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinity.llm.common import discard_saved, release, save, small
from vicinity.llm.components import components

#: Ids of a bucket that all others are compared with, in each of two turns.
HUBS = 2
#: Ids of a bucket that one task compares with others of it.
PART = 1024
#: Turns in which pairs are checked, and pairs that are worth a turn of their own.
TURNS, PAIRS_EACH = 6, 1 << 14


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a similarity of 0.8 or more, in whole numbers."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 9 * shared >= 4 * (len(a) + len(b))


@F.pandas_udf(T.BooleanType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b, strict=True)], dtype=bool)


def checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ``sets`` (id, set) have a similarity of 0.8 or more, saved.

    Pairs are checked in up to ``TURNS`` turns, by ``a``, and what a turn has shuffled is released before the
    next: sets are large, and shuffles of all at once would be several times their size on disk."""
    pairs = save(pairs, "pairs")
    release(pairs.sparkSession)
    turns, out = min(TURNS, 1 + pairs.count() // PAIRS_EACH), None
    for turn in range(turns):
        some = pairs.where(F.pmod(F.xxhash64("a"), F.lit(turns)) == turn)
        asked = {c: small(save(some.select(F.col(c).alias("id")).distinct(), "asked"), 16) for c in "ab"}
        # only sets that are asked for are shuffled
        x, y = (sets.join(asked[c], "id", "left_semi").select(F.col("id").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab")
        found = save(some.join(x, "a").join(y, "b").where(_alike("set_a", "set_b")).select("a", "b"), "alike")
        out = found if out is None else out.unionByName(found)
        discard_saved(*asked.values())
        release(pairs.sparkSession)
    discard_saved(pairs)
    return out


def sized(x: str, y: str) -> Column:
    """Whether sets of these sizes can have a similarity of 0.8."""
    return (5 * F.col(x) >= 4 * F.col(y)) & (5 * F.col(y) >= 4 * F.col(x))


def unlike(words: list[str]) -> Column:
    """Bits in which the sketch ``words`` and those of the other side (``h`` before the name) differ."""
    return sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"h{w}"))) for w in words[1:]), F.bit_count(F.col(words[0]).bitwiseXOR(F.col(f"h{words[0]}"))))


def sharing(keys: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``keys`` (key, id) whose key several ids have, with the columns of ``nodes`` (id, ...), saved."""
    several = save(keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("key"), "shared")
    pairs = save(keys.join(small(several, 16), "key", "left_semi"), "shared-keys")
    out = save(pairs.join(nodes, "id"), "members")
    discard_saved(several, pairs)
    release(nodes.sparkSession)
    return out


def rooted(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` (id, ...) with the root of each id by the links ``found`` so far: the id itself if it has none."""
    roots = small(components(found, "a", "b"), 16).withColumnRenamed("node", "id").withColumnRenamed("root", "top")
    return rows.join(roots, "id", "left").withColumn("root", F.coalesce("top", "id")).drop("top")


def _other(rows: DataFrame, words: list[str], *more: str) -> DataFrame:
    """``rows`` as the other side of a comparison."""
    return rows.select("key", F.col("id").alias("hid"), F.col("n").alias("hn"), F.col("root").alias("hroot"), *[F.col(w).alias(f"h{w}") for w in words], *more)


def _parts() -> Column:
    return F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("part")


def _open(members: DataFrame, words: list[str], found: DataFrame) -> DataFrame:
    """The rows of buckets with several roots, with their root and the tasks of the bucket."""
    held = save(rooted(members.select("key", "id", "n", *words), found), "rooted")
    discard_saved(members)
    several = held.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count("*") / PART).cast("int").alias("ways")).where("low <> high").select("key", "ways")
    several = save(several, "several")
    left = save(held.join(small(several, 32), "key").withColumn("part", F.pmod(F.xxhash64("id"), F.col("ways")).cast("int")), "members")
    discard_saved(held, several)
    release(left.sparkSession)
    return left


def with_hubs(members: DataFrame, words: list[str], turn: int) -> DataFrame:
    """The rows of open buckets beside up to ``HUBS`` rows of another root in their bucket."""
    hubs = F.array_distinct(F.array(*[F.min_by(F.struct("id", "n", "root", *words), F.xxhash64("id", F.lit(HUBS * turn + k))) for k in range(HUBS)]))
    hub = members.groupBy("key").agg(hubs.alias("hubs"), F.max("ways").alias("ways")).select("key", "ways", F.explode("hubs").alias("h")).select("key", "ways", "h.*")
    return members.join(_other(hub, words, _parts()), ["key", "part"]).where(F.col("root") != F.col("hroot"))


def _met(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("id", "hid").alias("a"), F.greatest("id", "hid").alias("b")).distinct()


def contracted(members: DataFrame, words: list[str], close: Column, sets: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left of saved ``members`` (key, id, n, words), which are deleted, in buckets of several roots, and
    ``found`` (a, b) with the links of members to hubs of their buckets."""
    members = _open(members, words, found)
    for turn in range(2):
        if members.isEmpty():
            break
        found = found.unionByName(checked(_met(with_hubs(members, words, turn).where(sized("n", "hn") & close)), sets))
        members = _open(members, words, found)
    return members, found


def links(members: DataFrame, words: list[str], close: Column, sets: DataFrame, found: DataFrame, refine: Callable[[DataFrame], tuple[DataFrame, Column]] | None = None) -> DataFrame:
    """``found`` (a, b) with the links of saved ``members`` (key, id, n, words), which are deleted.

    ``close``: the condition by sketch on a row and another one, whose columns have an ``h`` before their
    names.  ``refine`` gives (id, keys, extra columns) for ids compared pair by pair, and a condition on
    them and on those of the other side."""
    members, found = contracted(members, words, close, sets, found)
    if members.isEmpty():
        return found
    keys = members.groupBy("id").agg(F.collect_set("key").alias("keys"))  # as many as an id has buckets
    finer, condition = refine(keys) if refine else (keys, F.lit(True))
    more = [c for c in finer.columns if c != "id"]
    finer = save(finer, "finer")
    release(finer.sparkSession)
    members = save(members.join(finer, "id"), "members")
    discard_saved(finer)
    release(members.sparkSession)
    right = _other(members, words, *[F.col(c).alias(f"h{c}") for c in more], _parts())
    once = F.col("key") == F.array_min(F.array_intersect("keys", "hkeys"))
    pairs = members.join(right, ["key", "part"]).where((F.col("root") < F.col("hroot")) & sized("n", "hn") & close & condition & once)
    return found.unionByName(checked(_met(pairs), sets))
