"""SimHash near-duplicates with long fingerprints, every link checked exactly on word shingles.

Two texts are linked if the sets of their five-word shingles have a similarity of 0.8 or more.  Some ten
of 64 bits differ then, too many for a short fingerprint's small radius.  So the fingerprint of a set has
``SEGMENTS`` segments of 32 bits, each bit a majority over hashes of its own, and texts are candidates if
at least one of their segments is the same but for ``RADIUS`` bits.  At 0.8 that is so for a given
segment with a probability of 0.117, for one of 48 with 0.997; at 0.85 with 0.99998.

Texts with few of their shingles in any other text can have no link and are set aside first, so the index
grows with the texts that are in question (see :func:`in_question`).  It gives all candidates among these.

The index is looked up in two turns.  First the segments as they are: who shares one is compared with a few
others of it, and what is linked is contracted.  Those whose complete fingerprints are nearer than unrelated ones
are a family, with all that hang together so.  Then the balls around the segments: a segment is cut into three
pieces, one of which must be the same for two bits to differ at most, so all segments with one piece meet in a
task, which finds the neighbours among its distinct values (2^22 at most).  Values all of whose texts are in one
family already are not paired, and where nearly all others are neighbours they are linked as stars.  Families with
neighbouring values whose texts are nearer than unrelated ones are merged; one is compared once, as one bucket, since
in a large one nearly all pairs of texts have neighbouring segments.  What is left are values whose texts are of several
families, and stars of neighbouring values of several: they are buckets too, with each text of theirs once.

Compared means: with hubs, the complete distance of the fingerprints within the join and then the whole sets (see
:mod:`vicinity.llm.buckets`); where texts of several groups are left in a bucket, block by block within a task, the
fingerprints, longer ones, and the whole sets.  A block gives the links that join its groups, not its pairs.
Equal sets are one node, named by 128 bits.

Nulls are empty texts; all empty texts are one group; a text of fewer than five words is one shingle.
Repeated rows are copies of each other; an empty table gives an empty one; rows without a key are linked
like others; columns may have the names of those that are made inside.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from vicinity.llm import buckets, common
from vicinity.llm.common import bounded_batches, discard_saved, fresh, release, save, small
from vicinity.llm.components import forest

WORDS = 5
SEGMENTS, RADIUS = 48, 2
#: First bits of the three pieces of a segment, and where the last one ends.
PIECES = (0, 11, 22, 32)
#: Bits of 1536 in which the fingerprints of a pair may differ: 0.152 of them are expected at 0.8, 0.188 for
#: sets of a few shingles; these limits are 4.5 standard deviations above.
APART, APART_SMALL, SMALL = 296, 357, 64
#: Bits in which texts of one family differ from another of it: unrelated texts differ in 768, with a deviation of 20.
LOOSE = 592
#: The same as APART, APART_SMALL for the longer fingerprint.
FINE, FINE_APART, FINE_APART_SMALL = 4096, 724, 881
#: Least shingles of a set by hash, and how many of them another set's must have too.  Of the least of the union of
#: two sets each is in both with a probability of 0.8 or more: fewer than these are with one of 3e-8.
LEAST, SHARED = 32, 12
#: Values that are compared one by one within a task.
DIRECT = 1024
#: Groups of so many values are compared together; rows that a task takes up at once.
FEW, TAKEN = 48, 1 << 16
#: The root of a segment whose texts have several.
MIXED = -1
#: Pairs a value of a place on average, beyond which its values are linked as stars.
MANY = 4
#: Texts of a bucket on either side of a block, in parts of ``buckets.PART``, and the shingles of their sets.
BLOCK_PARTS, BLOCK_SHINGLES = 4, 1 << 22

_rng = np.random.default_rng(42)
_FLIPS = _rng.integers(0, 2**64, max(SEGMENTS // 2, FINE // 64), np.uint64)
_FACTORS = _rng.integers(0, 2**64, len(_FLIPS), np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LANES = np.uint64(0x0101010101010101)


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles in rising order; an empty text has an empty shingle."""
    found = common.shingles(text, WORDS)
    return found if len(found) else np.array([xxh64_intdigest(b"", common.SHINGLE_SEED)], np.uint64)


def fingerprint(hashes: np.ndarray, bits: int = 32 * SEGMENTS) -> np.ndarray:
    """The fingerprint of a set as signed 64-bit words, each of which has hashes of its own."""
    flips, factors = _FLIPS[: bits // 64], _FACTORS[: bits // 64]
    counts = np.zeros((len(flips), 8, 8), np.int64)  # word, byte, bit
    for at in range(0, len(hashes), 255):  # eight byte-wide counters a word, emptied before they overflow
        mixed = (hashes[at : at + 255, None] ^ flips) * factors
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX
        mixed ^= mixed >> np.uint64(29)
        for k in range(8):
            counts[:, :, k] += ((mixed >> np.uint64(k)) & _LANES).sum(axis=0, dtype=np.uint64).view(np.uint8).reshape(-1, 8)
    return np.packbits(2 * counts.reshape(-1) > len(hashes), bitorder="little").view(np.int64)


def _made(text: str) -> Column:
    bounded_batches(SparkSession.getActiveSession())

    @F.pandas_udf("name binary, n long, least array<long>")
    def made(texts: pd.Series) -> pd.DataFrame:
        sets = [shingles(x) for x in texts]
        return pd.DataFrame({"name": [hashlib.md5(s.tobytes()).digest() for s in sets], "n": [len(s) for s in sets], "least": [s[:LEAST].view(np.int64) for s in sets]})

    return made(F.col(text))


@F.pandas_udf(T.StructType([T.StructField("set", T.BinaryType()), T.StructField("words", T.ArrayType(T.LongType()))]))
def _printed(texts: pd.Series) -> pd.DataFrame:
    sets = [shingles(x) for x in texts]
    return pd.DataFrame({"set": [s.tobytes() for s in sets], "words": [fingerprint(s) for s in sets]})


def close_values(values: np.ndarray, free: list[int], root: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i < j, of the distinct ``values`` that differ in at most ``RADIUS`` bits, if all agree
    in the bits that are not ``free``; with ``root``, those that are not all of one root.  Many values are parted
    by each third of the free bits in turn, one of which must be the same."""
    if root is not None and root[0] != MIXED and (root == root[0]).all():
        return (np.empty(0, np.int64),) * 2
    if len(values) <= DIRECT or len(free) < 3:
        found = []
        for at in range(0, len(values), 256):
            close = np.bitwise_count(values[at : at + 256, None] ^ values[None, at:]) <= RADIUS
            if root is not None:
                close &= (root[at : at + 256, None] != root[None, at:]) | (root[at : at + 256, None] == MIXED)
            i, j = np.nonzero(close)
            found.append((i[i < j] + at, j[i < j] + at))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
    masks = [np.bitwise_or.reduce(np.array([1 << b for b in free[k::3]], values.dtype)) for k in range(3)]
    left, right = [], []
    for k, mask in enumerate(masks):
        order = np.argsort(values & mask, kind="stable")
        cuts = np.flatnonzero(np.diff(values[order] & mask)) + 1
        for group in np.split(order, cuts):
            if len(group) > 1:
                i, j = (group[x] for x in close_values(values[group], [b for b in free if not int(mask) >> b & 1], None if root is None else root[group]))
                first = np.ones(len(i), bool)  # not found by an earlier third
                for earlier in masks[:k]:
                    first &= ((values[i] ^ values[j]) & earlier) != 0
                left.append(np.minimum(i, j)[first])
                right.append(np.maximum(i, j)[first])
    return np.concatenate(left or [np.empty(0, np.int64)]), np.concatenate(right or [np.empty(0, np.int64)])


def _pairs_of(place: np.ndarray, key: np.ndarray, root: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of keys of whole groups of one place: those of a pair differ in one or two bits, do not have all
    their texts in one root, and agree in no earlier piece, which gives them as well.  Where a group has over ``MANY``
    of them a value, pairs of each value and the least that hangs together with it stand for them."""
    found, values, piece = [], (key & 0xFFFFFFFF).astype(np.uint32), (place >> 11) % 3
    masks = np.array([(1 << PIECES[k + 1]) - (1 << PIECES[k]) for k in range(3)], np.uint32)

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        wanted = (root[i] != root[j]) | (root[i] == MIXED)
        for earlier in range(2):
            wanted &= (piece[i] <= earlier) | (((values[i] ^ values[j]) & masks[earlier]) != 0)
        found.append((i[wanted], j[wanted]))

    starts = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
    sizes = np.diff([*starts, len(place)])
    few = np.repeat(sizes <= FEW, sizes).nonzero()[0]
    for step in range(1, FEW):  # all small groups at once: each row and the one so many rows behind it
        i, j = few[:-step], few[step:]
        same = place[i] == place[j]
        if not same.any():
            break
        same &= np.bitwise_count(values[i] ^ values[j]) <= RADIUS
        keep(i[same], j[same])
    for start, size in zip(starts[sizes > FEW], sizes[sizes > FEW], strict=True):
        free = [b for b in range(32) if not PIECES[piece[start]] <= b < PIECES[piece[start] + 1]]
        keep(*(x + start for x in close_values(values[start : start + size], free, root[start : start + size])))
    if not found:
        return []
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    group = np.repeat(np.arange(len(sizes)), sizes)
    dense = (np.bincount(group[i], minlength=len(sizes)) > MANY * sizes)[group[i]]
    node, least = forest(i[dense], j[dense])
    return [(key[i[~dense]], key[j[~dense]]), (key[least], key[node])]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): segments near each other, of sorted rows (place, key, root); place: segment, piece and what the
    piece holds; root: that of all of the segment's texts, or ``MIXED``."""
    held, rows, most = [], 0, TAKEN

    def out(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        for at in range(0, len(a), TAKEN):
            yield pa.RecordBatch.from_arrays([pa.array(a[at : at + TAKEN]), pa.array(b[at : at + TAKEN])], ["a", "b"])

    for batch in batches:
        held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
        rows += batch.num_rows
        if rows >= most:
            whole = [np.concatenate([h[k] for h in held]) for k in range(3)]
            last = int(np.searchsorted(whole[0], whole[0][-1]))  # its group may go on
            if last and (found := _pairs_of(*(c[:last] for c in whole))):
                yield from out(found)
            held, rows = [[c[last:] for c in whole]], rows - last
            most = max(TAKEN, 2 * rows)
    if rows and (found := _pairs_of(*(np.concatenate([h[k] for h in held]) for k in range(3)))):
        yield from out(found)


def in_question(nodes: DataFrame) -> DataFrame:
    """(id) of ``nodes`` (id, n, least) that may be similar to another: enough of their least shingles are among
    another node's.  Of those of two similar sets at most n / 4 of the union are not in both, so up to
    4 (LEAST - SHARED) shingles this is certain."""
    each = nodes.select("id", "n", F.explode("least").alias("shingle"))
    met = each.withColumn("met", F.count("*").over(Window.partitionBy("shingle"))).where("met > 1")
    certain = F.least(F.col("n"), F.lit(LEAST)) - F.floor(F.col("n") / 4)
    asked = F.when(F.col("n") <= LEAST, certain).otherwise(F.greatest(certain, F.lit(SHARED)))
    return met.groupBy("id").agg(F.count("*").alias("met"), F.any_value("n").alias("n")).where(F.col("met") >= asked).select("id")


def segments(nodes: DataFrame) -> DataFrame:
    """(key, id, ...): each segment of ``nodes`` (id, words, ...), its number in the upper half of the key."""
    low = lambda w: w.bitwiseAND(0xFFFFFFFF)
    each = [F.lit(i << 32).bitwiseOR(F.shiftrightunsigned(w, 32) if i % 2 else low(w)) for i, w in ((i, F.get("words", F.lit(i // 2))) for i in range(SEGMENTS))]
    return nodes.withColumn("key", F.explode(F.array(*each)))


def neighbours(rooted: DataFrame) -> DataFrame:
    """(a, b): keys of segments that differ in one or two bits and whose texts are not all of one root,
    from rows (key, root); saved."""
    values = rooted.groupBy("key").agg(F.when(F.min("root") == F.max("root"), F.min("root")).otherwise(MIXED).alias("root"))
    segment, value = F.shiftright("key", 32), F.col("key").bitwiseAND(0xFFFFFFFF)
    places = [((segment * 3 + k) * 2048 + F.shiftright(value, PIECES[k]).bitwiseAND((1 << PIECES[k + 1] - PIECES[k]) - 1)) for k in range(3)]
    dealt = values.select(F.explode(F.array(*places)).alias("place"), "key", "root").repartition("place").sortWithinPartitions("place")
    return save(dealt.mapInArrow(_neighbours, "a long, b long"), "neighbours")


def apart() -> Column:
    """The complete distance of two fingerprints."""
    each = [F.bit_count(F.get("words", F.lit(i)).bitwiseXOR(F.get("hwords", F.lit(i)))) for i in range(SEGMENTS // 2)]
    return sum(each[1:], each[0])


def near() -> Column:
    """Whether the complete distance of two fingerprints is that of similar sets."""
    return apart() <= F.when(F.least("n", "hn") < SMALL, APART_SMALL).otherwise(APART)


def merged(pairs: DataFrame, touched: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): roots of families to be merged, since texts of theirs with neighbouring values are nearer than unrelated
    ones; saved.  ``pairs`` (a, b) of values, ``touched`` (key, id, root): their texts.  Two texts of each two families
    are compared, however many values they share."""
    text = F.struct("root", "id")
    ends = touched.groupBy("key").agg(F.min(text).alias("first"), F.max(text).alias("last"))
    x, y = (ends.select(F.col("key").alias(c), F.array("first", "last").alias(f"of_{c}")) for c in "ab")
    met = pairs.join(x, "a").join(y, "b").select(F.explode(F.arrays_zip("of_a", "of_b")).alias("m")).select(F.least("m.of_a", "m.of_b").alias("x"), F.greatest("m.of_a", "m.of_b").alias("y")).where("x.root <> y.root")
    asked = met.groupBy(F.col("x.root").alias("a"), F.col("y.root").alias("b")).agg(F.min(F.struct("x.id", F.col("y.id").alias("hid"))).alias("low"), F.max(F.struct("x.id", F.col("y.id").alias("hid"))).alias("high"))
    asked = asked.select("a", "b", F.explode(F.array_distinct(F.array("low", "high"))).alias("m")).select("a", "b", "m.*")
    return save(asked.join(nodes.select("id", "words"), "id").join(nodes.select(F.col("id").alias("hid"), F.col("words").alias("hwords")), "hid").where(apart() <= LOOSE).select("a", "b"), "merged")


def _linked(block: pd.DataFrame) -> pd.DataFrame:
    """Links that join the groups of a block: its texts of one part with those of another one, or among themselves."""
    if block["root"].nunique() < 2:
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    block = block.sort_values(["part", "id"], ignore_index=True)
    ids, n, label = (block[c].to_numpy() for c in ("id", "n", "root"))
    label, words, sets = label.copy(), np.stack(block["words"].to_numpy()).view(np.uint64), [np.frombuffer(x, np.uint64) for x in block["set"]]
    most, fine_most = np.where(n < SMALL, APART_SMALL, APART), np.where(n < SMALL, FINE_APART_SMALL, FINE_APART)
    two = block["p"].iloc[0] != block["q"].iloc[0]
    cut = int((block["part"] == block["p"]).sum()) if two else 0  # the other part starts there
    fine: dict[int, np.ndarray] = {}
    found = []

    def longer(i: int) -> np.ndarray:
        if i not in fine:
            fine[i] = fingerprint(sets[i], FINE).view(np.uint64)
        return fine[i]

    for i in range(cut if two else len(ids)):
        j = np.arange(max(cut, i + 1), len(ids))
        j = j[(label[j] != label[i]) & (5 * n[j] >= 4 * n[i]) & (5 * n[i] >= 4 * n[j])]
        j = j[np.bitwise_count(words[j] ^ words[i]).sum(axis=1) <= np.maximum(most[i], most[j])]
        for k in j.tolist():
            if label[k] != label[i] and np.bitwise_count(longer(i) ^ longer(k)).sum() <= max(fine_most[i], fine_most[k]) and buckets.alike(sets[i], sets[k]):
                found.append((ids[i], ids[k]))
                label[label == label[k]] = label[i]
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def compared(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links that join the groups of the buckets of saved ``members`` (key, id, n, words, root), saved.  Texts
    of a bucket are dealt to parts, and each part meets itself and each other one in a block."""
    ways = F.greatest(F.ceil(F.count("*") / (BLOCK_PARTS * buckets.PART)), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sizes = save(members.groupBy("key").agg(ways.alias("ways")), "sizes")
    dealt = members.select("key", "id", "n", "root", "words").join(small(sizes, 24), "key").withColumn("part", F.pmod(F.xxhash64("id"), F.col("ways")).cast("int"))
    dealt = dealt.join(sets, "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)))
    dealt = dealt.select("key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "id", "n", "root", "words", "set")
    return save(dealt.groupBy("key", "p", "q").applyInPandas(_linked, "a long, b long"), "linked")


def links(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links between saved ``nodes`` (id, n, words) found by their segments and checked on their saved
    ``sets`` (id, set)."""
    found = nodes.select(F.col("id").alias("a"), F.col("id").alias("b")).where("false")
    left, found = buckets.contracted(buckets.sharing(segments(nodes).select("key", "id"), small(nodes, 256)), ["words"], near(), sets, found)
    loose = save(buckets.with_hubs(left, ["words"], 0).where(apart() <= LOOSE).select(F.col("id").alias("a"), F.col("hid").alias("b")), "loose")
    roots = save(buckets.rooted(nodes, found.unionByName(loose)), "roots")
    pairs = neighbours(segments(roots).select("key", "root"))
    # each pair of values goes to the star of its first one
    stars = save(pairs.select("a", "b").unionByName(pairs.select("a", F.col("a").alias("b")).distinct()), "pair-stars")
    values = save(stars.select(F.col("b").alias("key")).unionByName(left.select("key")).distinct(), "values")
    touched = save(segments(roots).select("key", "id", "root").join(small(values, 16), "key", "left_semi"), "touched")
    more = merged(pairs, touched, nodes)
    families = save(buckets.rooted(roots.select("id", F.col("root").alias("own")), found.unionByName(loose).unionByName(more)), "families")
    top = save(families.select(F.col("own").alias("root"), F.col("root").alias("top")).distinct(), "tops")
    # values and stars whose texts are of several families
    spans = save(touched.select("key", "root").distinct().join(small(top, 16), "root").groupBy("key").agg(F.min("top").alias("low"), F.max("top").alias("high")), "spans")
    mixed = spans.where("low <> high").select("key")
    open_stars = stars.join(spans.withColumnRenamed("key", "b"), "b").groupBy("a").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("a")
    asked = save(stars.join(open_stars, "a", "left_semi").select("a", F.col("b").alias("key")), "open-stars")
    kinds = [families.select("root", "id"), touched.join(mixed, "key", "left_semi").select("key", "id"), touched.join(small(asked, 16), "key").select("a", "id")]
    met = [rows.select(F.xxhash64(F.lit(kind), rows.columns[0]).alias("key"), "id") for kind, rows in enumerate(kinds)]
    met = save(met[0].unionByName(met[1]).unionByName(met[2]).distinct(), "met")
    discard_saved(pairs, stars, values, touched, more, families, top, spans, asked, loose, left, roots)
    release(met.sparkSession)
    members, found = buckets.contracted(buckets.sharing(met, small(nodes, 256)), ["words"], near(), sets, found)
    found = found.unionByName(compared(members, sets))
    discard_saved(met, members)
    return found


def drop_similar(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, one of each component of linked texts: that with the
    smallest key (rows without one come last), and of several such rows one."""
    uid, node = fresh(docs, "uid", "node")
    kept = save(docs.withColumn(uid, F.monotonically_increasing_id()).withColumn(node, _made(text)), "kept", "zstd")
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col(uid).alias("uid"))
    grouped = kept.groupBy(F.col(f"{node}.name").alias("name")).agg(F.min(order).alias("first"), *[F.any_value(f"{node}.{c}").alias(c) for c in ("n", "least")])
    nodes = save(grouped.select(F.monotonically_increasing_id().alias("id"), "first", "n", "least"), "nodes")
    asked = save(nodes.select("id", "n", F.col("first.uid").alias(uid)).join(small(save(in_question(nodes), "in-question"), 16), "id"), "asked")
    printed = kept.select(uid, F.col(text).alias("body")).join(small(asked, 32), uid).select("id", "n", _printed("body").alias("made"))
    sets = save(printed.select("id", "n", "made.*"), "sets")
    release(sets.sparkSession)
    found = links(sets.select("id", "n", "words"), sets.select("id", "set"))
    firsts = save(buckets.rooted(nodes.select("id", "first"), found).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.uid").alias(uid)), "firsts")
    discard_saved(nodes, asked, sets)
    release(sets.sparkSession)
    return kept.join(small(firsts, 16), uid, "left_semi").drop(uid, node)
