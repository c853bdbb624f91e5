"""Prefix tries of conversations by Patricia construction.

A conversation is a sequence of turns; each distinct sequence of first turns is a node of the trie.  A turn
stands as 16 bytes (MD5 of role and text), a conversation as these in a row, its path.  Equal conversations
are one path with a count.  Paths are sorted: range-partitioned in Spark, each range a task, which reads its
paths in order with a stack as deep as the longest of them.  Only branch points (where neighbours part),
end points and leaves become points, and the edges between them carry the running lengths of their turns.

A range also knows the last path before it and the first one behind it, so where it parts from its
neighbours.  What it finds about a point is a sum over its own paths, and prefixes of its first and last
path may be points that only another range knows; so it gives sums for all of these.  Sums of a point are
added up over ranges, and its parent is the deepest that any range has seen: the range that holds the
path next to the parent's parting has seen it.  Unary nodes are then expanded from the edges: they have the
counts of the point below, and add the suffix sum of the edge to its saved length.

Which conversations end at a node is a list that a task gets in blocks of 4096 ids, in order, and hashes
as it reads; that hash is sequential, so a path with very many conversations is one task's stream of ids.
Nothing else gathers a path's conversations, and no task holds all children of a node.

A conversation's own turns (16 bytes and a length each) are gathered in one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vicinity.llm.common import discard_saved, look_up, save

#: Conversation ids of one block; a power of two.
BLOCK_BITS = 12
TURN = 16
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_columns(role: Column, text: Column) -> tuple[Column, Column]:
    """The 16 bytes of a turn, nulls as empty, and the code points of its text."""
    role, text = (F.coalesce(c, F.lit("")) for c in (role, text))
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))), F.length(text).cast("long")


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn, chars): turns of each conversation in order, from 1.  Null turn numbers come
    first; turns of one number are in the order of role and text.  Rows without a conv_id are left out."""
    turn, chars = turn_columns(F.col("role"), F.col("text"))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.row_number().over(order).alias("pos"), turn.alias("bytes"), chars.alias("chars")).withColumnRenamed("bytes", "turn")


def rebuilt(conversations: DataFrame, group: int = 100, cycle: int = 6) -> DataFrame:
    """(id, path, chars): each conversation c with its first h turns taken from conversation c - c % group,
    h being the crc32 of c's decimal form modulo ``cycle``, and its own turns after its first h.  At most
    ``group`` conversations ask one other for fewer than ``cycle`` turns."""
    turns = save(numbered(conversations), "turns")
    h = (F.crc32(F.col("id").cast("string").cast("binary")) % cycle).cast("int")
    asking = turns.where("pos = 1").select(F.col("conv_id").alias("id")).withColumn("h", h).withColumn("base", F.col("id") - F.col("id") % group)
    first = turns.where(F.col("pos") < cycle).withColumnRenamed("conv_id", "base")
    taken = asking.join(first, "base").where("pos <= h").select("id", "pos", "turn", "chars")
    own = turns.withColumnRenamed("conv_id", "id").where(F.col("pos") > h).select("id", "pos", "turn", "chars")
    present = asking.select("id", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("binary").alias("turn"), F.lit(None).cast("long").alias("chars"))
    return gathered(taken.unionByName(own).unionByName(present))


def gathered(turns: DataFrame) -> DataFrame:
    """(id, path, chars) from rows (id, pos, turn, chars); a null pos says only that there is such an id."""
    steps = F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "turn", "chars"))))
    path = F.aggregate("steps", F.lit(b"").cast("binary"), lambda a, s: F.concat(a, s["turn"]))
    return turns.groupBy("id").agg(steps.alias("steps")).select("id", path.alias("path"), F.col("steps.chars").alias("chars"))


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, digest = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([digest.hexdigest()])], ["name", "ends"])

    for batch in batches:
        for now, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if now != name:
                if name is not None:
                    yield out()
                name, digest, comma = now, hashlib.sha256(), b""
            digest.update(comma + ",".join(map(str, ids)).encode())
            comma = b","
    if name is not None:
        yield out()


def _shared(a: bytes, b: bytes) -> int:
    """Turns that two paths have in common at their start."""
    low, high = 0, min(len(a), len(b)) // TURN
    while low < high:
        mid = (low + high + 1) // 2
        if a[: mid * TURN] == b[: mid * TURN]:
            low = mid
        else:
            high = mid - 1
    return low


class _Point:
    __slots__ = ("children", "depth", "ends", "least", "leaves", "n", "own", "real", "reach")

    def __init__(self, depth: int, real: bool, own: int):
        self.depth, self.real, self.own = depth, real, own  # own: lengths of nodes that this range brings in
        self.n = self.leaves = self.children = self.reach = 0  # reach: lengths of whole paths, each as often as it is there
        self.least = self.ends = None

    def add(self, n: int, least: int | None, leaves: int, reach: int, own: int) -> None:
        self.n, self.leaves, self.reach, self.own = self.n + n, self.leaves + leaves, self.reach + reach, self.own + own
        self.least = least if self.least is None else self.least if least is None else min(self.least, least)


class _Range:
    """The points of one range of sorted paths."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.stack = [_Point(0, True, 0)]
        self.path, self.keys, self.sums = b"", [bytes(TURN)], [0]
        self.known, self.ghost, self.seen = 0, None, False  # known: first turns of the path that an earlier range brings in

    def _pop(self, to: int, branch: int) -> None:
        """The top goes up into a point of depth ``to``; ``branch``: a depth known to be a point, or -1."""
        top = self.stack.pop()
        if self.stack[-1].depth < to:
            self.stack.append(_Point(to, to == branch, self.sums[to] - self.sums[to - 1] if to > self.known else 0))
        up = self.stack[-1]
        parent = up.depth if up.real else max(branch if branch <= up.depth else -1, next(p.depth for p in reversed(self.stack) if p.real))
        edge = self.sums[parent : top.depth + 1] if top.real else None
        self.rows.append((self.keys[top.depth], top.depth, top.real, top.n, top.least, top.leaves, top.children, top.reach, top.own, self.sums[top.depth - 1], parent, self.keys[parent], edge, top.ends))
        between = self.sums[top.depth - 1] - self.sums[max(up.depth, min(self.known, top.depth - 1))]
        up.add(top.n, top.least, top.leaves, top.reach, top.own + between)
        up.children += up.depth >= self.known

    def _leave(self, shared: int) -> None:
        """Ends the current path, of which the next one has the first ``shared`` turns; -1: there is none."""
        top = self.stack[-1]
        if top.ends is not None and top.depth == len(self.keys) - 1 and shared < top.depth:
            top.add(0, None, 1, 0, 0)
        branch = max(shared, 0)
        while self.stack[-1].depth > branch:
            self._pop(max(branch, self.stack[-2].depth), branch)
        self.stack[-1].real = True

    def before(self, path: bytes) -> None:
        self.ghost = path

    def take(self, path: bytes, chars: list[int], n: int, least: int, ends: str) -> None:
        if self.seen:
            shared = _shared(self.path, path)
            self._leave(shared)
            self.known = min(self.known, shared)
        else:
            shared = self.known = _shared(self.ghost, path) if self.ghost is not None else 0
        for at in range(len(self.keys) - 1 if not self.seen else shared, len(path) // TURN):
            del self.keys[at + 1 :]
            self.keys.append(hashlib.md5(self.keys[at] + path[at * TURN : (at + 1) * TURN]).digest())
        del self.keys[len(path) // TURN + 1 :]
        self.sums = [0, *accumulate(chars)]
        size = len(self.keys) - 1
        if not self.seen and self.ghost is not None:
            for depth in range(1, size):  # any of these may be a point
                self.stack.append(_Point(depth, depth == shared, self.sums[depth] - self.sums[depth - 1] if depth > shared else 0))
        if size:
            self.stack.append(_Point(size, True, self.sums[size] - self.sums[size - 1]))
        self.stack[-1].add(n, least, 0, n * self.sums[size], 0)
        self.stack[-1].ends = ends
        self.path, self.seen = path, True

    def finish(self, after: bytes | None) -> list[tuple]:
        if not self.seen:
            return []
        shared = -1 if after is None else _shared(self.path, after)
        top = self.stack[-1]
        if top.ends is not None and shared < top.depth:
            top.add(0, None, 1, 0, 0)
        while len(self.stack) > 1:
            depth = self.stack[-1].depth
            if depth == shared:
                self.stack[-1].real = True
            self._pop(depth - 1 if after is not None else self.stack[-2].depth, shared)
        root = self.stack[0]
        self.rows.append((self.keys[0], 0, True, root.n, root.least, root.leaves, root.children, root.reach, root.own, 0, -1, None, None, root.ends))
        return self.rows


_POINT = "key binary, depth int, real boolean, n long, least long, leaves long, children long, reach long, own long, above long, parent int, parent_key binary, edge array<long>, ends string"
_ARROW = pa.schema([("key", pa.binary()), ("depth", pa.int32()), ("real", pa.bool_()), *[(c, pa.int64()) for c in ("n", "least", "leaves", "children", "reach", "own", "above")], ("parent", pa.int32()), ("parent_key", pa.binary()), ("edge", pa.list_(pa.int64())), ("ends", pa.string())])


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Points of sorted rows (part, path, chars, n, least, ends, ghost), part by part."""

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    part, now = None, None
    for batch in batches:
        for at, path, chars, n, least, ends, ghost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != part:
                if now and (rows := now.finish(None)):
                    yield packed(rows)
                part, now = at, _Range()
            if ghost == 0:
                now.take(path, chars, n, least, ends)
            elif ghost < 0:
                now.before(path)
            else:
                if rows := now.finish(path):
                    yield packed(rows)
                now = None
            if now and len(now.rows) >= 4096:
                yield packed(now.rows)
                now.rows = []
    if now and (rows := now.finish(None)):
        yield packed(rows)


def prefix_trie(paths: DataFrame, ranges: int | None = None) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row for
    each node, conv_id being its smallest member; conv_id and depth name the turn that is its last.

    ``paths``: (id, path, chars), a row for each id, as :func:`gathered` makes them.  ``ranges``: how many
    ranges are sorted apart; by default as many as Spark finds fit.  No conversations give no rows."""
    named = save(paths.withColumn("name", F.unhex(F.md5("path"))), "named")
    blocks = named.groupBy("name", F.shiftright("id", BLOCK_BITS).alias("block")).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    ends = blocks.repartition("name").sortWithinPartitions("name", "block").select("name", "ids").mapInArrow(_hash_ends, "name binary, ends string")
    distinct = named.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.first("path").alias("path"), F.first("chars").alias("chars")).join(ends, "name").drop("name")
    dealt = distinct.repartitionByRange(ranges, "path") if ranges else distinct.repartitionByRange("path")
    ranged = save(dealt.withColumn("part", F.spark_partition_id()), "ranged")
    discard_saved(named)
    edges = ranged.groupBy("part").agg(F.min("path").alias("low"), F.max("path").alias("high"))  # a row for each range
    beside = W.orderBy("part")
    edges = edges.select("part", F.lag("high").over(beside).alias("high"), F.lead("low").over(beside).alias("low"))
    ghosts = edges.select("part", F.explode(F.array(F.struct(F.col("high").alias("path"), F.lit(-1).alias("ghost")), F.struct(F.col("low").alias("path"), F.lit(1).alias("ghost")))).alias("g")).select("part", "g.path", "g.ghost").where("path is not null")
    columns = ["part", "path", "chars", "n", "least", "ends", "ghost"]
    rows = ranged.withColumn("ghost", F.lit(0)).unionByName(ghosts, allowMissingColumns=True).select(*columns)
    found = rows.repartition("part").sortWithinPartitions("part", "path").mapInArrow(_points, _POINT)
    sums = [F.sum(c).alias(c) for c in ("n", "leaves", "children", "reach", "own")]
    merged = found.groupBy("key").agg(
        F.max("depth").alias("depth"), F.bool_or("real").alias("real"), *sums, F.min("least").alias("least"), F.max("above").alias("above"), F.max(F.struct("parent", "parent_key")).alias("up"),
        F.max_by(F.struct("parent", "edge"), F.when(F.col("real"), F.col("parent"))).alias("seen"), F.max("ends").alias("ends"),
    ).where("real")
    # seen.edge has the running lengths at depths seen.parent to depth; the edge begins at the true parent
    edge = F.slice("seen.edge", F.col("up.parent") - F.col("seen.parent") + 1, F.col("depth") - F.col("up.parent") + 1)
    points = save(merged.select("key", "depth", "n", "least", "leaves", "children", (F.col("reach") - F.col("n") * F.col("above") - F.col("own")).alias("saved"), F.col("up.parent").alias("parent"), F.col("up.parent_key").alias("parent_key"), edge.alias("edge"), "ends"), "points")
    discard_saved(ranged)
    up = save(points.select(F.col("key").alias("parent_key"), F.col("least").alias("parent_least"), F.col("children").alias("asked")), "up")
    known = look_up(points, up, "parent_key", "asked", ["key"])
    each = known.withColumn("at", F.explode(F.sequence(F.when(F.col("depth") > 0, F.col("parent") + 1).otherwise(0), F.col("depth"))))
    whole = F.col("at") == F.col("depth")
    suffix = F.when(whole, 0).otherwise((F.col("n") - 1) * (F.get("edge", F.col("depth") - F.col("parent") - 1) - F.get("edge", F.col("at") - 1 - F.col("parent"))))
    return each.select(
        F.col("least").alias("conv_id"), F.col("at").cast("long").alias("depth"), F.when(F.col("at") > 0, F.when(F.col("at") == F.col("parent") + 1, F.col("parent_least")).otherwise(F.col("least"))).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(whole, F.col("children")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("saved") + suffix).alias("saved_tokens"),
        F.coalesce(F.when(whole, F.col("ends")), F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, ranges: int | None = None) -> DataFrame:
    """The trie of the :func:`rebuilt` conversations.  Null roles and texts are empty; extra columns are ignored."""
    return prefix_trie(rebuilt(conversations), ranges)


def conversation_trie_sql() -> str:
    """The same rows from all prefixes of all conversations, each node's subtree from its nodes' prefixes."""
    step = "list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda crc, b: {step}), 4294967295)"
    return f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), h AS (SELECT c, c - c % 100 AS base, {crc} % 6 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (
  SELECT h.c, pos, role, text FROM h JOIN t ON t.c = h.base AND pos <= h
  UNION ALL SELECT h.c, pos, role, text FROM h JOIN t ON t.c = h.c AND pos > h
), s AS (
  SELECT h.c, coalesce(list({{'role': role, 'text': text}} ORDER BY pos) FILTER (pos IS NOT NULL), []) AS p FROM h LEFT JOIN r USING (c) GROUP BY h.c
), n AS (
  SELECT p[1:d] AS p, d, min(c) AS c, count(*) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(p) = d), '') AS ends
  FROM (SELECT c, p, unnest(range(0, len(p) + 1)) AS d FROM s) GROUP BY p[1:d], d
), k AS (SELECT p[1:d - 1] AS p, count(*) AS children FROM n WHERE d > 0 GROUP BY p[1:d - 1]),
m AS (SELECT n.*, coalesce(children, 0) AS children, CASE WHEN d = 0 THEN 0 ELSE (n - 1) * length(p[d].text) END AS saved FROM n LEFT JOIN k USING (p)),
sub AS (
  SELECT top, sum((children = 0)::INT)::BIGINT AS leaves, sum(saved)::BIGINT AS saved
  FROM (SELECT p[1:e] AS top, children, saved FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM m)) GROUP BY top
)
SELECT m.c AS conv_id, m.d AS depth, u.c AS parent_conv_id, m.n AS n_convs, m.children AS n_children, leaves AS n_leaves, sub.saved AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN sub ON sub.top = m.p LEFT JOIN m AS u ON u.d = m.d - 1 AND u.p = m.p[1:m.d - 1]"""
