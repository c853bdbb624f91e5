"""Best-fit-decreasing packing of token sequences.

Lengths are whole numbers up to the capacity, so bins with equal room left are alike, and so are
documents of equal length.  The driver gets one count for each length (a table of at most
``capacity`` rows, however many documents there are), and replays best-fit decreasing on it: a
segment tree over the room left, with a leaf for each amount of room that says whether a bin has it,
finds the tightest open bin in logarithmic time, and equal documents that go the same way are placed
at once.  The outcome is a list of runs: "documents ``rank`` to ``rank + n`` of this length go, ``each``
to a bin, into bins from ``bin`` on, at this offset".  Documents get their rank among those of equal
length in Spark, by counts of hashed buckets and a window within each bucket, so that a length
shared by a third of all rows is dealt over many tasks, and then find their run.

Only documents over the capacity are cut.  Nulls count as empty texts (the end id alone).
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vicinity.llm.common import bounded_batches, fresh, save
from vicinity.llm.tokens import END_ID, encoder, in_groups

CAPACITY = 4096


class Rooms:
    """Open bins by the room they have left; a segment tree finds the tightest that fits."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.tree = bytearray(2 * self.leaves)
        self.bins: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: runs of bin numbers

    def _mark(self, room: int, on: bool) -> None:
        i = room + self.leaves
        self.tree[i] = on
        while i > 1:
            i >>= 1
            self.tree[i] = self.tree[2 * i] | self.tree[2 * i + 1]

    def tightest(self, length: int) -> int:
        """The least room of at least ``length`` that an open bin has; 0 if there is none."""
        i = length + self.leaves
        if self.tree[i]:
            return length
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return 0

    def put(self, room: int, first: int, n: int) -> None:
        if room and n:
            self.bins[room].append((first, n))
            self._mark(room, True)

    def take(self, room: int, most: int) -> tuple[int, int]:
        """(first, n): up to ``most`` bins of a run with this room; they are no longer open."""
        first, n = self.bins[room].pop()
        if n > most:
            self.bins[room].append((first + most, n - most))
            n = most
        if not self.bins[room]:
            self._mark(room, False)
        return first, n


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """Runs (rank, bin, each, offset) for each length, and the number of bins.

    ``counts``: documents of each length from 1 to ``capacity``.  The document of rank r in a run that
    starts at ``rank`` goes into bin ``bin + (r - rank) // each`` at ``offset + (r - rank) % each * length``.
    """
    rooms, runs, opened = Rooms(capacity), {}, 0
    for length in sorted(counts, reverse=True):
        left, rank, out = counts[length], 0, []
        while left:
            room = rooms.tightest(length)
            each = (room or capacity) // length
            many = max(1, left // each)  # bins that are filled as far as this length can
            if room:
                first, n = rooms.take(room, many)
            else:
                room, first, n = capacity, opened, many
                opened += n
            placed = min(left, n * each)
            out.append((rank, first, each, capacity - room))
            full, rest = divmod(placed, each)
            rooms.put(room - each * length, first, full)
            if rest:
                rooms.put(room - rest * length, first + full, 1)
            rank, left = rank + placed, left - placed
        runs[length] = out
    return runs, opened


def ranked(rows: DataFrame, length: str, rank: str, *order: str) -> DataFrame:
    """``rows`` with ``rank``: numbers from 0 among the rows of equal ``length``, by hashed buckets."""
    bucket, own, before, n = fresh(rows, "bucket", "own", "before", "n")
    buckets = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy(length, bucket).agg(F.count("*").alias(n))
    earlier = F.sum(n).over(W.partitionBy(length).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select(length, bucket, F.coalesce(earlier, F.lit(0)).alias(before))
    place = F.row_number().over(W.partitionBy(length, bucket).orderBy(*order)) - 1
    return dealt.withColumn(own, place).join(sizes, [length, bucket]).withColumn(rank, F.col(before) + F.col(own)).drop(bucket, own, before)


def pack(pieces: DataFrame, length: str, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` by best-fit decreasing on the column ``length``
    (1 to ``capacity``).  ``pieces`` is read more than once: pass a saved table.  ``order`` names the
    columns that tell equal lengths apart; rows that are equal in them may change places."""
    counts = {r[0]: r[1] for r in pieces.groupBy(length).agg(F.count("*")).collect()}  # at most ``capacity`` rows
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError(f"lengths are from 1 to {capacity}")
    runs, _ = plan(counts, capacity)
    starts = {n: [r[0] for r in runs[n]] for n in runs}

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        out = np.empty((len(lengths), 2), np.int64)
        for i, (n, r) in enumerate(zip(lengths.tolist(), ranks.tolist(), strict=True)):
            rank, first, each, offset = runs[n][bisect_right(starts[n], r) - 1]
            out[i] = first + (r - rank) // each, offset + (r - rank) % each * n
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    rank, placed = fresh(pieces, "rank", "placed")
    done = ranked(pieces, length, rank, *order).withColumn(placed, place(F.col(length), F.col(rank)))
    return done.select(*[F.col(f"`{c}`") for c in pieces.columns], f"{placed}.sequence_id", f"{placed}.offset")


def token_pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]): each row's ids with the end id, cut only where
    they are longer than ``capacity``.  ids: little-endian unsigned 32-bit integers."""
    bounded_batches(docs.sparkSession)
    kind = "array<struct<piece:int,start:long,length:long,ids_crc32:long" + (",ids:binary>>" if with_ids else ">>")

    @F.pandas_udf(kind)
    def cut(texts: pd.Series) -> pd.Series:
        encode, end, out = encoder(tokenizer).ids_bytes_many, np.array([END_ID], "<u4").tobytes(), []
        for data in (ids + end for group in in_groups(texts) for ids in encode(group)):
            parts = []
            for k, at in enumerate(range(0, len(data), 4 * capacity)):
                ids = data[at : at + 4 * capacity]
                parts.append({"piece": k, "start": at // 4, "length": len(ids) // 4, "ids_crc32": zlib.crc32(ids)} | ({"ids": ids} if with_ids else {}))
            out.append(parts)
        return pd.Series(out, dtype=object)

    cell, = fresh(docs.select(key), "cell")
    return docs.select(F.col(key), F.explode(cut(F.col(text))).alias(cell)).select(key, f"{cell}.*")


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all rows of ``docs`` with their sequence and place.  Repeated rows are packed each."""
    pieces = save(token_pieces(docs, tokenizer, key, text, capacity, with_ids), "pieces")
    return pack(pieces, "length", [key, "piece", "ids_crc32"], capacity)
