"""Token-id files of bit or byte planes.

A file holds the ids of consecutive documents.  Blocks of a fixed number of ids are transposed into
bit planes (plane k: bit k of each id) or byte planes, each plane is compressed by zstandard, and an
index at the end of the file has the place of each chunk and the documents' ids and lengths, so that
any range of ids is read without the rest.  Planes above a block's largest id are left out.

Layout: magic; compressed planes; index (zstandard); 24-byte tail with the index's place, its length
and the magic.  The index starts with the counts of chunks and documents and the block size, then for
each chunk its place, ids, planes and the planes' lengths, then documents' keys, whether they have
one, and lengths.

:func:`write_id_files` encodes each document once, into a table of its ids at two bytes each (four where
an id needs them), deals that table by ranges of the key, and writes files of a bounded number of ids
into the shared folder, in ascending key order.  So texts are never shuffled, and a file's index, which
a reader holds, does not grow with the input.  A task writes under a name of its own and renames the
file when it is whole, so a repeated task does no harm.  :func:`read_id_files` reads the files back.

Nulls count as empty texts (the end id alone); rows without a key come first; rows with equal keys
follow the hash of their text, and equal rows their place in the table.  An empty table gives no files.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from vicinity.llm.common import bounded_batches, discard_saved, new_path, save
from vicinity.llm.tokens import END_ID, encoder, in_groups

MAGIC = b"IDPLANE1"
BLOCK = 1 << 16
LEVEL = 1
#: Ids of a file: about 12 MB on disk.  More for larger inputs, if fewer files are wanted.
IDS_A_FILE = 1 << 23


def to_planes(ids: np.ndarray, mode: str) -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids, lowest first, as many as the largest id needs."""
    top = int(ids.max()).bit_length() if len(ids) else 0
    raw = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if mode == "byte":
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range((top + 7) // 8)]
    columns = [np.ascontiguousarray(raw[:, k]) for k in range((top + 7) // 8)]
    return [np.packbits((columns[k // 8] >> (k % 8)) & 1, bitorder="little").tobytes() for k in range(top)]


def from_planes(planes: list[bytes], n: int, mode: str) -> np.ndarray:
    raw = np.zeros((n, 4), np.uint8)
    if mode == "byte":
        for k, plane in enumerate(planes):
            raw[:, k] = np.frombuffer(plane, np.uint8)
    else:
        for at in range(0, len(planes), 8):
            column = np.zeros(n, np.uint8)
            for k, plane in enumerate(planes[at : at + 8]):
                column |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little") << k
            raw[:, at // 8] = column
    return raw.view("<u4").reshape(n)


class Writer:
    """Appends documents to a file object; memory: one block and the index."""

    def __init__(self, out, mode: str = "bit", block: int = BLOCK) -> None:
        if mode not in ("bit", "byte"):
            raise ValueError("mode is bit or byte")
        self.out, self.mode, self.block = out, mode, block
        self.pack = zstandard.ZstdCompressor(level=LEVEL)
        self.waiting, self.held, self.at = [], 0, len(MAGIC)
        self.chunks: list[bytes] = []
        self.keys, self.has, self.lengths, self.total = array("q"), bytearray(), array("I"), 0
        out.write(MAGIC)

    def add(self, key: int | None, ids: bytes) -> None:
        self.keys.append(key or 0)
        self.has.append(key is not None)
        self.total += len(ids) // 4
        self.lengths.append(len(ids) // 4)
        self.waiting.append(ids)
        self.held += len(ids)
        while self.held >= 4 * self.block:
            self._flush()

    def _flush(self) -> None:
        data = b"".join(self.waiting)
        now, later = data[: 4 * self.block], data[4 * self.block :]
        planes = [self.pack.compress(p) for p in to_planes(np.frombuffer(now, "<u4"), self.mode)]
        self.chunks.append(struct.pack("<QIB", self.at, len(now) // 4, len(planes)) + struct.pack(f"<{len(planes)}I", *map(len, planes)))
        for p in planes:
            self.out.write(p)
            self.at += len(p)
        self.waiting, self.held = [later] if later else [], len(later)

    def close(self) -> int:
        """Writes what is left and the index; the number of ids."""
        while self.held:
            self._flush()
        head = struct.pack("<IQIB", len(self.chunks), len(self.keys), self.block, self.mode == "byte")
        index = self.pack.compress(b"".join([head, *self.chunks, np.array(self.keys, "<i8").tobytes(), bytes(self.has), np.array(self.lengths, "<u4").tobytes()]))
        self.out.write(index + struct.pack("<QQ", self.at, len(index)) + MAGIC)
        return self.total


class Reader:
    """Reads documents or any range of ids from a seekable file object."""

    def __init__(self, source) -> None:
        self.source = source
        source.seek(0, 2)
        size = source.tell()
        source.seek(max(0, size - 24))
        tail = source.read(24)
        if size < 24 + len(MAGIC) or tail[16:] != MAGIC:
            raise ValueError("not a whole file of id planes")
        at, length = struct.unpack("<QQ", tail[:16])
        source.seek(at)
        self.unpack = zstandard.ZstdDecompressor()
        index = self.unpack.decompress(source.read(length))
        chunks, documents, self.block, byte = struct.unpack_from("<IQIB", index)
        self.mode, at, self.chunks = "byte" if byte else "bit", 17, []
        for _ in range(chunks):
            place, n, planes = struct.unpack_from("<QIB", index, at)
            self.chunks.append((place, n, struct.unpack_from(f"<{planes}I", index, at + 13)))
            at += 13 + 4 * planes
        self.keys = np.ma.masked_array(np.frombuffer(index, "<i8", documents, at), np.frombuffer(index, np.uint8, documents, at + 8 * documents) == 0)
        self.lengths = np.frombuffer(index, "<u4", documents, at + 9 * documents).astype(np.int64)

    def chunk(self, i: int) -> np.ndarray:
        place, n, lengths = self.chunks[i]
        self.source.seek(place)
        data, planes = self.source.read(sum(lengths)), []
        for length in lengths:
            planes.append(self.unpack.decompress(data[:length]))
            data = data[length:]
        return from_planes(planes, n, self.mode)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file; reads only the chunks that hold them."""
        if start >= stop:
            return np.empty(0, "<u4")
        first = start // self.block
        got = np.concatenate([self.chunk(i) for i in range(first, (stop - 1) // self.block + 1)])
        return got[start - first * self.block : stop - first * self.block]

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(key, ids) of each document in order; memory: one chunk and one document."""
        held, i = np.empty(0, "<u4"), 0
        for key, n in zip(self.keys.tolist(), self.lengths.tolist(), strict=True):
            parts, have = [held], len(held)
            while have < n:
                parts.append(self.chunk(i))
                have, i = have + len(parts[-1]), i + 1
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield key, held[:n]
            held = held[n:]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _coded(docs: DataFrame, tokenizer: str, key: str, text: str) -> DataFrame:
    """(id, turn, n, ids): each row's ids with the end id, ``n`` of them, at two or four bytes each."""
    end = np.array([END_ID], "<u4").tobytes()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer).ids_bytes_many
        for batch in batches:
            counts, packed = [], []
            for group in in_groups(t.as_py() for t in batch.column(2)):
                for ids in ids_of(group):
                    wide = np.frombuffer(ids + end, "<u4")
                    counts.append(len(wide))
                    packed.append((wide if int(wide.max()) >> 16 else wide.astype("<u2")).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())], ["id", "turn", "n", "ids"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("turn"), F.col(text).alias("body"))
    return rows.mapInArrow(code, "id long, turn long, n long, ids binary")


def write_id_files(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", mode: str = "bit", block: int = BLOCK, parts: int | None = None, ids_a_file: int = IDS_A_FILE) -> DataFrame:
    """Writes the files; (shard, part, uri, documents, ids) for each of them, in key order by ``shard``
    and ``part``.  A file takes no further document once it has ``ids_a_file`` ids.  The key is a column
    of whole numbers; other columns are not read."""
    spark = docs.sparkSession
    if not isinstance(docs.select(key).schema[0].dataType, IntegralType):
        raise ValueError("the key is a column of whole numbers")
    bounded_batches(spark)
    uri = new_path(spark, "ids")
    coded = save(_coded(docs, tokenizer, key, text), "coded", "zstd")
    ids = coded.agg(F.sum("n")).first()[0] or 0
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(ids / ids_a_file))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system = writer = out = None
        shard, part, done = TaskContext.get().partitionId(), 0, []

        def finish() -> None:
            total = writer.close()
            out.close()
            system.move(own, f"{folder}/{name}")
            done.append((shard, part, f"{uri}/{name}", len(writer.keys), total))

        for batch in batches:
            for x, n, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if writer is None:
                    if system is None:
                        system, folder = _filesystem(uri)
                        system.create_dir(folder, recursive=True)
                    name = f"part-{shard:06d}-{part:06d}.idp"
                    own = f"{folder}/.{name}-{uuid.uuid4().hex}"
                    out = system.open_output_stream(own)
                    writer = Writer(out, mode, block)
                writer.add(x, data if len(data) == 4 * n else np.frombuffer(data, "<u2").astype("<u4").tobytes())
                if writer.total >= ids_a_file:
                    finish()
                    writer, part = None, part + 1
        if writer is not None:
            finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["shard", "part", "uri", "documents", "ids"])

    order = [F.col("id").asc_nulls_first(), F.col("turn"), F.col("uid")]
    dealt = coded.withColumn("uid", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    files = save(dealt.select("id", "n", "ids").mapInArrow(write, "shard int, part int, uri string, documents long, ids long"), "id-files")
    discard_saved(coded)
    return files


def read_id_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files themselves; ``start``
    counts the ids of all documents before it."""
    before = F.sum("ids").over(W.orderBy("shard", "part").rowsBetween(W.unboundedPreceding, -1))  # one row a file
    placed = files.select("shard", "part", "uri", F.coalesce(before, F.lit(0)).cast("long").alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column("uri").to_pylist(), batch.column("base").to_pylist(), strict=True):
                system, path = _filesystem(uri)
                with system.open_input_file(path) as source:
                    reader = Reader(source)
                    starts = base + np.cumsum(reader.lengths) - reader.lengths
                    sums = np.fromiter((zlib.crc32(ids.tobytes()) for _, ids in reader.documents()), np.int64, len(reader.keys))
                    for i in range(0, len(starts), 1 << 15):
                        at = slice(i, i + (1 << 15))
                        yield pa.RecordBatch.from_arrays([pa.array(reader.keys.data[at], mask=reader.keys.mask[at]), pa.array(starts[at]), pa.array(reader.lengths[at]), pa.array(sums[at])], ["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(parts, "shard", "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
