"""Media columns in Matroska: byte payloads as audio samples, and a parser for packet tables.

:func:`mux` stores bytes losslessly as unsigned 8-bit mono samples (codec ``A_PCM/INT/LIT``): an
EBML header, then a segment with info, one track, clusters of laced blocks, and cues.
:func:`packets` reads any Matroska file: variable-length element ids and sizes, unknown sizes,
clusters, simple blocks and block groups, all four lacings, and cues; it gives a row for each frame
with track, time and byte range.  :func:`payload` checks that each cue leads to a cluster of its time and
reads samples back cluster by cluster through the cues and packet ranges.

:func:`media_table` is a table with the files as a binary column; :func:`packet_table` and
:func:`media_digests` read such a column, as stored.  A file that cannot be read gives one row with an
``error`` and nulls; it is never passed over.

Nulls count as empty texts.  A payload is padded with zero bytes to a positive multiple of 64.  Repeated
rows give a row each, an empty table an empty one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.llm.common import bounded_batches, fresh, own_names

# Element ids of the Matroska specification.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3
UNIT = 64  # bytes (samples) of a frame
RATE = 8000  # samples a second: a frame lasts 8 ms
LACED = 128  # frames of a block at most
CLUSTER_BLOCKS = 16  # blocks of a cluster at most
_FRAME_MS = UNIT * 1000 // RATE
_MASTERS = {SEGMENT, CLUSTER, BLOCK_GROUP, TRACKS, TRACK_ENTRY, AUDIO, INFO, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
#: Elements that end a cluster of unknown size.
_TOP = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, EBML, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}


def _id(x: int) -> bytes:
    return x.to_bytes((x.bit_length() + 7) // 8, "big")


def _size(n: int, width: int = 0) -> bytes:
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return ((1 << 7 * width) | n).to_bytes(width, "big")


def _element(x: int, body: bytes) -> bytes:
    return _id(x) + _size(len(body)) + body


def _uint(x: int, value: int) -> bytes:
    return _element(x, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _float(x: int, value: float) -> bytes:
    return _element(x, np.array(value, ">f8").tobytes())


def _block(payload: memoryview, time: int, lacing: int) -> bytes:
    frames, head = len(payload) // UNIT, b"\x81" + time.to_bytes(2, "big", signed=True)
    if frames == 1:
        return _element(SIMPLE_BLOCK, head + b"\x80" + bytes(payload))
    head += bytes([0x80 | lacing << 1, frames - 1])
    if lacing == XIPH:
        head += bytes([UNIT]) * (frames - 1)
    elif lacing == EBML_LACING:
        head += _size(UNIT) + b"\xbf" * (frames - 2)  # size differences of 0
    return _element(SIMPLE_BLOCK, head + bytes(payload))


_HEADER = _element(EBML, _uint(EBML_VERSION, 1) + _uint(EBML_READ_VERSION, 1) + _uint(EBML_MAX_ID, 4) + _uint(EBML_MAX_SIZE, 8) + _element(DOC_TYPE, b"matroska") + _uint(DOC_TYPE_VERSION, 4) + _uint(DOC_TYPE_READ_VERSION, 2))
_TRACKS = _element(TRACKS, _element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _element(CODEC_ID, b"A_PCM/INT/LIT") + _uint(DEFAULT_DURATION, _FRAME_MS * 1_000_000) + _element(AUDIO, _float(SAMPLING_FREQUENCY, RATE) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))))


def pad(data: bytes) -> bytes:
    return data + bytes(-len(data) % UNIT or UNIT * (not data))


def mux(payload: bytes, lacing: int = FIXED) -> bytes:
    """A Matroska file whose samples are ``payload`` (a positive multiple of 64 bytes)."""
    if not payload or len(payload) % UNIT:
        raise ValueError("a payload is a positive multiple of 64 bytes")
    view, step = memoryview(payload), (1 if lacing == NO_LACING else LACED) * UNIT
    info = _element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + _float(DURATION, len(payload) // UNIT * _FRAME_MS) + _element(MUXING_APP, b"vicinity") + _element(WRITING_APP, b"vicinity"))
    parts, cues, at = [info, _TRACKS], [], len(info) + len(_TRACKS)
    for start in range(0, len(payload), step * CLUSTER_BLOCKS):
        begin = start // UNIT * _FRAME_MS
        blocks = b"".join(_block(view[i : min(i + step, len(payload))], (i - start) // UNIT * _FRAME_MS, lacing) for i in range(start, min(start + step * CLUSTER_BLOCKS, len(payload)), step))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, begin) + _element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, at))))
        parts.append(_element(CLUSTER, _uint(TIMESTAMP, begin) + blocks))
        at += len(parts[-1])
    return _HEADER + _element(SEGMENT, b"".join([*parts, _element(CUES, b"".join(cues))]))


def vint(data: bytes, at: int, keep_marker: bool) -> tuple[int, int, bool]:
    """(value, position after it, all data bits set) of the variable-length integer at ``at``."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no element at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"cut off at byte {at}")
    raw = int.from_bytes(data[at : at + width], "big")
    value = raw & ((1 << 7 * width) - 1)
    return (raw if keep_marker else value), at + width, value == (1 << 7 * width) - 1


def _elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, start of the body, end of the body, start) of the elements from ``at`` to ``end``."""
    while at < end:
        begin = at
        key, body, _ = vint(data, at, True)
        size, body, unknown = vint(data, body, False)
        stop = end if unknown else body + size
        if stop > end:
            raise ValueError(f"element {key:X} at byte {at} is cut off")
        if unknown and key == CLUSTER:
            stop = body
            while stop < end:
                inner, start, _ = vint(data, stop, True)
                if inner in _TOP:
                    break
                size, start, _ = vint(data, start, False)
                stop = start + size
        yield key, body, stop, begin
        at = stop


def _number(data: bytes, start: int, end: int) -> int:
    return int.from_bytes(data[start:end], "big")


def _frames(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """(track, relative time, flags, byte ranges of the frames) of a block's body."""
    track, at, _ = vint(data, at, False)
    time, flags, at = int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2], at + 3
    lacing = flags >> 1 & 3
    if lacing == NO_LACING:
        return track, time, flags, [(at, end)]
    n, at = data[at] + 1, at + 1
    if lacing == FIXED:
        each, odd = divmod(end - at, n)
        if odd:
            raise ValueError("frames of a fixed lacing differ in size")
        return track, time, flags, [(at + i * each, at + (i + 1) * each) for i in range(n)]
    sizes: list[int] = []
    for i in range(n - 1):
        if lacing == XIPH:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
        else:
            before = at
            size, at, _ = vint(data, at, False)
            sizes.append(size if not i else sizes[-1] + size - ((1 << 7 * (at - before) - 1) - 1))
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("a lacing is longer than its block")
    ends = np.cumsum([at, *sizes]).tolist()
    return track, time, flags, list(zip(ends[:-1], ends[1:], strict=True))


def packets(data: bytes) -> dict:
    """Tracks, cues and the packet table of a Matroska file.

    ``packets``: (track, cluster, block, frame, time in ns, keyframe, start, end), the last two being
    the byte range in the file.  Times of later frames of a lacing follow the track's default
    duration where it has one.  ``cues``: (time in ns, track, byte position of the cluster).
    ``clusters``: (byte position, time in ns).
    """
    out: dict = {"tracks": {}, "cues": [], "packets": [], "clusters": [], "duration": None, "scale": 1_000_000}
    for key, body, end, _ in _elements(data, 0, len(data)):
        if key == SEGMENT:
            _segment(data, body, end, out)
    return out


def _segment(data: bytes, begin: int, end: int, out: dict) -> None:
    blocks = 0
    for key, body, stop, place in _elements(data, begin, end):
        if key == INFO:
            for k, a, z, _ in _elements(data, body, stop):
                if k == TIMESTAMP_SCALE:
                    out["scale"] = _number(data, a, z)
                elif k == DURATION:
                    out["duration"] = float(np.frombuffer(data[a:z], ">f8" if z - a == 8 else ">f4")[0])
        elif key == TRACKS:
            for k, a, z, _ in _elements(data, body, stop):
                if k == TRACK_ENTRY:
                    track = dict(_leaves(data, a, z))
                    out["tracks"][int.from_bytes(track.get(TRACK_NUMBER, b"\x01"), "big")] = track
        elif key == CUES:
            for k, a, z, _ in _elements(data, body, stop):
                if k == CUE_POINT:
                    cue = dict(_leaves(data, a, z))
                    out["cues"].append((int.from_bytes(cue[CUE_TIME], "big") * out["scale"], int.from_bytes(cue[CUE_TRACK], "big"), begin + int.from_bytes(cue[CUE_CLUSTER_POSITION], "big")))
        elif key == CLUSTER:
            time, cluster = 0, len(out["clusters"])
            out["clusters"].append((place, 0))
            for k, a, z, _ in _elements(data, body, stop):
                key_frame = True
                if k == TIMESTAMP:
                    time = _number(data, a, z)
                    out["clusters"][-1] = (place, time * out["scale"])
                    continue
                if k == BLOCK_GROUP:
                    inner = {x: (p, q) for x, p, q, _ in _elements(data, a, z)}
                    if BLOCK not in inner:
                        continue
                    key_frame, (a, z) = REFERENCE_BLOCK not in inner, inner[BLOCK]
                elif k != SIMPLE_BLOCK:
                    continue
                number, relative, flags, ranges = _frames(data, a, z)
                lasts = int.from_bytes(out["tracks"].get(number, {}).get(DEFAULT_DURATION, b""), "big")
                at = (time + relative) * out["scale"]
                key_frame = key_frame if k == BLOCK_GROUP else bool(flags & 0x80)
                out["packets"] += [(number, cluster, blocks, i, at + i * lasts, key_frame, p, q) for i, (p, q) in enumerate(ranges)]
                blocks += 1


def _leaves(data: bytes, at: int, end: int) -> Iterator[tuple[int, bytes]]:
    for key, a, z, _ in _elements(data, at, end):
        if key in _MASTERS:
            yield from _leaves(data, a, z)
        else:
            yield key, data[a:z]


def samples(data: bytes, table: list[tuple]) -> bytes:
    """The bytes of the packets in ``table``; neighbouring ranges are read at once."""
    out, start, end = [], None, None
    for *_, a, z in table:
        if a != end:
            if start is not None:
                out.append(data[start:end])
            start = a
        end = z
    if start is not None:
        out.append(data[start:end])
    return b"".join(out)


def payload(data: bytes, found: dict, track: int = 1) -> bytes:
    """The samples of a track in the order of its cues (of the file, where it has none)."""
    places = {place: k for k, (place, _) in enumerate(found["clusters"])}
    tables: list[list[tuple]] = [[] for _ in places]
    for row in found["packets"]:
        if row[0] == track:
            tables[row[1]].append(row)
    order = list(range(len(tables)))
    if cues := sorted(c for c in found["cues"] if c[1] == track):
        for time, _, at in cues:
            if at not in places or found["clusters"][places[at]][1] != time:
                raise ValueError(f"the cue for {time} ns leads to no cluster of that time")
        order = [places[at] for _, _, at in cues]
        if sorted(order) != [k for k, t in enumerate(tables) if t]:
            raise ValueError("the cues leave out a cluster")
    return b"".join(samples(data, tables[k]) for k in order)


def _text_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def media_column(text: str):
    """A binary column: the Matroska file with the UTF-8 bytes of the string column ``text``."""

    @F.pandas_udf("binary")
    def muxed(texts: pd.Series) -> pd.Series:
        return pd.Series([mux(pad(_text_bytes(x))) for x in texts], dtype=object)

    return muxed(F.col(text))


def media_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media) of each row: the text's bytes without padding, and its file."""
    own_names(key, "n_bytes", "media")
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(key), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), media_column(text).alias("media"))


PACKETS = "track:int,cluster:int,block:int,frame:int,time_ns:long,keyframe:boolean,start:long,end:long"
#: What the bytes of a broken file can raise in the parser.
_BROKEN = (ValueError, IndexError, KeyError, OverflowError)


def packet_table(media: DataFrame, data: str) -> DataFrame:
    """``media`` with one row for each packet of the binary column ``data``, which goes, and ``error``;
    new columns that clash with others get the prefix ``packet_``.  A file without packets, a null and a
    broken file give one row without a packet, a broken one with its ``error``."""

    @F.pandas_udf(f"struct<error:string,packets:array<struct<{PACKETS}>>>")
    def parse(files: pd.Series) -> pd.DataFrame:
        out, names = [], [c.split(":")[0] for c in PACKETS.split(",")]
        for x in files:
            try:
                rows, error = packets(bytes(x))["packets"] if x is not None else [], None
            except _BROKEN as e:
                rows, error = [], f"{type(e).__name__}: {e}"
            out.append((error, [dict(zip(names, p, strict=True)) for p in rows]))
        return pd.DataFrame(out, columns=["error", "packets"])

    names = {c.lower() for c in media.columns if c != data}
    cell, at = fresh(media, "cell", "at")
    rows = media.withColumn(cell, parse(F.col(data))).drop(data)
    rows = rows.select(*[F.col(f"`{c}`") for c in rows.columns], F.explode_outer(f"{cell}.packets").alias(at))
    named = lambda c: f"packet_{c}" if c in names else c
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c not in (cell, at)], *[F.col(f"{at}.{f.name}").alias(named(f.name)) for f in rows.schema[at].dataType.fields], F.col(f"{cell}.error").alias(named("error")))


def _feature(found: dict, levels: np.ndarray) -> str:
    track, table = found["tracks"][1], found["packets"]
    rate = float(np.frombuffer(track[SAMPLING_FREQUENCY], ">f8" if len(track[SAMPLING_FREQUENCY]) == 8 else ">f4")[0])
    lasts = int.from_bytes(track[DEFAULT_DURATION], "big")
    return (
        f"{track[CODEC_ID].decode()} {int.from_bytes(track[BIT_DEPTH], 'big')}-bit {rate:g} Hz; {len(found['clusters'])} clusters, {table[-1][2] + 1} blocks, {len(table)} packets, {len(found['cues'])} cues; "
        f"{(table[-1][4] + lasts) // 1_000_000} ms; level {int(levels.min())} to {int(levels.max())}, mean {int(levels.sum(dtype=np.int64)) / len(levels):.6f}; crossings {int(np.count_nonzero(np.diff(levels >= 128)))}"
    )


def _digest(media: bytes | None) -> tuple:
    if media is None:
        return (None,) * 6 + ("no file",)
    try:
        found = packets(media)
        read = payload(media, found)
        feature = _feature(found, np.frombuffer(read, np.uint8))
    except _BROKEN as e:
        return (None,) * 6 + (f"{type(e).__name__}: {e}",)
    return len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature, None


DIGEST = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def media_digests(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, sizes and digests of the payload as read back and of the stored file, feature,
    error) for each row of a :func:`media_table`.  The feature is of the parsed track, packet table and
    samples.  A broken or missing file has an ``error`` and nulls."""
    own_names(key, "n_bytes", *[x.split()[0] for x in DIGEST.split(", ")])
    bounded_batches(stored.sparkSession)

    @F.pandas_udf(DIGEST)
    def digest(files: pd.Series) -> pd.DataFrame:
        done = pd.DataFrame([_digest(None if x is None else bytes(x)) for x in files], columns=[x.split()[0] for x in DIGEST.split(", ")], dtype=object)
        return done.astype({c: "Int64" for c in ("payload_bytes", "tail_crc32", "media_bytes")})

    return stored.select(F.col(key), "n_bytes", digest(F.col("media")).alias("digest")).select(key, "n_bytes", "digest.*")
