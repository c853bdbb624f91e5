import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinity.llm import matroska as m
from vicinity.llm.common import save


@pytest.mark.parametrize("lacing", [m.NO_LACING, m.XIPH, m.FIXED, m.EBML_LACING])
@pytest.mark.parametrize("frames", [1, 2, 127, 128, 129, 5000])
def test_samples_round_trip(lacing, frames):
    payload = np.random.default_rng(frames).integers(0, 256, 64 * frames, dtype=np.uint8).tobytes()
    data = m.mux(payload, lacing)
    found = m.packets(data)
    assert m.samples(data, found["packets"]) == payload and len(found["packets"]) == frames
    assert [p[4] for p in found["packets"]] == [8_000_000 * i for i in range(frames)]
    assert found["duration"] == 8 * frames and found["tracks"][1][m.CODEC_ID] == b"A_PCM/INT/LIT"
    times = {}
    for p in found["packets"]:
        times.setdefault(p[1], p[4])
    for (time, track, at), (cluster, first) in zip(found["cues"], sorted(times.items()), strict=True):
        key, _, _ = m.vint(data, at, True)
        assert (key, track, time) == (m.CLUSTER, 1, first) and (at, time) == found["clusters"][cluster]
    assert m.payload(data, found) == payload
    with pytest.raises(ValueError, match="leads to no cluster"):
        m.payload(data, found | {"cues": [(time, track, at + 1)]})
    if len(found["cues"]) > 1:
        with pytest.raises(ValueError, match="leave out"):
            m.payload(data, found | {"cues": found["cues"][1:]})


def test_other_writers_files():
    block = lambda lacing, body: b"\x82" + (5).to_bytes(2, "big") + bytes([lacing << 1]) + body
    xiph = block(m.XIPH, bytes([2, 255, 45, 3]) + b"a" * 300 + b"b" * 3 + b"c" * 9)
    ebml = block(m.EBML_LACING, b"\x02" + m._size(500) + (0x5FFF - 300).to_bytes(2, "big") + b"d" * 500 + b"e" * 200 + b"f")
    group = m._element(m.BLOCK_GROUP, m._element(m.BLOCK, xiph) + m._element(m.REFERENCE_BLOCK, b"\xff"))
    void = b"\xec" + m._size(3, 8) + b"xyz"
    clusters = b"".join(m._id(m.CLUSTER) + b"\x01\xff\xff\xff\xff\xff\xff\xff" + m._uint(m.TIMESTAMP, t) + x for t, x in ((100, void + group), (200, m._element(m.SIMPLE_BLOCK, ebml))))
    data = m._HEADER + m._id(m.SEGMENT) + b"\xff" + void + m._element(m.TRACKS, m._element(m.TRACK_ENTRY, m._uint(m.TRACK_NUMBER, 2))) + clusters
    found = m.packets(data)["packets"]
    assert [(p[0], p[1], p[4], p[5], p[7] - p[6]) for p in found] == [(2, 0, 105_000_000, False, n) for n in (300, 3, 9)] + [(2, 1, 205_000_000, False, n) for n in (500, 200, 1)]
    assert m.samples(data, found) == b"a" * 300 + b"bbb" + b"c" * 9 + b"d" * 500 + b"e" * 200 + b"f"


def test_variable_length_numbers():
    for n in (0, 1, 126, 127, 16382, 16383, 2**21, 2**56 - 2):
        size = m._size(n)
        assert m.vint(size, 0, False) == (n, len(size), False)
    assert m.vint(b"\xff", 0, False)[2] and m.vint(b"\x1a\x45\xdf\xa3", 0, True)[0] == m.EBML
    for bad in (b"", b"\x00\x01", b"\x40"):
        with pytest.raises(ValueError):
            m.vint(bad, 0, False)


def test_query_and_packet_table(spark):
    texts = ["", None, "a", "x" * 64, "ä" * 40_000, "x" * 64]
    docs = spark.createDataFrame([(i if i else None, t, "s", i) for i, t in enumerate(texts)], "doc_id long, text string, track string, start int")
    stored = save(m.media_table(docs), "media")
    for r in m.media_digests(stored).collect():
        raw = (texts[r["doc_id"] or 0] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or 64 * (not raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["error"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), None)
        assert r["media_sha256"] == hashlib.sha256(m.mux(payload)).hexdigest() and r["media_bytes"] == len(m.mux(payload)) and "8000 Hz" in r["feature"]
    same = {r["feature"] for r in m.media_digests(stored).where("doc_id in (3, 5)").collect()}
    assert len(same) == 1 and m.media_digests(stored.where(F.lit(False))).count() == 0
    file = m.mux(b"x" * 64)
    broken = [b"broken", None, file[:-3], file[:60], file.replace(m._uint(m.CUE_TIME, 0), m._uint(m.CUE_TIME, 9))]
    extra = spark.createDataFrame([(i + 9, "t", 0, x) for i, x in enumerate(broken)], "doc_id long, track string, start int, data binary")
    bad = m.media_digests(extra.select("doc_id", F.lit(0).alias("n_bytes"), F.col("data").alias("media"))).collect()
    assert all(r["error"] and r["payload_sha256"] is None for r in bad) and len(bad) == len(broken)
    table = m.packet_table(docs.select("doc_id", "track", "start", m.media_column("text").alias("data")).unionByName(extra), "data")
    assert {"packet_track", "packet_start", "track", "start", "cluster", "time_ns", "end", "error"} <= set(table.columns)
    assert table.where("doc_id = 4").count() == 1250 and table.where("doc_id in (9, 10, 11, 12)").where("cluster is null and (error is not null) = (doc_id <> 10)").count() == 4
    with pytest.raises(ValueError, match="rename"):
        m.media_table(docs.withColumnRenamed("start", "n_bytes"), "n_bytes")
