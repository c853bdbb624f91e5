import io
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vicinity.llm import idplanes, packing, tokencount
from vicinity.llm.tokens import Encoder, default_path, encoder

WORDS, BYTES = default_path("word_bpe_49k.json"), default_path("byte_bpe_50k.json")


def _texts(seed=0, n=400):
    rng = random.Random(seed)
    pieces = ["the", "The", "don't", "it's", " ", "  ", "\n", "\t", "\x0b", " ", " ", "\x1c", "\x85", "½", "é", "é", "Σ", "ΟΔΟΣ", "İ", "ß", "日本", "😀", "1234", "...", "!?", "$$$", "hest.", "hest,", "'s", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "x" * 80, "ﬁ", "\u0000"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["", " ", "a" * 20_000, "½", "½ ½.", "hest.", "é."]


def test_ids_are_those_of_whole_texts():
    library, own, texts = Tokenizer.from_file(WORDS), Encoder(WORDS), _texts()
    for part in (texts, texts[::-1]):  # unseen, then remembered
        for text, ids in zip(part, own.ids_bytes_many(part), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    assert own.ids_bytes(None) == b""


def test_other_tokenizers_encode_whole_texts():
    library, own = Tokenizer.from_file(BYTES), Encoder(BYTES)
    assert not own.splits and own.ids("a  b\n c").tolist() == library.encode("a  b\n c", add_special_tokens=False).ids


def test_memory_turns_over(monkeypatch):
    from vicinity.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED_BYTES", 20 * (tokens.OVERHEAD + 8))
    own, library = Encoder(WORDS), Tokenizer.from_file(WORDS)
    for k in range(12):
        text = " ".join(f"w{k * 7 % 50 + i}" for i in range(15))
        assert own.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(own.new) <= 60 and own.old


def test_counts_are_those_of_the_library():
    library, own, texts = Tokenizer.from_file(BYTES), tokencount.Counter(BYTES), _texts(1) + ["aaaa" * 50, "a b  c", " x", "x ", "\xa0 \xa0 \n a", "ab <|endoftext|>c"]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert own.count_many(texts).tolist() == want == own.count_many(texts).tolist()
    assert own.count_many([None]).tolist() == [0]


def test_merges_take_the_lowest_rank_everywhere():
    own = tokencount.Counter(BYTES)
    words = ["aaaaa", "hello", "mississippi", "zzzzzzzzz"]
    library = Tokenizer.from_file(BYTES)
    assert own.merge([w.encode() for w in words]).tolist() == [len(library.encode(w, add_special_tokens=False).ids) for w in words]


def _docs(spark):
    rng = random.Random(4)
    rows = [(i * 13 % 211, t, i) for i, t in enumerate(_texts(2, 150))] + [(None, "no id", 0), (None, None, 1), (7, "seven again", 2), (7, "seven again", 2), (500, " ".join(f"w{rng.randint(0, 9999)}" for _ in range(30_000)), 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, piece int").repartition(5)


def test_count_query(spark):
    docs, library = _docs(spark), Tokenizer.from_file(BYTES)
    got = tokencount.count_tokens(docs, BYTES).collect()
    want = [(r["doc_id"], len((r["text"] or "").encode()), n := len(library.encode(r["text"] or "", add_special_tokens=False).ids), n > 512) for r in docs.collect()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert tokencount.count_tokens(docs.where(F.lit(False)), BYTES).count() == 0


@pytest.mark.parametrize("mode", ["bit", "byte"])
@pytest.mark.parametrize("top", [0, 1, 49407, 2**32 - 1])
def test_files_round_trip(mode, top):
    rng, out = np.random.default_rng(top % 97), io.BytesIO()
    docs = [rng.integers(0, top + 1, int(n), dtype=np.uint64).astype("<u4") for n in (0, 1, 999, 1000, 1001, 0, 3500, 5)]
    writer = idplanes.Writer(out, mode, 1000)
    for i, d in enumerate(docs):
        writer.add(None if i == 2 else -i, d.tobytes())
    assert writer.close() == sum(map(len, docs))
    reader = idplanes.Reader(out)
    for i, (k, ids) in enumerate(reader.documents()):
        assert k == (None if i == 2 else -i) and ids.tolist() == docs[i].tolist()
    whole = np.concatenate(docs)
    for a, b in ((0, 0), (0, 1), (999, 1001), (1500, 4200), (0, len(whole))):
        assert reader.ids(a, b).tolist() == whole[a:b].tolist()
    with pytest.raises(ValueError, match="not a whole file"):
        idplanes.Reader(io.BytesIO(out.getvalue()[:-5]))


def test_id_files_have_all_documents_in_key_order(spark):
    docs, own = _docs(spark), Encoder(WORDS)
    files = idplanes.write_id_files(docs, WORDS, parts=4, block=4096, ids_a_file=2000)
    got = idplanes.read_id_files(files).orderBy("start").collect()
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in rows]
    ends = [r["start"] + r["n_tokens"] for r in got]
    assert [r["start"] for r in got] == [0, *ends[:-1]]
    crc = lambda t: zlib.crc32(own.ids_bytes(t) + np.array([1], "<u4").tobytes())
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in got) == Counter((r["doc_id"], crc(r["text"])) for r in rows)
    assert idplanes.read_id_files(idplanes.write_id_files(docs.where(F.lit(False)), WORDS)).count() == 0


def _brute_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        best = min((i for i, r in enumerate(rooms) if r >= n), key=lambda i: rooms[i], default=None)
        if best is None:
            rooms.append(capacity - n)
        else:
            rooms[best] -= n
    return sorted(rooms)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(9)
    for _ in range(150):
        capacity = rng.choice([1, 7, 10, 64, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 90))]
        runs, bins = packing.plan(dict(Counter(lengths)), capacity)
        fill = {}
        for n, count in Counter(lengths).items():
            for r in range(count):
                rank, first, each, offset = max(x for x in runs[n] if x[0] <= r)
                fill.setdefault(first + (r - rank) // each, []).append((offset + (r - rank) % each * n, n))
        rooms = []
        for items in fill.values():
            at = 0
            for offset, n in sorted(items):
                assert offset == at
                at += n
            rooms.append(capacity - at)
        assert len(fill) == bins and sorted(rooms) == _brute_fit(lengths, capacity)


def test_packing_query(spark):
    docs, own = _docs(spark), Encoder(WORDS)
    got = packing.pack_documents(docs, WORDS, with_ids=True).collect()
    lengths = []
    want = Counter()
    for r in docs.collect():
        ids = own.ids_bytes(r["text"]) + np.array([1], "<u4").tobytes()
        for k, at in enumerate(range(0, len(ids), 4 * 4096)):
            part = ids[at : at + 4 * 4096]
            lengths.append(len(part) // 4)
            want[r["doc_id"], k, at // 4, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in got)
    bins = {}
    for r in sorted(got, key=lambda r: r["offset"]):
        assert bins.setdefault(r["sequence_id"], 0) == r["offset"]
        bins[r["sequence_id"]] += r["length"]
    assert sorted(4096 - n for n in bins.values()) == _brute_fit(lengths, 4096)
    assert packing.pack_documents(docs.where(F.lit(False)), WORDS).count() == 0


def test_packing_keeps_clashing_columns(spark):
    rows = spark.createDataFrame([(i, i % 9 + 1, i, i, i) for i in range(50)], "id int, length int, rank int, bucket int, n int")
    got = packing.pack(rows, "length", ["id"], 10)
    assert got.columns == [*rows.columns, "sequence_id", "offset"] and got.count() == 50
    with pytest.raises(ValueError, match="lengths"):
        packing.pack(rows, "length", ["id"], 5)


def test_memories_are_bounded_in_bytes(monkeypatch):
    from vicinity.llm import tokens

    rng = random.Random(9)
    texts = ["".join(rng.choices("abcdefghij", k=rng.choice([3, 9, 100]))) + rng.choice(["", ".", ",", "\u00e9!", "9"]) + " " + " ".join(f"w{rng.randint(0, 400)}" for _ in range(6)) for _ in range(600)]
    monkeypatch.setattr(tokens, "REMEMBERED_BYTES", 30_000)
    monkeypatch.setattr(tokencount, "REMEMBERED_BYTES", 30_000)
    ids, count, words, plain = Encoder(WORDS), tokencount.Counter(BYTES), Tokenizer.from_file(WORDS), Tokenizer.from_file(BYTES)
    for at in range(0, 600, 30):
        part = texts[at : at + 30]
        assert [len(x) // 4 for x in ids.ids_bytes_many(part)] == [len(words.encode(t, add_special_tokens=False).ids) for t in part]
        assert count.count_many(part).tolist() == [len(plain.encode(t, add_special_tokens=False).ids) for t in part]
        for own, each, over in ((ids, 1, tokens.OVERHEAD), (count, 2, tokencount.OVERHEAD)):
            assert max(map(len, own.new), default=0) <= 64
            held = sum(over + each * len(k) + (len(v) if each == 1 else 0) for k, v in own.new.items() if k)
            assert own.held == held < 60_000 and len(own.old) * over < 60_000


def test_files_hold_a_bounded_number_of_ids(spark):
    docs = _docs(spark)
    files = idplanes.write_id_files(docs, WORDS, parts=2, ids_a_file=500).collect()
    longest = 200_000
    assert len(files) > 4 and all(r["ids"] < 500 + longest for r in files)
    assert sum(r["documents"] for r in files) == docs.count()
    with pytest.raises(ValueError, match="whole numbers"):
        idplanes.write_id_files(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text"), WORDS)


def test_equal_rows_are_spread_over_files(spark):
    docs = spark.createDataFrame([(7, "the same text again")] * 200, "doc_id long, text string").repartition(4)
    files = idplanes.write_id_files(docs, WORDS, parts=4, ids_a_file=100)
    got = idplanes.read_id_files(files).orderBy("start").collect()
    assert [r["start"] for r in got] == [5 * i for i in range(200)] and files.count() >= 8


@pytest.mark.parametrize("uri", ["{}", "file:{}", "file://{}"])
def test_folders_are_found_in_any_writing(tmp_path, uri):
    system, path = idplanes._filesystem(uri.format(tmp_path))
    assert path == str(tmp_path) and system.type_name == "local"


def test_runs_of_marks_behind_words_are_taken_apart(monkeypatch):
    import string

    rng, own, library, seen = random.Random(2), Encoder(WORDS), Tokenizer.from_file(WORDS), []
    whole = own._encode_rest
    monkeypatch.setattr(own, "_encode_rest", lambda units: seen.extend(units) or whole(units))
    marks = [a + b for a in ["", *string.punctuation] for b in string.punctuation] + ["".join(rng.choices(string.punctuation, k=rng.randint(3, 9))) for _ in range(500)]
    units = [rng.choice(["word", "Adoci\u00f3nes", "\u00dfen", "S", "t", "x" * 70, "\u00c9t\u00c9", "1a", "a1", "\u65e5", ""]) + m for m in marks for _ in range(3)]
    texts = [" ".join(units[i : i + 7]) for i in range(0, len(units), 7)] + units
    for part in (texts, texts[::-1]):
        for text, ids in zip(part, own.ids_bytes_many(part), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    plain = [u for u in seen if u.decode()[:1].isalpha() and u.decode().rstrip(string.punctuation).isalpha() and max(u.decode()) <= "\u00ff"]
    assert seen and plain and all(b"'" in u or b"<" in u for u in plain)


def test_pieces_of_words_with_marks(spark):
    texts, library, own = ["word### other$$$ Word!! été,### it's## " * 700, "word*** a", None], Tokenizer.from_file(WORDS), Encoder(WORDS)
    own.ids_bytes_many(texts)
    assert {b"word", b"other", "été".encode()} <= own.new.keys()  # remembered without their marks
    want = Counter()
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        want.update((i, at // 16384, zlib.crc32(ids[at : at + 16384])) for at in range(0, len(ids), 16384))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = packing.pack_documents(docs, WORDS).collect()
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in got) == want and len(want) > 3
