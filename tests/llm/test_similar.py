"""The pipeline's near-duplicate stage against the similarity of all pairs.

The index misses a few links by chance, which is the same chance in each run: the made-up texts here lose none."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vicinity.llm import buckets, similar


def _set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def _components(texts):
    sets, label = [_set(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return label


def _texts(seed, n):
    rng, out = random.Random(seed), []
    bases = [[f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(30, 300))] for _ in range(n // 8)]
    for _ in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 2, 4, 6, 8])):
            words[rng.randrange(len(words))] = f"w{rng.randint(0, 5000)}"
        out.append((" ".join if rng.random() < 0.8 else "\n ".join)(words).upper())
    return [*out, None, "", " ", "one two", "ONE two", "a b c d e", "a b c d e f"]


def test_the_stage_links_what_is_similar_and_nothing_else(spark, tmp_path):
    texts = _texts(4, 400)
    spark.createDataFrame([(i, t, i * 2) for i, t in enumerate(texts)], "doc_id long, text string, node int").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    label = _components(texts)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    least = {}
    for i, k in enumerate(label):
        least.setdefault(k, i)
    assert 20 < len(least) < len(texts) - 100
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(least.values())


def test_a_long_chain_of_similar_texts_is_one_group(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i * 8, i * 8 + 100)), "x") for i in range(60)]
    assert [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "").collect()] == [0]


def test_the_stage_on_the_documents_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    label, least = _components([t for _, t in rows]), {}
    for (d, _), k in zip(rows, label, strict=True):
        least.setdefault(k, d)
    assert Counter(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()) == Counter(least.values())


@pytest.mark.parametrize("part", [2, 1024])
def test_values_with_many_texts_are_dealt_over_tasks(spark, tmp_path, monkeypatch, part):
    monkeypatch.setattr(buckets, "PART", part)
    monkeypatch.setattr(buckets, "HUBS", 1)
    texts = _texts(9, 250)
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    least = {}
    for i, k in enumerate(_components(texts)):
        least.setdefault(k, i)
    got = similar.drop_similar(spark.read.parquet(f"{tmp_path}/d"))
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(least.values())


def test_without_the_index_no_link_is_found(spark, monkeypatch):
    """Segments that are looked up are the only way to a link; the balls around them find more than they do."""
    texts = _texts(4, 300)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    whole, sets = similar.drop_similar(docs).count(), len({frozenset(_set(t)) for t in texts})
    monkeypatch.setattr(similar, "neighbours", lambda rooted: rooted.selectExpr("key a", "key b").where("false"))
    exact = similar.drop_similar(docs).count()
    monkeypatch.setattr(similar, "segments", lambda nodes: nodes.withColumn("key", F.explode(F.array(F.col("id")))))
    assert whole < exact < similar.drop_similar(docs).count() == sets


def test_close_values_are_those_within_two_bits(monkeypatch):
    monkeypatch.setattr(similar, "DIRECT", 8)
    rng = np.random.default_rng(2)
    for bits, n in ((4, 16), (9, 200), (21, 400)):
        free = [int(b) for b in rng.choice(32, bits, replace=False)]
        base = rng.integers(0, 2, (12, bits))
        flips = np.concatenate([base, *(base ^ (rng.random((12, bits)) < 0.15) for _ in range(n // 10))])
        values = np.unique((flips << np.array(free)).sum(axis=1).astype(np.uint32))
        i, j = similar.close_values(values, free)
        want = {(a, b) for a in range(len(values)) for b in range(a + 1, len(values)) if int(values[a] ^ values[b]).bit_count() <= 2}
        assert len(i) == len(want) and set(zip(i.tolist(), j.tolist(), strict=True)) == want


@pytest.mark.parametrize(("few", "taken"), [(48, 1 << 16), (2, 1), (3, 5)])
def test_neighbours_over_batches_and_pieces(spark, monkeypatch, few, taken):
    rng = np.random.default_rng(8)
    values = {int(v) for v in rng.integers(0, 2**32, 30)}
    for v in list(values):
        for _ in range(4):
            values.add(v ^ sum(1 << int(b) for b in rng.choice(32, rng.integers(1, 4), replace=False)))
    rows = [(s << 32 | v, int(rng.integers(0, 3))) for s in (0, similar.SEGMENTS - 1) for v in values for _ in range(2)]
    roots = {}
    for k, r in rows:
        roots.setdefault(k, set()).add(r)
    want = {(a, b) for a in roots for b in roots if a < b and a >> 32 == b >> 32 and (a ^ b).bit_count() <= 2 and len(roots[a] | roots[b]) > 1}
    sorted_rows = sorted((((k >> 32) * 3 + p) * 2048 + (((k & 0xFFFFFFFF) >> similar.PIECES[p]) & ((1 << similar.PIECES[p + 1] - similar.PIECES[p]) - 1)), k, min(r) if len(r) == 1 else similar.MIXED) for k, r in roots.items() for p in range(3))
    monkeypatch.setattr(similar, "FEW", few)
    monkeypatch.setattr(similar, "TAKEN", taken)
    batches = (pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*sorted_rows[i : i + 3], strict=True)], list("pkr")) for i in range(0, len(sorted_rows), 3))
    mine = [tuple(sorted(p)) for b in similar._neighbours(batches) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert len(mine) == len(set(mine)) and set(mine) == want
    got = [tuple(sorted(r)) for r in similar.neighbours(spark.createDataFrame(rows, "key long, root long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_fingerprints_of_similar_sets_are_within_the_limits():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 30, 300, 3000):
        for _ in range(20):
            both, only = rng.integers(0, 2**64, 8 * n, np.uint64), rng.integers(0, 2**64, (2, n), np.uint64)
            a, b = (np.concatenate([both, x]) for x in only)
            small = 9 * n < similar.SMALL
            assert buckets.alike(np.sort(a), np.sort(b))
            for bits, most in ((32 * similar.SEGMENTS, similar.APART_SMALL if small else similar.APART), (similar.FINE, similar.FINE_APART_SMALL if small else similar.FINE_APART)):
                assert np.bitwise_count((similar.fingerprint(a, bits) ^ similar.fingerprint(b, bits)).view(np.uint64)).sum() <= most
    far = rng.integers(0, 2**64, (2, 500), np.uint64)
    assert np.bitwise_count((similar.fingerprint(far[0]) ^ similar.fingerprint(far[1])).view(np.uint64)).sum() > 430


def test_pairs_are_checked_in_turns(spark, monkeypatch):
    """The sets of all pairs are never shuffled at once, and turns give what one gives."""
    sets = spark.createDataFrame([(i, np.arange(i // 4 * 100, i // 4 * 100 + 20 + i % 4, dtype=np.uint64).tobytes()) for i in range(40)], "id long, set binary")
    pairs = spark.createDataFrame([(i, j) for i in range(40) for j in range(i + 1, min(40, i + 6))], "a long, b long")
    saved, kept = [], buckets.save
    monkeypatch.setattr(buckets, "save", lambda df, name, *a: saved.append(name) or kept(df, name, *a))
    one = {tuple(r) for r in buckets.checked(pairs, sets).collect()}
    assert saved.count("alike") == 1
    monkeypatch.setattr(buckets, "PAIRS_EACH", 40)
    got = [tuple(r) for r in buckets.checked(pairs, sets).collect()]
    assert saved.count("alike") == 1 + 5 and len(got) == len(set(got)) and set(got) == one == {(i, j) for i in range(40) for j in range(i + 1, i // 4 * 4 + 4)}


def test_only_texts_in_question_are_looked_up(spark, monkeypatch):
    """A text is fingerprinted if enough of its shingles are another's too: a line that all have is not enough."""
    rng, line = random.Random(5), " ".join(f"c{i}" for i in range(25))
    texts = [line + " " + " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(150, 400))) for _ in range(60)]
    alike = [t.rsplit(" ", 3)[0] + " x y z" for t in texts[:4]]
    looked, segments = [], similar.segments
    monkeypatch.setattr(similar, "segments", lambda nodes: looked.append(nodes.count()) or segments(nodes))
    docs = spark.createDataFrame(list(enumerate([*texts, *alike, line])), "doc_id long, text string")
    assert Counter(r["doc_id"] for r in similar.drop_similar(docs).collect()) == Counter([*range(60), 64])
    assert looked and set(looked) <= {8, 9}


def test_similar_sets_are_in_question(spark):
    rng, rows, far = np.random.default_rng(6), [], []
    for n in (1, 2, 3, 5, 12, 30, 31, 40, 80, 120, 1000):
        for only in {0, n // 5} if n > 1 else {0}:  # similarity 0.8 at least: both, and what one set or the other has alone
            for side in (0, 1):
                both, mine = rng.integers(0, 2**64, n - only, np.uint64), rng.integers(0, 2**64, only, np.uint64)
                a, b = (both, np.concatenate([both, mine])) if side else (np.concatenate([both, mine[: only // 2]]), np.concatenate([both, mine[only // 2 :]]))
                rows += [(len(rows) + i, np.sort(x)) for i, x in enumerate((a, b))]
        far.append((1000 + n, np.sort(rng.integers(0, 2**64, n, np.uint64))))
    nodes = spark.createDataFrame([(i, len(s), s[: similar.LEAST].view(np.int64).tolist()) for i, s in [*rows, *far]], "id long, n long, least array<long>")
    assert sorted(r["id"] for r in similar.in_question(nodes).collect()) == [i for i, _ in rows]


def test_a_family_of_texts_that_are_not_similar_enough_is_one_bucket(spark, monkeypatch):
    """Texts of one family under 0.8 have neighbouring segments in nearly every pair; these pairs are not made one by one."""
    rng, base = random.Random(7), [f"w{i}" for i in range(200)]
    texts = []
    for i in range(200):
        words = list(base)
        for k in range(4):
            words[50 * k + rng.randint(10, 40)] = f"x{i}-{k}"
        texts.append(" ".join(words))
    label, rows, kept = _components(texts), [], similar.save
    monkeypatch.setattr(similar, "save", lambda df, name, *a: (out := kept(df, name, *a), name == "met" and rows.append(out.count()))[0])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = Counter(r["doc_id"] for r in similar.drop_similar(docs).collect())
    assert 100 < len(set(label)) and got == Counter({k: i for i, k in reversed(list(enumerate(label)))}.values())
    assert rows and rows[0] < 20 * len(texts)


def test_rows_grow_with_the_texts_of_a_group_not_with_its_pairs(spark, monkeypatch):
    """Nearly all pairs of these texts are close by fingerprint and few are similar: no table has a row for each."""
    rng, base, texts = random.Random(11), [f"w{i}" for i in range(200)], []
    for i in range(300):
        words = list(base)
        for k in range(3):
            words[65 * k + rng.randint(5, 60)] = f"x{i}-{k}"
        texts.append(" ".join(words))
    rows, kept = {}, similar.save
    for module in (similar, buckets):
        monkeypatch.setattr(module, "save", lambda df, name, *a: (out := kept(df, name, *a), rows.update({name: max(out.count(), rows.get(name, 0))}))[0])
    least = {k: i for i, k in reversed(list(enumerate(_components(texts))))}
    got = similar.drop_similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(least.values())
    assert max(rows.values()) <= similar.SEGMENTS * len(texts), rows


def test_nothing_is_lost_where_no_families_are_merged(spark, monkeypatch):
    """Stars of neighbouring values alone, of several families each, give the links of the pairs."""
    monkeypatch.setattr(similar, "LOOSE", -1)
    monkeypatch.setattr(similar, "MANY", 0)
    texts = _texts(9, 250)
    least = {k: i for i, k in reversed(list(enumerate(_components(texts))))}
    got = similar.drop_similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(least.values())


def test_a_place_full_of_neighbours_gives_stars():
    values = np.unique(np.array([sum(1 << b for b in c) for i in range(21) for c in ((i,), (i, (i + 1) % 21))] + [0], np.int64)) << 11
    place, key = np.zeros(len(values), np.int64), np.sort(values)
    for root in (np.arange(len(values)), np.full(len(values), similar.MIXED)):
        pairs = [p for a, b in similar._pairs_of(place, key, root) for p in zip(a.tolist(), b.tolist(), strict=True)]
        assert sorted(pairs) == [(0, int(k)) for k in key[1:]]
    assert all(not len(a) for a, _ in similar._pairs_of(place, key, np.full(len(values), 5)))
