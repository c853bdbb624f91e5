"""MinHash near-duplicates against the exact similarity of all pairs."""

import random
import time

import numpy as np
import pytest
from oracle import compare

from vicinity.llm import buckets, components, minhash, queries


def _set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def _brute(rows):
    sets, label = [_set(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and label[i] != label[j] and 100 * len(a & b) >= 80 * len(a | b):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {k: min((d for (d, _), x in zip(rows, label, strict=True) if x == k and d is not None), default=None) for k in set(label)}
    return sorted(((d, len(s), least[k], d is not None and d == least[k]) for (d, _), s, k in zip(rows, sets, label, strict=True)), key=str)


def _texts(seed, n):
    rng, out = random.Random(seed), []
    bases = [[f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(20, 300))] for _ in range(n // 8)]
    for _ in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 2, 4, 6, 8])):
            words[rng.randrange(len(words))] = f"w{rng.randint(0, 5000)}"
        out.append((" ".join if rng.random() < 0.8 else "\n ".join)(words).upper())
    return [*out, None, "", " \t", "one two", "ONE two", "a b c d", "a b c d e", "Ä b", "ä b", "x " * 50_000]


@pytest.mark.parametrize(("part", "hubs"), [(1024, 2), (2, 1)])
def test_rows_are_those_of_all_pairs(spark, monkeypatch, part, hubs):
    monkeypatch.setattr(buckets, "PART", part)
    monkeypatch.setattr(buckets, "HUBS", hubs)
    rows = [(i * 7 % 1009, t) for i, t in enumerate(_texts(part, 300))]
    rows += [(None, "w1 w2 w3"), (None, "w1 w2 w3"), (None, None), (3, rows[0][1]), rows[5], rows[-8]]
    docs = spark.createDataFrame([(d, t, "x", 1, b"") for d, t in rows], "doc_id long, text string, uid string, n int, name binary").repartition(4)
    got = minhash.near_duplicates(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    want = _brute(rows)
    assert 60 < len({r[2] for r in want}) < len(rows) - 100
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_the_query_gives_the_rows_of_its_sql(spark, sf_dir):
    compare(spark, sf_dir, queries.op12_minhash_near_dedup, queries.oracle_sql()["op12_minhash_near_dedup"])


def test_nothing_and_names(spark):
    schema = "doc_id long, text string"
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    got = minhash.near_duplicates(spark.createDataFrame([(4, None), (5, " "), (6, "only one")], schema)).collect()
    assert sorted(tuple(r) for r in got) == [(4, 0, 4, True), (5, 0, 5, True), (6, 1, 6, True)]
    with pytest.raises(ValueError, match="rename"):
        minhash.near_duplicates(spark.createDataFrame([(1, "a")], "kept long, text string"), key="kept")


def test_a_chain_of_similar_texts_is_one_group(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i * 8, i * 8 + 100))) for i in range(60)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["component_id"], r["n_shingles"]) for r in got} == {(0, 97)} and [r["doc_id"] for r in got if r["kept"]] == [0]


def test_signatures_of_similar_sets_are_near():
    rng = np.random.default_rng(3)
    for n in (1, 10, 100, 3000):
        both, only = rng.integers(0, 2**64, 8 * n, np.uint64), rng.integers(0, 2**64, (2, n), np.uint64)
        a, b = (np.unique(np.concatenate([both, x])) for x in only)
        assert buckets.alike(a, b)
        assert np.bitwise_count((minhash.longer(a) ^ minhash.longer(b)).view(np.uint64)).sum() <= minhash.FINE_APART
        x = minhash.signature(minhash.minima(a)) ^ minhash.signature(minhash.minima(b))
        assert np.bitwise_count(x[:2] | x[2:]).sum() <= minhash.APART
    far = rng.integers(0, 2**64, (2, 500), np.uint64)
    assert np.bitwise_count((minhash.longer(far[0]) ^ minhash.longer(far[1])).view(np.uint64)).sum() > 900


def test_the_share_of_equal_minima_is_the_similarity():
    rng = np.random.default_rng(9)
    both, only = rng.integers(0, 2**64, 500, np.uint64), rng.integers(0, 2**64, (2, 250), np.uint64)
    a, b = rng.integers(0, 2**64, (2, 4000), np.uint64)
    same = minhash.minima(np.concatenate([both, only[0]]), a, b) == minhash.minima(np.concatenate([both, only[1]]), a, b)
    assert abs(same.mean() - 0.5) < 0.03


def test_a_million_links_in_a_partition_take_seconds():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    ends = rng.integers(0, 2_000_000, (2, 1_000_000))
    batches = (pa.RecordBatch.from_arrays([pa.array(ends[0, i : i + 512]), pa.array(ends[1, i : i + 512])], ["node", "root"]) for i in range(0, 1_000_000, 512))
    began = time.process_time()
    got = pa.Table.from_batches(components._contract(batches))
    assert time.process_time() - began < 10
    nodes, roots = components.forest(*ends)
    assert dict(zip(got["node"].to_pylist(), got["root"].to_pylist(), strict=True)) == dict(zip(nodes.tolist(), roots.tolist(), strict=True))
