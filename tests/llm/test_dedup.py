import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64

from vicinity.llm import simhash
from vicinity.llm.components import components, forest


def _brute_print(text, n=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.translate({i: " " for i in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _brute_components(prints):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


TEXTS = [None, "", " \t\n", "Ä", "one", "One  TWO", "one two three", "one two three four", "a b c a b c a b c", "x " * 40_000, "Ümlaut É ß A B C\x0bD\x0cE", "İstanbul WORD word Word", "😀 😀 😀 😀"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint_is_that_of_its_definition(text):
    short = text[:3000] if text else text
    assert simhash.fingerprint(short) % (1 << 64) == _brute_print(short)
    assert simhash.fingerprint(text) == simhash.fingerprint((text or "").replace("\n", " "))


def _random_texts(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(vocab, k=rng.randint(20, 120))) for _ in range(n // 6)]
    out = []
    for _ in range(n):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        out.append(" ".join(words))
    return out + ["", None, "w1", "w1"]


@pytest.mark.parametrize(("dense", "block"), [(256, 4096), (1, 2)])
def test_links_have_the_components_of_all_close_pairs(spark, dense, block):
    rng = np.random.default_rng(dense)
    seeds = rng.integers(-(2**62), 2**62, 12)
    values = {int(s) for s in seeds}
    for s in seeds:
        for _ in range(12):
            v = int(s) % (1 << 64)
            for b in rng.choice(64, rng.integers(0, 6), replace=False):
                v ^= 1 << int(b)
            values.add(v - (1 << 64) if v >= 1 << 63 else v)
    values = sorted(values)
    found = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), dense, block)
    roots = {r["node"]: r["root"] for r in components(found, "a", "b").collect()}
    want = _brute_components([v % (1 << 64) for v in values])
    groups = lambda label: sorted(sorted(v for v, x in zip(values, label, strict=True) if x == k) for k in set(label))
    assert groups([roots.get(v, v) for v in values]) == groups(want)


@pytest.mark.parametrize("each", [1 << 20, 100])
def test_components_of_chains_and_stars(spark, monkeypatch, each):
    monkeypatch.setattr("vicinity.llm.components.LINKS_EACH", each)
    chain = [(i, i + 1) for i in range(500)]
    star = [(1000, 1000 + i) for i in range(1, 400)]
    rng = random.Random(1)
    edges = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in chain + star + [(5, 5), (2000, 2001), (2000, 2001)]]
    rng.shuffle(edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7), "a", "b").collect()}
    assert got == {i: 0 for i in range(1, 501)} | {1000 + i: 1000 for i in range(1, 400)} | {2001: 2000}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_forest_of_random_graphs():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n, m = int(rng.integers(2, 40)), int(rng.integers(0, 60))
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        label = list(range(n))
        for _ in range(n):
            for x, y in zip(a, b, strict=True):
                label[x] = label[y] = min(label[x], label[y])
        nodes, roots = forest(a.astype(np.int64), b.astype(np.int64))
        assert dict(zip(nodes.tolist(), roots.tolist(), strict=True)) == {i: r for i, r in enumerate(label) if r != i}


def _docs(spark):
    rows = [(i * 7 % 1009, t, "x", i) for i, t in enumerate(_random_texts(2, 240))]
    rows += [(None, "w1 w2 w3", "n", 0), (None, "w1 w2 w3", "n", 1), (3, rows[0][1], "again", 0), rows[5], (4, "z " * 90_000, "long", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, FP string, uid int")


def test_query_rows_match_brute_force(spark):
    docs = _docs(spark)
    rows = docs.collect()
    prints = [_brute_print(r["text"]) if len(r["text"] or "") < 9000 else simhash.fingerprint(r["text"]) % (1 << 64) for r in rows]
    comp = _brute_components(prints)
    least = {c: min((r["doc_id"] for r, k in zip(rows, comp, strict=True) if k == c and r["doc_id"] is not None), default=None) for c in set(comp)}
    want = sorted(((r["doc_id"], f"{p:016x}", least[c]) for r, p, c in zip(rows, prints, comp, strict=True)), key=str)
    got = simhash.near_duplicates(docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_one_row_of_each_group_stays_with_all_columns(spark):
    docs = _docs(spark)
    rows = docs.collect()
    comp = _brute_components([simhash.fingerprint(r["text"]) % (1 << 64) for r in rows])
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert len(got) == len(set(comp))
    for c in set(comp):
        members = [r for r, k in zip(rows, comp, strict=True) if k == c]
        least = min((r["doc_id"] for r in members if r["doc_id"] is not None), default=None)
        assert sum(r in got and r["doc_id"] == least for r in set(members)) >= 1
    assert simhash.drop_near_duplicates(docs.where(F.lit(False))).count() == 0 and simhash.near_duplicates(docs.where(F.lit(False))).count() == 0
