"""Whitened embeddings against numpy on the whole table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinity.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, component string, x int"


def _brute(rows, components=32):
    ids, x = [], []
    for i, v in rows:
        if v is not None and all(c is not None and np.isfinite(c) for c in v):
            ids.append(i)
            x.append([int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v])
    size = max(map(len, x))
    x = [v + [0] * (size - len(v)) for v in x]
    n, s = len(x), [sum(v[k] for v in x) for k in range(size)]
    deviation = [sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)) for v in x]
    c = np.array([[(n * a - b) / n for a, b in zip(v, s, strict=True)] for v in x])
    v = c.T @ c / n
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values)[:components]
    return ids, deviation, c, values[order], vectors[:, order], np.trace(v)


def _compare(got, rows, components=32):
    ids, deviation, c, values, vectors, trace = _brute(rows, components)
    kept = int((values > 1e-12 * trace).sum())
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["deviation"]), []).append(r)
    assert len(got) == len(ids) * len(values)
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["deviation"]) for r in got if r["component"] == 1) == sorted((i is None, i or 0, d) for i, d in zip(ids, deviation, strict=True))
    assert {r["n"] for r in got} == {len(ids)} and len({r["identity_error"] for r in got}) == 1
    if kept:
        assert got[0]["identity_error"] < 1e-9
    want = c @ vectors[:, :kept] / np.sqrt(values[:kept])
    for k in range(kept):
        mine = {(r["vec_id"], r["deviation"]): r for r in got if r["component"] == k + 1}
        a = np.array([mine[i, d]["whitened"] for i, d in zip(ids, deviation, strict=True)])
        assert min(np.abs(a - want[:, k]).max(), np.abs(a + want[:, k]).max()) < 1e-6
        assert {round(r["explained"] / (values[k] / trace), 9) for r in mine.values()} == {1.0}
    for r in got:
        if r["component"] > kept:
            assert r["whitened"] is None and r["explained"] == 0


def test_query_rows_match_numpy(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = queries.op13_embedding_whitening(spark, sf_dir)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    _compare(got.collect(), rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    scale = np.array([40, 20, 10, 5, 2.5, 0])
    rows = [(i, [float(c) for c in rng.normal(size=6) * scale]) for i in range(60)]
    rows += [(None, rows[3][1]), rows[4], (70, None), (71, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (72, [float("nan")] * 6), (73, [float("inf")] * 6), (74, [9.0]), (75, [])]
    docs = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(5)
    _compare(whitening.whiten(docs.drop("component")).collect(), rows)
    _compare(whitening.whiten(docs, components=3).collect(), rows, 3)


def test_pairs_in_several_aggregations_and_large_entries(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=5) * [3e7, 2e7, 1e7, 5e6, 1e6]]) for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    made = whitening.cells(table, "vec_id", "embedding")
    model = whitening.fit(made)
    whole = whitening.products(made, "x", model.centre)
    monkeypatch.setattr(whitening, "PAIRS", 4)
    assert np.allclose(whitening.products(made, "x", model.centre), whole, rtol=1e-12)
    ids, deviation, *_ = _brute(rows)
    assert {r["id"]: r["deviation"] for r in whitening.project(made, model).collect()} == {i: d if d < 2**63 else None for i, d in zip(ids, deviation, strict=True)}
    assert not all(d < 2**63 for d in deviation)


def test_nothing_to_whiten(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(empty).collect() == [] and whitening.whiten(empty.withColumn("vec_id", F.lit(1))).columns[0] == "vec_id"
    assert whitening.whiten(spark.createDataFrame([(1, None, "", 0), (2, [], "", 0)], SCHEMA)).collect() == []
    got = whitening.whiten(spark.createDataFrame([(1, [0.5, 2.0], "", 0)] * 3, SCHEMA)).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got] == [(1, 3, 0, None, 0.0, None), (2, 3, 0, None, 0.0, None)] * 3
    with pytest.raises(ValueError, match="rename"):
        whitening.whiten(spark.createDataFrame([(1, [0.5])], "n long, embedding array<float>"), key="n")
