"""The stages against brute force, on documents with gaps, repeats, long texts and foreign columns."""

import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from test_native import _brute_counts

import corpus_pipeline
from vicinity.llm import mixing, quality, rules
from vicinity.llm.tokens import Encoder, default_path


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, path = random.Random(11), tmp_path_factory.mktemp("pipeline")
    rows, labels = [], []
    for i in range(700):
        words = [f"w{rng.randint(0, 4000)}" for _ in range(rng.randint(55, 160))]
        kind = rng.random()
        bad = kind < 0.2
        text = " | ".join(words) if bad else " ".join(w + "###" for w in words) if (bad := kind < 0.3) else " ".join(words) + ".\n" + " ".join(sorted(words)) + "."
        if not bad and kind > 0.9 and rows:
            text = rows[rng.randrange(len(rows))][1]
        rows.append((i, text, "en", "hot" if i % 3 else f"s{i % 7}", len(text), "x", 1))
        if i % 5:
            labels.append((i, int(not bad), 0))
    rows += [(None, rows[3][1] + " more", None, None, None, None, None), (5, None, "en", "s1", 0, "y", 2), (6, "", "en", "s1", 0, "y", 2), rows[8], rows[8], (9001, " ".join(f"w{rng.randint(0, 999999)}" for _ in range(40_000)), "en", "hot", 9, "z", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, uid string, score int").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def _similar(texts):
    """Components of the texts with a five-word similarity of 0.8 or more, pair by pair."""
    sets = []
    for t in texts:
        words = (t or "").lower().split()
        sets.append({" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    comp = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if comp[i] != comp[j] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                comp = [comp[j] if c == comp[i] else c for c in comp]
    return comp


def _bag(rows):
    return Counter(tuple(r) for r in rows)


def test_each_stage_does_what_brute_force_does(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    only = corpus_pipeline._learned_from()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "quality_classifier", "near_duplicates", "source_mixing", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{name}")
        got = spark.read.parquet(f"{tmp_path}/{name}").collect()
        if name != names[-1]:
            assert out.columns == docs.columns
        if name == "quality_rules":
            learned = rules.fit(docs, labels, only=only)
            stats = {r["text"]: r["s"] for r in docs.select("text", rules.statistics("text").alias("s")).collect()}
            x = lambda r: np.array([[float(stats[r["text"]][f]) for f in rules.FEATURES]])
            want = [r for r in before if not _brute_counts(r["text"])[5] and not any(rules._covers(c, x(r))[0] for c in learned)]
            assert 400 < len(want) < len(before) - 100
        elif name == "quality_classifier":
            model = quality.fit(docs, labels, only=only)
            want = [r for r in before if model.score(quality.table([r["text"]]))[0] >= quality.THRESHOLD]
        elif name == "near_duplicates":
            comp = _similar([r["text"] for r in before])
            order = lambda k: (before[k]["doc_id"] is None, before[k]["doc_id"] or 0)
            want = [before[min((k for k in range(len(before)) if comp[k] == c), key=order)] for c in set(comp)]
            assert len(want) < len(before)
        elif name == "source_mixing":
            with duckdb.connect() as c:
                used = c.sql(mixing.mix_sql(table=f"'{tmp_path}/near_duplicates/*.parquet'")).fetchall()
            rows, want = {(r["doc_id"], r["source"]): r for r in before}, []
            assert len(rows) == len(before)
            want = [rows[u[0], u[1]] for u in used]
            assert len(want) > len(before)
        else:
            own = Encoder(default_path("word_bpe_49k.json"))
            ids = [(r["doc_id"], own.ids_bytes(r["text"]) + b"\x01\0\0\0") for r in before]
            assert Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in got) == Counter((d, at // 4, zlib.crc32(b[at : at + 16384])) for d, b in ids for at in range(0, len(b), 16384))
            break
        assert _bag(got) == _bag(want), name
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    ends = {}
    for r in sorted(got, key=lambda r: r["offset"]):
        assert ends.setdefault(r["sequence_id"], 0) == r["offset"]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 4096
    whole = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in whole) == Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in got)


def test_stages_of_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_registered_queries_run_on_the_smallest_tables(spark, sf_dir, monkeypatch):
    from oracle import compare

    import __spark_entry__ as entry

    monkeypatch.setenv("ORACLE_SF_DIR", sf_dir)
    sql = entry.oracle_sql()
    assert {"op6_url_filter", "op7_quality_rules", "op8_temperature_mixing", "mix_to_entropy"} <= set(sql)
    for name, f in entry.queries().items():
        if name.startswith("op") and name[2].isdigit() or name in ("pipeline", "mix_to_entropy"):
            if name in sql:
                compare(spark, sf_dir, f, sql[name])
            else:
                assert f(spark, sf_dir).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None
