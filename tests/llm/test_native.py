"""URL filters, quality rules and mixing: the operators without Python on executors."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from oracle import rows
from pyspark.sql import functions as F

from vicinity.llm import mixing, queries, rules, urlfilter


def _plan(df):
    return df._jdf.queryExecution().toString()


# -- URL filters -----------------------------------------------------------------------------------

URLS = [None, "", "nix", "://", "http://A.Example.ORG/es/x?y#z", "https://example.org/en/12", "http://notexample.org/en/1", "ftp://x.org", "http://x.com/fr/", "http://x.com/frz", "HTTP://X.COM/de/1", "http://a.net/?x=://b.org/", "http://münchen.com/ä/ß", "http://casino-bets.example.net/en/1", "http://garden-news.example.net/en/1", "http://h.org/" + "p" * 50_000, "http://x.net/a\nb", "http://😀.net/😀"]


def _brute(url, model):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in queries.URL_RULES:
        at, start = rule.split("/", 1)
        if (host == at or host.endswith("." + at)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    weights, bias = model
    z = bias + sum(int(weights[i]) for i in urlfilter.indexes(host, 0) + urlfilter.indexes(path, urlfilter._PATH))
    return host, path, best[1] if best else None, best[0] if best else ("block" if z > 0 else "allow")


def test_urls_are_judged_as_by_hand(spark):
    model = urlfilter.train(urlfilter.default_labelled())
    pages = spark.createDataFrame([(i, u, "h", "p", 0) for i, u in enumerate(URLS)], "page_id long, url string, host string, path string, rule int")
    got = urlfilter.judge(pages, queries.URL_RULES, model)
    assert {r["page_id"]: tuple(r)[1:] for r in got.collect()} == {i: _brute(u, model) for i, u in enumerate(URLS)}
    assert not re.search("Python|Arrow|Pandas|Exchange", _plan(got)) and urlfilter.judge(pages.where(F.lit(False)), queries.URL_RULES, model).count() == 0


def test_model_tells_unseen_hosts_apart():
    model = urlfilter.train(urlfilter.default_labelled())
    verdict = lambda host: _brute(f"https://{host}/en/77", model)[3]
    assert [verdict(h) for h in ("www.casino-lucky.example.net", "free-pills.example.net", "spam-bets.example.net", "adult-win.example.net")] == ["block"] * 4
    assert [verdict(h) for h in ("museum-garden.example.net", "www.history.example.net", "thertion.example.net", "m.thonthe.example.net", "ndeaning.example.net")] == ["allow"] * 5


def test_training_takes_tables_and_refuses_large_ones(spark, monkeypatch):
    table = spark.createDataFrame([("http://a.net/x", 0), ("http://b.net/y", 1), (None, 1), ("http://c.net", None)], "url string, label int")
    weights, bias = urlfilter.train(table)
    assert weights.shape == (urlfilter.WEIGHTS,) and isinstance(bias, int) and urlfilter.train([])[1] == 0
    monkeypatch.setattr(urlfilter, "MOST_LABELLED", 2)
    with pytest.raises(ValueError, match="at most"):
        urlfilter.train(table)


# -- quality rules ---------------------------------------------------------------------------------

TEXTS = [None, "", " \n\t", "one", "a b", "a b c", "a b c a b c", "x x x x x", "a b c d\na b c d\n\n \na b c d", "|#*$%&<> !! É UP", "w\x0bv\x0cu\rt\ns", "a b c x a b c y " * 30, "😀 😀 😀 😀\n😀", " a b", "lorem ipsum " * 20_000]


def _brute_counts(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    seen = Counter(windows)
    covered = {p + k for p, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_base_counts_are_those_of_their_definitions(spark):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice(["a ", "b ", "c ", "\n", "| ", "Ab "]) for _ in range(rng.randint(0, 90))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, 0, 0, 0) for i, t in enumerate(texts)], "doc_id long, text string, t int, w int, stats int")
    got = rules.judge(docs, [])
    assert {r["doc_id"]: tuple(r)[1:7] for r in got.collect()} == {i: _brute_counts(t) for i, t in enumerate(texts)}
    assert all(r["kept"] is (not r["base_failed"]) for r in got.collect())
    assert not re.search("Python|Arrow|Pandas|Exchange", _plan(got))


def _labelled(spark, n=900):
    rng = random.Random(8)
    out, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.25
        words = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(60, 200))]
        text = " ".join(w + "%%%" for w in words) if bad and i % 2 else " | ".join(words) if bad else " ".join(words) + "."
        out.append((i, text))
        labels.append((i, 0 if bad else 1, 0))
    return spark.createDataFrame(out + [(None, "x"), (5, out[5][1])], "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1, 0), (99_999, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


def test_learned_list_rejects_bad_texts_it_has_not_seen(spark):
    docs, labels = _labelled(spark)
    held = F.col("doc_id") % 4 == 2
    learned = rules.fit(docs, labels, only=~held)
    assert learned and all(len(r) <= rules.MAX_CONDITIONS for r in learned)
    rows_ = rules.judge(docs, learned).join(labels, "doc_id").where(held).collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in rows_) >= 0.98 * len(rows_)
    kept = rules.keep(docs.withColumn("body", F.lit(1)).withColumn("stats", F.lit(2)), learned)
    assert kept.columns == ["doc_id", "text", "body", "stats"]
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in rules.judge(docs, learned).collect() if r["kept"])
    assert rules.fit(docs, labels.where("quality = 1")) == [] and rules.fit(docs.where("false"), labels) == []


def test_list_is_applied_in_order_as_by_hand(spark):
    learned = [[("symbol_ratio", ">=", 0.5), ("n_words", "<", 100.0)], [("pipe_ratio", ">=", 0.25)]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a% " * 60, "a%% " * 120, "a | b " * 60, "plain w " * 30])], "doc_id long, text string")
    stats = docs.select("doc_id", rules.statistics("text").alias("s")).select("doc_id", "s.*").collect()
    x = np.array([[float(r[f]) for f in rules.FEATURES] for r in stats])
    want = np.any([rules._covers(r, x) for r in learned], axis=0)
    got = docs.select("doc_id", rules.statistics("text").alias("s")).select("doc_id", rules.rejects(learned, "s").alias("r")).collect()
    assert [r["r"] for r in got] == want.tolist()


# -- mixing ----------------------------------------------------------------------------------------


def _sources(spark):
    rng = random.Random(6)
    docs = []
    for s, n in (("big", 400), ("mid", 90), ("small", 30), (None, 12), ("one", 1)):
        docs += [(s, " ".join(["w"] * rng.randint(0, 60))) for _ in range(n)]
    table = [(i, t, s, i, 0) for i, (s, t) in enumerate(docs)] + [(None, "null key", "mid", 0, 0), (3, "again", "big", 0, 0), (7, None, "small", 0, 0)]
    return spark.createDataFrame(table, "doc_id long, text string, source string, mix_tokens int, uses int")


def _use(df):
    return Counter((r["doc_id"], r["source"], r["text"]) for r in df.collect())


def test_every_row_is_used_and_none_beyond_the_limit(spark):
    docs = _sources(spark)
    mixed = mixing.mix(docs, repetition=3.0, block_tokens=200)
    assert mixed.columns == [*docs.columns, "_mix_tokens", "mix_epoch", "mix_block", "mix_rank"]
    used, have = _use(mixed), _use(docs)
    assert set(used) == set(have)
    tokens = lambda t: len((t or "").split()) + 1
    total, got = defaultdict(int), defaultdict(int)
    for (_, s, t), n in have.items():
        total[s] += n * tokens(t)
    for (d, s, t), n in used.items():
        got[s] += n * tokens(t)
        assert n <= 4 * have[d, s, t]
    least, most = min(total.values()), max(total.values())
    exponent = mixing.repetition_exponent(least, most, 3.0)
    for s in total:  # the budget, but for the document that no longer fits
        budget = total[s] ** exponent * most ** (1 - exponent)
        assert got[s] <= budget + 1 and got[s] >= budget - 62
    assert not re.search("Python|Pandas|Arrow", _plan(mixed))


def test_each_pass_is_a_permutation_of_blocks(spark):
    mixed = mixing.mix(_sources(spark), repetition=2.0, block_tokens=100).where("source = 'mid'")
    ranks = defaultdict(set)
    for r in mixed.collect():
        ranks[r["mix_epoch"]].add((r["mix_block"], r["mix_rank"]))
    first = ranks[0]
    assert sorted(k for _, k in first) == list(range(len(first))) and len({b for b, _ in first}) == len(first)
    assert [b for b, _ in sorted(first, key=lambda x: x[1])] != sorted(b for b, _ in first)


def test_budget_entropy_and_edges(spark):
    docs = _sources(spark)
    sizes = docs.groupBy("source").agg(F.sum(mixing.token_count("text")).alias("total"))
    totals = np.array([float(r["total"]) for r in sizes.collect()])
    p = totals**0.4 / (totals**0.4).sum()
    assert abs(mixing.entropy_exponent(sizes, "total", float(-(p * np.log(p)).sum())) - 0.4) < 1e-4
    assert mixing.entropy_exponent(sizes, "total", 99.0) == 0.0 and mixing.entropy_exponent(sizes, "total", 0.0) == 1.0
    half = mixing.mix(docs, repetition=1.0, budget=int(totals.sum() / 2), block_tokens=50)
    assert 0.4 * totals.sum() < half.agg(F.sum("_mix_tokens")).first()[0] <= totals.sum() / 2 + 1
    assert mixing.mix(docs.where("false")).count() == 0 and mixing.mix(docs.where("source = 'one'")).count() == 1
    assert mixing.repetition_exponent(10, 10, 1.0) == 0.0 and float(Fraction(1)) == mixing.repetition_exponent(1, 100, 1.0)
    with pytest.raises(ValueError):
        mixing.repetition_exponent(1, 2, 0.5)


def test_a_source_without_keys_is_dealt_over_blocks(spark):
    docs = spark.createDataFrame([(None, f"text number {i}", "one", 0) for i in range(300)] + [(5, "same", "one", 0)] * 40, "doc_id long, text string, source string, uses int")
    mixed = mixing.mix(docs, block_tokens=60).collect()
    sizes = Counter(r["mix_block"] for r in mixed if r["doc_id"] is None)
    assert len(mixed) == 340 and len(sizes) > 15 and max(sizes.values()) < 60
    assert sorted({r["mix_rank"] for r in mixed}) == list(range(len({r["mix_block"] for r in mixed})))


def test_windows_are_compared_word_by_word(spark):
    text = "a b c " * 3 + "ab c d a bc d " + "x y z w " * 2
    got = spark.createDataFrame([(text,)], "text string").select(rules.statistics("text").alias("s")).first()["s"]
    assert got["n_repeat_words"] == _brute_counts(text)[4]


def test_mix_is_the_same_each_time(spark):
    docs = _sources(spark)
    a, b = (mixing.mix(d, repetition=2.5, block_tokens=150) for d in (docs, docs.repartition(7)))
    assert rows(a.columns, [tuple(r) for r in a.collect()]) == rows(b.columns, [tuple(r) for r in b.collect()])
