"""The index of terms against one pattern a term."""

import random
import time

import pytest
from pyspark.sql import functions as F

from vicinity.config import AreaGroup, FilterConfig, Place
from vicinity.functions import terms, text
from vicinity.operators import evidence, routing

ODD = ["see", "seehof", "am see", "am seeufer", "hof", "Hofstraße", "hof 12", "12", "7b", "a", "", "  ", "-tor", "#alarm", "!!", "ä", "straße", "st. jürgen", "x-y", "x-ybel", "see-", "école", "münster", "münsterland"]
TEXTS = ["", " ", "am see", "am seeufer-weg", "der Seehof brennt", "hof-str 7b", "hofstr.-platz", "Hof 12a", "hof 12-er", "see-ufer und see-gras", "x-y-z", "vor-tor", "#alarm!!", "sankt st. jürgen", "12", "712", "münsterlander-allee", "écoles", "seehof-", "seehof-7", "Am Seehof-Kiez\nhof"]


def _texts(seed, n):
    rng = random.Random(seed)
    return TEXTS + ["".join(rng.choice([*ODD, " ", "-", ".", "q", "allee", "\n"]) for _ in range(rng.randint(1, 12))) for _ in range(n)]


@pytest.mark.parametrize(("place", "whole"), [(False, False), (True, False), (False, True)])
def test_found_terms_are_those_of_the_patterns(spark, place, whole):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(_texts(3, 300))], "i int, t string").select("i", text.normalize(F.col("t")).alias("t"))
    one = (lambda t: text.contains_term(F.col("t"), t)) if whole else (lambda t: text.mentions(F.col("t"), t, place))
    want = {r["i"]: [k for k in range(len(ODD)) if r[f"m{k}"]] for r in rows.select("i", *[one(t).alias(f"m{k}") for k, t in enumerate(ODD)]).collect()}
    got = {r["i"]: r["c"] for r in rows.select("i", terms.found_in(F.lit(None).cast("string"), F.col("t"), ODD, place, whole).alias("c")).collect()}
    assert got == {i: [2 * k for k in v] for i, v in want.items()}
    assert sum(map(len, want.values())) > 200


def test_parts_and_owners(spark):
    rows = spark.createDataFrame([("seehof am hof", "hof see", None), ("nichts", "am see", ""), (None, None, "x")], "a string, b string, c string")
    got = [tuple(r) for r in rows.select(terms.found_in(F.col("a"), F.col("b"), ["hof", "see", "seehof"]), terms.found_in(F.col("a"), F.col("b"), ["hof", "see", "seehof"], owners=[1, 0, 1]), terms.any_of(F.col("a"), F.col("b"), ["see"])).collect()]
    assert got == [([1, 2, 5], [2, 1], True), ([2], [2], True), ([], [], False)]
    assert rows.select(terms.any_of(F.col("a"), F.col("b"), [])).distinct().collect()[0][0] is False


def test_an_index_beyond_the_limit_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(terms, "MOST_BYTES", 1000)
    terms.shared(terms.TermIndex(["ort"]))
    with pytest.raises(ValueError, match="split"):
        terms.shared(terms.TermIndex([f"ort {i}" for i in range(100)]))


def test_time_does_not_grow_with_the_number_of_terms():
    rng = random.Random(1)
    texts = [" ".join(f"wort{rng.randint(0, 10**6)}" for _ in range(200)) + f" stelle{i} am hof" for i in range(300)]
    word = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    few, many = terms.TermIndex(["hof", *[word(9) for _ in range(9)]]), terms.TermIndex(["hof", *[word(9) for _ in range(9999)]])

    def took(index):
        best = 9.0
        for _ in range(3):
            began = time.process_time()
            assert all(0 in index.found(t) for t in texts)
            best = min(best, time.process_time() - began)
        return best

    assert took(many) < 3 * took(few) + 0.05


def test_ten_thousand_terms_in_a_plan(spark):
    many = [f"Ortsteil {i} Nord" for i in range(10_000)]
    config = FilterConfig(area=[AreaGroup(500.0 + k, many[k::4]) for k in range(4)], places=[Place(f"Platz {i}", 52.0, 13.0 + i / 1e5, [f"Markt {i}"]) for i in range(2000)], required=many, blocklist=[f"sperre {i}" for i in range(2000)], elsewhere=[f"Fernort {i}" for i in range(3000)])
    rows = spark.createDataFrame([(i, f"Feuer in Ortsteil {i * 7} Nord und Markt {i} bei Fernort {i}" + (" sperre 5" if i == 9 else "")) for i in range(60)], "i int, title string")
    up, rest = evidence.item_text(F.col("title"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    got = rows.select("i", "title", up.alias("up"), rest.alias("rest")).select("i", evidence.area_evidence(F.col("up"), F.col("rest"), config.area).alias("area"), evidence.place_evidence(F.col("up"), F.col("rest"), config.places, 52.0, 13.0).alias("places"), routing.keyword_pass(F.col("up"), F.col("rest"), config).alias("ok"), evidence.located_elsewhere(F.col("title"), F.lit(None).cast("string"), config).alias("away"))
    for r in got.collect():
        i = r["i"]
        assert [(e["label"], e["meters"], e["pos"]) for e in r["area"]] == [(f'"Ortsteil {i * 7} Nord" ({500 + i * 7 % 4}m)', 500.0 + i * 7 % 4, i * 7 % 4)]
        assert [(e["label"], e["pos"]) for e in r["places"]] == [(f"Platz {i}", 1000 + i)]
        assert r["ok"] == (i != 9) and r["away"] is None


def test_workers_get_batches_of_bounded_size(spark):
    for name in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"):
        spark.conf.unset(name)
    terms.found_in(F.lit("a"), F.lit("b"), ["a"])
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 512 and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 16 << 20
