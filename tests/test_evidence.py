from pyspark.sql import functions as F

from vicinity.config import AreaGroup, Config, FilterConfig, Place, load, region_keywords
from vicinity.operators import evidence, routing




def _entry(meters, kind, up, pos, penalty=0):
    return evidence.evidence(F.lit(meters), F.lit(""), kind, F.lit(up), F.lit(penalty), pos)


def test_best_by_score_then_kind_then_nearness(value):
    best = lambda *e: value(evidence.best(F.array(*e)))["evidence"]
    assert best(_entry(9000.0, evidence.SOURCE_DEFAULT, True, 0), _entry(1400.0, evidence.GEOCODED, False, 1), _entry(1500.0, evidence.KEYWORD, True, 2))["kind"] == evidence.KEYWORD
    assert best(_entry(1500.0, evidence.KEYWORD, True, 0), _entry(1900.0, evidence.PLACE, True, 1))["kind"] == evidence.PLACE
    assert best(_entry(700.0, evidence.PLACE, True, 0), _entry(600.0, evidence.PLACE, True, 1))["meters"] == 600.0
    assert value(evidence.best(F.array().cast(f"array<{evidence.EVIDENCE}>"))) is None


def test_rows_and_arrays_agree(spark):
    rows = spark.createDataFrame([(i % 7, float(i * 131 % 4000), "x", i % 5, i % 2 == 0, i % 2, i) for i in range(200)], "item int, meters double, label string, kind int, prominent boolean, penalty int, pos int")
    by_rows = {r["item"]: r["top"]["evidence"] for r in evidence.best_of_rows(rows, "item").collect()}
    arrays = rows.groupBy("item").agg(F.collect_list(F.struct("meters", "label", "kind", "prominent", "penalty", "pos")).alias("e")).select("item", evidence.best(F.col("e")).alias("top"))
    assert by_rows == {r["item"]: r["top"]["evidence"] for r in arrays.collect()}


def test_lead_and_body_mentions(value):
    area = [AreaGroup(1500.0, ["Hafentor"])]
    long = "Der Rat berät über den Haushalt. " * 60 + "Die Bahn soll zum Hafentor fahren."
    for body, up, score in ((long, False, 1), ("Am Hafentor wurde gebaut.", True, 2)):
        found = value(evidence.area_evidence(*evidence.item_text(F.lit("Haushalt"), F.lit(""), F.lit(body)), area))
        assert [(e["prominent"], e["label"]) for e in found] == [(up, '"Hafentor" (1500m)' if up else '"Hafentor" (1500m, body only)')]
        assert value(evidence.score(evidence.area_evidence(*evidence.item_text(F.lit("Haushalt"), F.lit(""), F.lit(body)), area)[0])) == score


def test_contact_block_is_no_evidence(value):
    area = [AreaGroup(800.0, ["30447"]), AreaGroup(1500.0, ["Lindenau", "Tulpenstr"])]
    body = "Lindenau-Ostend Nr. 12 In der Nacht geschah es im Süden. Hinweise nimmt das Amt in der Tulpenstraße 10, 30447 Stadt entgegen."
    assert value(evidence.area_evidence(*evidence.item_text(F.lit("Raub"), F.lit(""), F.lit(body)), area)) == []


def test_places_and_penalty(value):
    places = [Place("Alter Turm", 52.51, 13.45, ["Turmhof"])]
    found = evidence.place_evidence(F.lit("fest im turmhof"), F.lit(""), places, 52.51, 13.45)
    assert value(found)[0]["prominent"] and value(found)[0]["meters"] < 1
    down = evidence.penalise(found, F.lit(True))
    assert value(down)[0]["penalty"] == 1 and value(evidence.score(down[0])) == 4
    assert value(evidence.penalise(F.array(_entry(1.0, evidence.COORDINATES, True, 0)), F.lit(True)))[0]["penalty"] == 0


def test_elsewhere(value):
    config = FilterConfig(home_borough="Nordbezirk", elsewhere=["Südstadt"], area=[AreaGroup(500.0, ["Hafentor"])])
    why = lambda title, d=None: value(evidence.located_elsewhere(F.lit(title), F.lit(d).cast("string"), config))
    assert why("Feuer", "Westbezirk") == "filed under Westbezirk, not Nordbezirk"
    assert why("Feuer", "Nordbezirk ") is None and why("Feuer", "berlinweit") is None
    assert why("Feuer in Südstadt") == "title names Südstadt" and why("Von Südstadt zum Hafentor") is None


def test_routing_table(spark):
    cases = [  # published hours ago, filter, keywords, fetch failed, geo failed, geocoded, final, score -> outcome
        ((100, True, True, False, False, False, False, 5), "dropped"), ((None, True, False, True, False, False, False, 0), "retry"), ((1, True, False, True, False, False, True, 0), "dropped"),
        ((1, True, True, False, True, False, False, 5), "retry"), ((1, True, True, False, True, True, False, 5), "queued"), ((1, True, True, True, False, False, False, 1), "retry"),
        ((1, True, True, False, False, False, False, 2), "candidate"), ((1, True, True, False, False, False, False, 1), "dropped"), ((1, False, False, True, False, False, False, 0), "queued"), ((72, True, True, False, False, False, False, 3), "queued"),
    ]
    now = 1_000_000
    rows = [(i, None if c[0] is None else now - c[0] * 3600 - (0 if c[0] != 72 else 3540), 72, *c[1:]) for i, (c, _) in enumerate(cases)]
    items = spark.createDataFrame(rows, "id int, published_at bigint, max_age_hours bigint, filter boolean, keyword_ok boolean, fetch_failed boolean, geo_failed boolean, geocoded boolean, final boolean, score int")
    got = {r["id"]: r for r in routing.outcome(items, FilterConfig(digest_threshold=3, candidate_min_score=2), F.lit(now)).collect()}
    assert [got[i]["outcome"] for i in range(len(cases))] == [o for _, o in cases]
    assert got[0]["reason"] == "published 100h ago, older than 72h"


def test_small_rules(value):
    assert value(routing.within_age(F.lit(None).cast("bigint"), F.lit(100), 1)) and not value(routing.within_age(F.lit(0), F.lit(3601), 1)) and value(routing.within_age(F.lit(0), F.lit(3600), 1))
    assert value(routing.merged_published(F.lit(5), F.lit(None).cast("int"))) == 5 and value(routing.final_attempt(F.lit(6))) and not value(routing.final_attempt(F.lit(None).cast("int")))
    assert [value(routing.poll_health(*map(F.lit, c))) for c in ((1, 1, 1, 1), (0, 2, 0, 0), (0, 2, 5, 1), (0, 2, 5, 0))] == ["failed", "failed", "ok", "idle"]
    assert value(routing.keyword_pass(F.lit("a"), F.lit(""), FilterConfig(required=["zzzzz"]), [])) is True


def test_config(tmp_path):
    (tmp_path / "c.toml").write_text('[filter]\ndigest_threshold = 2\naddress = "Weg 1, 30447 Stadtfeld"\n[[filter.area]]\nimplied_meters = 5\nterms = ["a"]\n[[sources]]\nname = "s"\nextra = 1\n')
    c = load(tmp_path / "c.toml")
    assert c.filter.digest_threshold == 2 and c.filter.area[0].terms == ["a"] and c.sources[0].limit == 25 and c.schedule.digest_times == ["08:00"]
    assert region_keywords(c) == ["Stadtfeld"] and region_keywords(Config(filter=FilterConfig(geocode_city="Jena, DE"))) == ["Jena"] and region_keywords(Config()) == []
