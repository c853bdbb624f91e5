"""Feeds that are not well-formed, read entry by entry."""

from pyspark.sql import functions as F

from vicinity.functions import markup
from vicinity.plans import more
from vicinity.sources import feeds

BROKEN = """<?xml version="1.0"?><rss><channel><title>Stadt & Land</title>
<item><guid isPermaLink="false">a</guid><title>Müller & Söhne &ndash; 3 < 4</title><link>https://x.test/?a=1&b=2</link><x:point>1.5 2.5</x:point></item>
<!-- <item><title>auskommentiert</title></item> -->
<item><guid>b</guid><title>kaputt <b></title></item>
<item/>
<item><guid>c</guid><title><![CDATA[<item>kein Anfang</item> & ein &amp;]]></title><description>ein <i>schönes</i> Wort</description></item>
<item rdf:about="u"><guid>d</guid><title>ohne Ende</title>
<entry><id>e</id><title/><title>zweiter</title><link rel="self" href="s"/><link href="https://x.test/e"/><updated>2031-02-03T04:05:06Z</updated><geo:Point><geo:lat>3</geo:lat><geo:long>4</geo:long></geo:Point></entry>"""


def _rows(spark, *bodies):
    return spark.createDataFrame([(f"s{i}", b) for i, b in enumerate(bodies)], "source_name string, xml string")


def test_a_broken_entry_costs_no_other(spark):
    got = {r["guid"]: r for r in feeds.parse(_rows(spark, BROKEN, None, "", "  ")).collect()}
    assert set(got) == {"a", "c", "e"}
    assert (got["a"]["title"], got["a"]["link"], got["a"]["lat"], got["a"]["lon"]) == ("Müller & Söhne – 3", "https://x.test/?a=1&b=2", 1.5, 2.5)  # an open tag takes the rest
    assert (got["c"]["title"], got["c"]["description"]) == ("kein Anfang & ein &", "ein schönes Wort")
    assert (got["e"]["title"], got["e"]["link"], got["e"]["lat"], got["e"]["lon"], got["e"]["published_at"]) == ("zweiter", "https://x.test/e", 3.0, 4.0, 1927857906)


def test_what_cannot_be_read_is_listed(spark):
    rows = feeds.broken_entries(_rows(spark, BROKEN, "kein Feed", None, "", '{"items": [1, {"id": "j", "title": "J"}]}')).collect()
    got = sorted((r["source_name"], "kaputt" in r["broken"], "ohne Ende" in r["broken"]) for r in rows)
    assert got == [("s0", False, True), ("s0", True, False), ("s1", False, False), ("s4", False, False)]


def test_python_reads_the_same_entries(spark):
    both = [BROKEN, '<rss><channel><item><guid>x</guid><title>T</title><link>l</link></item></channel></rss>', '{"items": [{"id": 4, "url": "u", "content_text": "c"}]}', "<rss></rss>", "nichts"]
    for body in both:
        rows = feeds.read_entries(feeds.raw_entries(_rows(spark, body))).where("broken is null").select("e.*").collect()
        want = feeds.entries(body)
        assert [(r["id"], r["lat"], [x["href"] for x in r["links"]], r["published"], r["updated"]) for r in rows] == [(e["id"], e["lat"], [x["href"] for x in e["links"]], e["published"], e["updated"]) for e in want]


def test_entities_are_decoded_in_the_jvm_as_in_python(spark):
    said = ["&amp;lt; &#228;&#xE4;&#X41; &nix; &auml &shy;&euro;", "&#0; &#1114112; &#xD800; &#xDFFF;&#x10FFFF;&#00065;&#x000041;", "&", "&&amp;&", "", "a;b&;c", "&#99999999999999999999; &#xFFFFFFFFFFFFFFFFFFFF;", "&#; &#x; &#xg; &AMP;", None]
    said += [f"x&{name};y" for name in markup.ENTITIES]
    rows = spark.createDataFrame([(s,) for s in said], "s string").select("s", markup.decode_entities(F.col("s")).alias("d")).collect()
    assert [r["d"] for r in rows] == [None if r["s"] is None else markup.decode(r["s"]) for r in rows]


def test_feeds_need_no_python_workers(spark, sf_dir):
    plan = more.feed_documents(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
