import pytest
from pyspark.sql import functions as F

from vicinity.functions import text


@pytest.mark.parametrize(
    ("body", "term", "found"),
    [
        ("Amt Lindenau-Ostend", "Lindenau", False), ("Fest in Neu-Lindenau", "Lindenau", True), ("Lindenaus Rathaus", "Lindenau", True), ("im Lindenauer Hof", "Lindenau", True),
        ("Laden in der Anna-Mai-Straße", "Anna-Mai", True), ("Obergärtnerstraße 3", "Gärtnerstr", False), ("Ruf 040 304471", "30447", False), ("30447 Stadt", "30447", True), ("rawlings", "RAW", False),
    ],
)
def test_place_terms(value, body, term, found):
    assert value(text.mentions(text.normalize(F.lit(body)), term, place=True)) is found


def test_keywords_take_hyphens_but_not_word_ends(value):
    n = lambda s: text.normalize(F.lit(s))
    assert value(text.mentions(n("Wahl in Jena-West"), "Jena")) is True
    assert value(text.mentions(n("Neujena"), "Jena")) is False
    assert value(text.mentions(n("egal"), "")) is False


def test_mention_tells_prominent_from_rest(value):
    m = lambda a, b: value(text.mention(F.lit(a), F.lit(b), "hafen"))
    assert m("am hafen", "") is True
    assert m("", "am hafen") is False
    assert m("berg", "tal") is None


def test_whole_terms(value):
    assert value(text.contains_term(F.lit("das raw-gelände"), "RAW")) is True
    assert value(text.contains_term(F.lit("rawgelände"), "RAW")) is False


def test_split_lead_counts_bytes_and_keeps_words(value):
    body = "wört " * 400
    lead, rest = value(*text.split_lead(F.lit(body)))
    assert len(lead.encode()) >= text.LEAD_BYTES and rest.startswith(" ") and lead + rest == body
    assert value(*text.split_lead(F.lit("kurz"))) == ("kurz", "")
    assert value(*text.split_lead(F.lit("x" * 1300))) == ("x" * 1300, "")
    edge = "é" * 599 + "y" + "é" * 10  # byte 1200 is amid a letter
    assert value(*text.split_lead(F.lit(edge + " z"))) == (edge, " z")


def test_strip_tags_swallows_what_is_open(value):
    assert value(text.strip_tags(F.lit("a<p>b</p>c > d <i"))) == "abc  d "


def test_links_compare_without_noise(value):
    c = lambda s: value(text.canonical_link(F.lit(s)))
    assert c(" https://www.Site.org/News/a?utm_source=x&at_y=1#top ") == c("http://site.org/news/a/")
    assert c("https://s.org/a?id=1&REF=2&B=c") == "s.org/a?id=1&B=c"
    assert c("https://s.org/a?id=1") != c("https://s.org/a?id=2")


def test_streets_match_across_spellings(value):
    m = lambda a, b: value(text.street_matches(F.lit(a), F.lit(b)))
    assert m("Erlenauer Str", "Erlenauer Straße") and m("Max Meier Allee", "Max-Meier-Allee") and m("Tulpenstrasse", "Tulpenstraße")
    assert not m("Parkplatz", "Grüne Straße") and not m("Große Neue Allee", "Allee")
    assert value(text.street_without_number(F.lit("Am Tor 9a"))) == "Am Tor"


def test_sentences(value):
    s = lambda x, n=2: value(text.concise_sentences(F.lit(x), n))
    assert s("Eins. Eins. Zwei! Drei?") == "Eins. Zwei!"
    assert s('Er rief "Halt!" laut. Und') == 'Er rief "Halt!" laut.'
    assert s("ohne   Ende") == "ohne Ende" and s("  ") is None
    assert s("Ganz. Rest ohne Punkt", 5) == "Ganz."


def test_article_ends_at_a_closing_marker_as_words(value):
    cut = lambda x: value(text.relevant_article_text(F.lit(x)))
    assert cut("Feuer im Haus. Der Impressumsleser kam. Rückfragen an: Amt") == "Feuer im Haus. Der Impressumsleser kam. "
    assert cut("Newsletter bestellen") == "" and value(text.relevant_article_text(F.lit(None).cast("string"))) == ""


def test_labels(value):
    assert value(text.short_location(F.lit(" A , , B,C , D"))) == "A, B, C"
    assert value(text.short_location(F.lit(" , "))) is None
    assert value(text.format_distance(F.lit(949.6))) == "~950m" and value(text.format_distance(F.lit(1250.0))) == "~1.2km"
    assert [value(text.score_color(F.lit(i))) for i in range(7)] == ["⚪", "🔵", "🟢", "🟡", "🟠", "🔴", "🔴"]
    assert value(text.unique_names(F.array(*map(F.lit, ["Ab", "aB", "C", "ab"])))) == ["Ab", "C"]


def test_title_matches(value):
    m = lambda a, b: value(text.text_matches_title(F.lit(a), F.lit(b)))
    assert m("egal", "kurz") and m("hier brennt die Scheune am Hafen", "Scheune brennt im Norden")
    assert not m("Regen am Montag", "Scheune brennt lichterloh")


def test_missing_message_phrases(value):
    assert value(text.is_missing_message(F.lit("M_NOT_FOUND: gone"))) and not value(text.is_missing_message(F.lit("timeout")))


def test_fnv_matches_its_definition(value):
    for s in ("", "a", "schlüssel|!raum", "x" * 300):
        h = 0xCBF29CE484222325
        for b in s.encode():
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        assert value(text.fnv1a_64(F.lit(s))) == f"{h:016x}"


def test_event_words_and_dates(value):
    assert value(text.title_event_class(F.lit("Große Kundgebung, Konzert"))) == "protest"
    assert value(text.title_event_class(F.lit("Konzertabend"))) is None
    assert value(text.title_dates(F.lit("Am 6.7.2026 und 06.07.2026 oder 1.13.2026"))) == ["01.13.2026", "06.07.2026"]


def test_sentences_of_texts_of_all_kinds(spark):
    """As all sentences of the squeezed text, cut to the first distinct ones."""
    import random
    import re

    rng = random.Random(4)
    texts = ["".join(rng.choice(["A", "b", " ", "\n", "\u00a0", ". ", "!", '."', "?)", "A.", "A. "]) for _ in range(rng.randint(0, 14))) for _ in range(400)] + ["", " ", "no end", "A. A. A. B. tail", None]

    def want(t):
        t = re.sub(r"\s+", " ", t or "").strip()
        found = list(dict.fromkeys(s.strip() for s in re.findall("[^.!?]*[.!?][)\\]}\"'”“’‘]*", t)))
        return None if not t else " ".join(found[:2]) if found else t

    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.concise_sentences(F.col("t"), 2).alias("s")).collect()
    assert {r["i"]: r["s"] for r in got} == {i: want(t) for i, t in enumerate(texts)}


def test_a_long_text_without_a_sentence_end_takes_no_time(spark):
    import time

    rows = spark.range(1).select(F.concat(F.lit("A. A. "), F.repeat(F.lit("word "), 200_000)).alias("t"))
    start = time.time()
    assert rows.select(text.concise_sentences(F.col("t"), 2)).first()[0] == "A." and time.time() - start < 20
