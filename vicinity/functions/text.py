"""Text functions as column expressions: normalised words, terms, streets, links, sentences.

A letter or digit is Unicode alphabetic or numeric throughout; white space is Unicode's.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ALNUM = r"[\p{IsAlphabetic}\p{N}]"
NOT_ALNUM = r"[^\p{IsAlphabetic}\p{N}]"
LEAD_BYTES = 1200

# Word lists and limits that results depend on.
SAME_PLACE_SUFFIXES = ["str", "allee", "platz", "weg", "ufer", "damm", "ring", "gasse", "chaussee", "brücke", "brucke", "kiez", "tor", "park", "bahnhof"]
STREET_SUFFIXES = ["straße", "strasse", "str.", "str", "allee", "weg", "platz", "ring", "damm", "gasse", "chaussee", "ufer", "brücke", "brucke", "steg"]
SIGNIFICANT_STOP_WORDS = ["berlin", "polizei", "meldung", "update", "heute", "werden", "wurde", "wurden", "worden", "einem", "einer", "eines", "diese", "dieser", "nicht", "gegen", "unter", "sollen", "haben", "zwischen", "liveticker"]
ANNOUNCEMENT_WORDS = ["ankündigung", "ankuendigung", "announcement", "announce", "announcing"]
PROTEST_WORDS = ["demo", "demonstration", "kundgebung", "protest", "rally"]
EVENT_WORDS = ["veranstaltung", "event", "termin", "date", "konzert", "concert"]
ARTICLE_END_MARKERS = ["impressum", "datenschutz", "newsletter", "pressekontakt", "rückfragen bitte an", "rückfragen an", "hinweise nimmt", "hinweise nehmen", "hinweise bitte an", "original-content von", "mehr zum thema", "das könnte sie auch interessieren", "weitere artikel", "weitere meldungen", "auch interessant", "meistgelesen"]
ROLLING_URL_PARTS = ["ticker", "liveticker", "liveblog", "newsblog", "live-blog", "live-ticker"]
TRACKING_PREFIXES = ["utm_", "at_"]
TRACKING_PARAMETERS = ["fbclid", "gclid", "ref", "source", "wt_mc"]
MISSING_MESSAGE_PHRASES = ["not found", "unknown event", "event not found", "m_not_found", "redacted", "deleted", "cannot replace"]


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def squeeze(c: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")


def normalize(c: Column) -> Column:
    """Lower case with the spellings of *street* and sharp s made alike."""
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), [("ß", "ss"), ("strasse", "str"), ("str.", "str")], F.lower(c))


def normalize_text(value: str) -> str:
    """:func:`normalize` of a literal."""
    return value.lower().replace("ß", "ss").replace("strasse", "str").replace("str.", "str")


def null_if_blank(c: Column) -> Column:
    """Trimmed, and null if nothing is left."""
    return F.nullif(squeeze_ends(c), F.lit(""))


def squeeze_ends(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalized_key(c: Column) -> Column:
    """The key that makes labels and source names alike; blank is null."""
    return null_if_blank(normalize(c))


# As split_lead, in steps that may be evaluated once a row each; letters in which a lead's end is sought first.
NEAR = 256


def lead_front(c: Column, limit: int = LEAD_BYTES) -> Column:
    """Letters in the first ``limit`` bytes; null if the text has no more."""
    front = F.length(F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(c, "utf-8"), 1, limit).cast("string")), "�+$", ""))
    return F.when(F.octet_length(c) > limit, front)


def lead_end(c: Column, front: Column) -> Column:
    """Letters up to the next white space behind the first ``front``; null if that is."""
    space = lambda tail: F.nullif(F.regexp_instr(tail, F.lit(r"(?U)\s")), F.lit(0))
    near, tail = F.substr(c, front + 1, F.lit(NEAR)), F.substr(c, front + 1)
    return F.when(front.isNotNull(), front + F.coalesce(space(near) - 1, space(tail) - 1, F.length(tail)))


def split_at(c: Column, end: Column) -> tuple[Column, Column]:
    """(lead, rest) of a text whose lead has ``end`` letters; all of it is lead if that is null."""
    return F.when(end.isNull(), c).otherwise(F.substr(c, F.lit(1), end)), F.when(end.isNull(), F.lit("")).otherwise(F.substr(c, end + 1))


def split_lead(c: Column, limit: int = LEAD_BYTES) -> tuple[Column, Column]:
    """(lead, rest): the lead goes on from ``limit`` bytes to the next white space."""
    whole = F.octet_length(c) <= limit
    front = F.length(F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(c, "utf-8"), 1, limit).cast("string")), "�+$", ""))
    tail = F.substr(c, front + 1)
    at = F.regexp_instr(tail, F.lit(r"(?U)\s"))
    end = front + F.when(at > 0, at - 1).otherwise(F.length(tail))
    return F.when(whole, c).otherwise(F.substr(c, F.lit(1), end)), F.when(whole, F.lit("")).otherwise(F.substr(c, end + 1))


def term_pattern(term: str, place: bool = False) -> str:
    """A pattern for mentions of a term in normalised text.

    A mention starts at a word's start.  Terms of under five letters, or that end in a digit, also
    end at a word's end; longer ones may be inflected.  As a place, a term followed by a hyphen and
    a letter counts only before the second half of a name that still means the place.
    """
    t = normalize_text(term)
    pattern = rf"\Q{t}\E(?<!{ALNUM}\Q{t}\E)"  # the literal comes first: it is searched for as such
    if len(t) < 5 or t[-1:] in "0123456789":
        pattern += rf"(?!{ALNUM})"
    if place:
        pattern += rf"(?:(?!-\p{{IsAlphabetic}})|(?=-(?:{'|'.join(SAME_PLACE_SUFFIXES)})))"
    return pattern


def mentions(text: Column, term: str, place: bool = False) -> Column:
    """Whether normalised text mentions the term; an empty term is never mentioned."""
    return F.lit(False) if not normalize_text(term) else text.rlike(term_pattern(term, place))


def mention(prominent: Column, rest: Column, term: str, place: bool = False) -> Column:
    """True in the prominent part, false only in the rest, null in neither."""
    return F.when(mentions(prominent, term, place), F.lit(True)).when(mentions(rest, term, place), F.lit(False))


def mentions_any(prominent: Column, rest: Column, terms: list[str], place: bool = False) -> Column:
    return reduce(lambda a, t: a | mentions(prominent, t, place) | mentions(rest, t, place), terms, F.lit(False))


def contains_term(text: Column, term: str) -> Column:
    """Whether the normalised text has the term with a word's boundary on both sides."""
    t = normalize_text(term)
    return text.rlike(rf"\Q{t}\E(?<!{ALNUM}\Q{t}\E)(?!{ALNUM})") if t else F.lit(False)


def contains_any(text: Column, terms: list[str]) -> Column:
    """Whether any term is a part of the text as it is."""
    return reduce(lambda a, t: a | text.contains(t), terms, F.lit(False))


def contains_any_normalized(text: Column, terms: list[str]) -> Column:
    return contains_any(normalize(text), [normalize_text(t) for t in terms])


def contains_any_word(words: Column, needles: list[str]) -> Column:
    """Whether any of the needles is one of the words."""
    return F.arrays_overlap(words, _strings(needles))


def html_escape(c: Column) -> Column:
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")], c)


def strip_tags(c: Column) -> Column:
    """Text without tags: nothing takes their place, an open tag swallows the rest."""
    return F.replace(F.regexp_replace(c, r"(?s)<[^>]*(?:>|\z)", ""), F.lit(">"), F.lit(""))


def url_encode(c: Column) -> Column:
    """Query encoding: unreserved characters stay, a space becomes ``+``."""
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _words(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(normalize(c), r"(?U)\s+", " "), " "), lambda w: w != "")


def significant_words(c: Column, limit: int = 8) -> Column:
    """The first words of five letters or more that are no stop words, edges trimmed."""
    trimmed = F.transform(_words(c), lambda w: F.regexp_replace(w, f"^{NOT_ALNUM}+|{NOT_ALNUM}+$", ""))
    return F.slice(F.filter(trimmed, lambda w: (F.length(w) >= 5) & ~F.array_contains(_strings(SIGNIFICANT_STOP_WORDS), w)), 1, limit)


def title_terms(c: Column) -> Column:
    return F.regexp_extract_all(normalize(c), F.lit(f"({ALNUM}+)"), 1)


def title_dates(c: Column) -> Column:
    """Days named as three neighbouring numbers, as ``dd.mm.yyyy``, sorted and distinct."""
    return _dates(title_terms(c))


def _dates(terms: Column) -> Column:
    def windows(t: Column) -> Column:
        return F.when(F.size(t) < 3, F.array().cast("array<string>")).otherwise(
            F.filter(
                F.transform(
                    F.sequence(F.lit(0), F.size(t) - 3),
                    lambda i: F.when(F.get(t, i).rlike("^[0-9]{1,2}$") & F.get(t, i + 1).rlike("^[0-9]{1,2}$") & F.get(t, i + 2).rlike("^[0-9]{4}$"), F.concat_ws(".", F.lpad(F.get(t, i), 2, "0"), F.lpad(F.get(t, i + 1), 2, "0"), F.get(t, i + 2))),
                ),
                lambda d: d.isNotNull(),
            )
        )

    return F.array_sort(F.array_distinct(F.transform(F.array(terms), windows)[0]))


def title_event_class(c: Column) -> Column:
    terms = title_terms(c)
    return F.when(contains_any_word(terms, ANNOUNCEMENT_WORDS), "announcement").when(contains_any_word(terms, PROTEST_WORDS), "protest").when(contains_any_word(terms, EVENT_WORDS), "event")


def canonical_link(c: Column) -> Column:
    """A link without scheme, ``www.``, fragment, last slashes and tracking parameters."""
    cut = F.split(squeeze_ends(c), "#", 2)[0]
    base = F.regexp_replace(F.substring_index(cut, "?", 1), "^(?:https://)*(?:http://)*(?:www\\.)*", "")
    base = F.lower(F.regexp_replace(base, "/+$", ""))
    query = F.when(F.instr(cut, "?") > 0, F.regexp_replace(cut, r"(?s)^[^?]*\?", "")).otherwise("")

    def tracked(pair: Column) -> Column:
        key = F.lower(F.substring_index(pair, "=", 1))
        return reduce(lambda a, p: a | key.startswith(p), TRACKING_PREFIXES, key.isin(TRACKING_PARAMETERS))

    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~tracked(p))
    return F.when(F.size(kept) == 0, base).otherwise(F.concat(base, F.lit("?"), F.array_join(kept, "&")))


def canonical_street(c: Column) -> Column:
    return squeeze(F.replace(normalize(c), F.lit("-"), F.lit(" ")))


def street_without_number(c: Column) -> Column:
    """Without a last word that starts with a digit."""
    return F.regexp_replace(c, r"(?s) [0-9][^ ]*\z", "")


def street_matches(candidate: Column, name: Column) -> Column:
    """Whether the name is the candidate's street; a bare *street* or *square* names nothing."""
    a, b = canonical_street(candidate), canonical_street(name)
    return F.coalesce((b != "") & ~b.isin(STREET_SUFFIXES) & ((a == b) | a.endswith(F.concat(F.lit(" "), b))), F.lit(False))


def concise_sentences(c: Column, most: int) -> Column:
    """The first distinct sentences; the whole text if none ends; null if there is no text.

    Mostly the first sentences differ, and no more is read of a text.  White space is squeezed in sentences, which
    do not depend on it.  What follows the last sentence is cut off before all are sought, as each of its places
    would be tried as a sentence's start."""
    closing = "[)\\]}\"'”“’‘]*+"
    sentence = f"([^.!?]*+[.!?]{closing})"
    quick = F.array(*[squeeze(F.regexp_extract(c, r"\A" + sentence * most, i + 1)) for i in range(most)])
    tail = F.element_at(F.split(c, "[.!?]"), -1)
    ended = F.concat(F.substr(c, F.lit(1), F.length(c) - F.length(tail)), F.regexp_extract(tail, rf"\A{closing}", 0))
    chosen = F.slice(F.array_distinct(F.transform(F.regexp_extract_all(ended, F.lit(sentence), 1), squeeze)), 1, most)
    found = F.when((quick[0] != "") & (F.size(F.array_distinct(quick)) == most), quick).when(c.rlike("[.!?]"), chosen).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(found) > 0, F.array_join(found, " ")).otherwise(F.nullif(squeeze(c), F.lit("")))


def relevant_article_text(c: Column, low: Column | None = None) -> Column:
    """The text up to the first of the closing markers as whole words; null is empty.  ``low``: the text in
    lower case, if it is at hand; else each marker that is sought makes it anew."""
    marks, whole = "|".join(rf"\Q{m}\E" for m in ARTICLE_END_MARKERS), F.coalesce(c, F.lit(""))
    low = F.lower(whole) if low is None else low
    return F.when(~contains_any(low, ARTICLE_END_MARKERS), whole).otherwise(F.regexp_replace(whole, rf"(?isU)(?<!{ALNUM})(?:{marks})(?!{ALNUM}).*\z", ""))


def short_location(c: Column) -> Column:
    """The first three parts of a comma-separated name; null if none is left."""
    parts = F.filter(F.transform(F.split(c, ","), squeeze_ends), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.array_join(F.slice(parts, 1, 3), ", "))


def format_distance(meters: Column) -> Column:
    """``~950m`` below a kilometre, ``~1.2km`` from there."""
    exact = F.bround(meters / 1000, 1).cast("decimal(18,1)").cast("string")
    return F.when(meters < 1000, F.concat(F.lit("~"), F.round(meters).cast("long").cast("string"), F.lit("m"))).otherwise(F.concat(F.lit("~"), exact, F.lit("km")))


def score_color(score: Column) -> Column:
    return F.when(score >= 5, "🔴").when(score == 4, "🟠").when(score == 3, "🟡").when(score == 2, "🟢").when(score == 1, "🔵").otherwise("⚪")


def unique_names(names: Column) -> Column:
    """Names that differ in more than case, first spelling and order kept."""
    return F.aggregate(names, F.array().cast("array<string>"), lambda out, n: F.when(F.exists(out, lambda o: F.lower(o) == F.lower(n)), out).otherwise(F.concat(out, F.array(n))))


def text_matches_title(text: Column, title: Column) -> Column:
    """Whether enough of the title's significant words are in the text."""
    words, hay = significant_words(title), normalize(text)
    hits = F.size(F.filter(words, lambda w: F.contains(hay, w)))
    return (F.size(words) < 2) | (hits >= 2) | (hits * 2 >= F.size(words))


def is_rolling_url(c: Column) -> Column:
    return contains_any(F.lower(c), ROLLING_URL_PARTS)


def is_google_url(c: Column) -> Column:
    return F.lower(c).rlike(r"news\.google\.|google\.com/url")


def is_missing_message(error: Column) -> Column:
    return contains_any(F.lower(error), MISSING_MESSAGE_PHRASES)


def plain_text(c: Column, decode=None) -> Column:
    """Tags out, entities decoded by ``decode`` (a column function), white space squeezed."""
    stripped = strip_tags(c)
    return squeeze(stripped if decode is None else decode(stripped))


def fnv1a_64(c: Column) -> Column:
    """FNV-1a over the UTF-8 bytes, 16 hex digits.  Products wrap at 64 bits, which columns of longs
    refuse to do, so all rows of an Arrow batch take a byte at a time in an unsigned array."""

    @F.pandas_udf("string")
    def digest(values: pd.Series) -> pd.Series:
        data = [(v or "").encode() for v in values]
        left = np.array([len(d) for d in data], np.int64)
        hashes = np.full(len(data), 0xCBF29CE484222325, np.uint64)
        flat, starts = np.frombuffer(b"".join(data), np.uint8), np.cumsum(left) - left
        for i in range(int(left.max(initial=0))):
            on = np.flatnonzero(left > i)
            hashes[on] = (hashes[on] ^ flat[starts[on] + i]) * np.uint64(0x100000001B3)
        return pd.Series([None if v is None else f"{h:016x}" for v, h in zip(values, hashes.tolist(), strict=True)], dtype=object)

    return digest(c)


def sql_escape(value: str) -> str:
    return re.sub("'", "''", value)
