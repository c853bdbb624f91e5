"""Many terms at once: an index by the start of their first word.

A term's first word begins where a word of the text begins, so both have the same first letters: terms are
kept by these, up to five, and a text looks up the starts of its words, each once.  Boundary and ending
rules (see :func:`vicinity.functions.text.term_pattern`) are checked on the few terms that come up.  The
work on a text does not grow with the number of terms, and nothing is shuffled.

The index is broadcast once for a plan, after its size was measured; each worker reads it once.
"""

from __future__ import annotations

import hashlib
import pickle
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from vicinity.functions import text
from vicinity.functions.shared import bounded_batches

#: Letters of a word that terms are kept by.
START = 5
#: Bytes of an index that may be broadcast: some 500,000 terms.
MOST_BYTES = 64 << 20
#: Terms up to which each is sought in a text: that is faster than taking the text's words, which pays from some 70 terms on.
FEW = 32

_WORD = regex.compile(r"[\p{Alphabetic}\p{N}]+")
_ALNUM = regex.compile(r"[\p{Alphabetic}\p{N}]")
_LETTER = regex.compile(r"\p{Alphabetic}")


@dataclass(frozen=True)
class Term:
    """``ends``: a word must end where the term does; ``place``: a hyphen and a letter may only follow if
    they begin a second half that still means the place."""

    number: int
    literal: str
    ends: bool
    place: bool


class TermIndex:
    """Terms by number.  ``whole``: terms are whole words; else longer ones may be inflected."""

    def __init__(self, terms: list[str], place: bool = False, whole: bool = False):
        self.by_start: dict[str, list[Term]] = {}
        for number, term in enumerate(terms):
            literal = text.normalize_text(term)
            if not literal:
                continue  # an empty term is never mentioned
            ends = whole or len(literal) < 5 or literal[-1] in "0123456789"
            word = _WORD.search(literal)  # without one, or if a short one may go on in a text, every text is looked at
            known = word and (ends or word.end() < len(literal) or len(word.group()) >= START)
            self.by_start.setdefault(word.group()[:START] if known else "", []).append(Term(number, literal, ends, place and not whole))
        every = [t for kept in self.by_start.values() for t in kept]
        self.few = every if len(every) <= FEW else None

    def found(self, value: str | None) -> set[int]:
        """Numbers of the terms that a normalised text mentions."""
        if not value:
            return set()
        starts = {w[:START] for w in _WORD.findall(value)}
        starts.add("")
        return {t.number for s in starts & self.by_start.keys() for t in self.by_start[s] if _mentioned(value, t)}

    def mentioned(self, value: str | None) -> set[int]:
        """As :meth:`found`, by the faster way for the number of terms."""
        if self.few is None:
            return self.found(value)
        return {t.number for t in self.few if _mentioned(value, t)} if value else set()


def _mentioned(value: str, term: Term) -> bool:
    at = value.find(term.literal)
    while at >= 0:
        end = at + len(term.literal)
        if not (at and _ALNUM.match(value, at - 1)) and not (term.ends and _ALNUM.match(value, end)):
            if not term.place or value[end : end + 1] != "-" or not _LETTER.match(value, end + 1) or value.startswith(tuple(text.SAME_PLACE_SUFFIXES), end + 1):
                return True
        at = value.find(term.literal, at + 1)
    return False


#: Indexes that a worker keeps; a plan has a handful.
KEPT = 16
_READ: dict[str, TermIndex] = {}


def shared(index: TermIndex):
    """A broadcast of the index, whose size is measured, as a function that workers call."""
    packed = pickle.dumps(index, protocol=5)
    if len(packed) > MOST_BYTES:
        raise ValueError(f"an index of {len(packed)} bytes is too large to broadcast: split the terms")
    sent, name = SparkSession.getActiveSession().sparkContext.broadcast(packed), hashlib.sha256(packed).hexdigest()

    def read() -> TermIndex:
        if name not in _READ:
            if len(_READ) >= KEPT:
                _READ.clear()
            _READ[name] = pickle.loads(sent.value)
        return _READ[name]

    return read


def found_in(prominent: Column, rest: Column, terms: list[str], place: bool = False, whole: bool = False, owners: list[int] | None = None) -> Column:
    """An array with a number for each term that is mentioned, rising: twice its place in ``terms``, and one
    more if it is in the prominent part.  With ``owners``, one for each owner of a term, in their order: its
    first term in the prominent part, else its first in the rest."""
    read = shared(TermIndex(terms, place, whole))
    bounded_batches()

    def one_each(codes: list[int]) -> list[int]:
        least = {}
        for _, code in sorted((1 - code % 2, code) for code in codes):
            least.setdefault(owners[code // 2], code)
        return [least[o] for o in sorted(least)]

    @F.pandas_udf("array<int>")
    def codes(up: pd.Series, down: pd.Series) -> pd.Series:
        index, out = read(), []
        for a, b in zip(up, down, strict=True):
            above = index.mentioned(a)
            got = sorted([2 * n + 1 for n in above] + [2 * n for n in index.mentioned(b) - above])
            out.append(one_each(got) if owners is not None else got)
        return pd.Series(out, dtype=object)

    return codes(prominent, rest)


def any_of(prominent: Column, rest: Column, terms: list[str], place: bool = False) -> Column:
    """Whether one of the terms is mentioned in either part."""
    return F.size(found_in(prominent, rest, terms, place)) > 0 if terms else F.lit(False)
