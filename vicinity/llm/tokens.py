"""Token ids of whole texts by the tokenizers library, remembered by white-space-delimited unit.

The word tokenizer's normalizer and its pre-tokenizer treat every ASCII white space character as a
boundary, so the ids of a text are those of its units one after another.  Each unit is encoded once
by the library and its ids are kept for the next time; :func:`encoder` refuses a file for which this
does not hold and then encodes whole texts.
"""

from __future__ import annotations

import gc
import json
import os
from array import array
from functools import lru_cache
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 1
#: Bytes that the newer of two memories of a process may take, about; then it becomes the older, whose
#: units are forgotten unless they are met again.  A process holds twice this at most.
REMEMBERED_BYTES = 48 << 20
#: Bytes that a remembered unit takes beside its own and those of its ids: two objects, its place in the
#: table and what the table has in reserve.
OVERHEAD = 140
#: Units that the library encodes in one call.
AT_ONCE = 10_000
#: A number sign: between other characters it is a pre-token, and a token, of its own.
BETWEEN = "\u00bd"
#: Marks of which a run behind a letter is a pre-token, and tokens, of its own: all of ASCII but the one that
#: starts suffixes and the one that special strings have.
ENDS = b".,;:!?#*$%&|>()[]{}+-=/~^@_\"\\`"
#: Longer units are encoded each time.
LONGEST = 64


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes for
    themselves, the others from code point 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class Encoder:
    """``ids(text)``: the ids of a whole text, an array of unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            self.splits = splits_at_space(json.load(f))
        self.lowers = self.splits and any(x == "Lowercase" for x in self.steps(json.loads(self.library.to_str())))
        if self.splits:
            marks = self.library.encode(BETWEEN, add_special_tokens=False).ids
            self.splits, self.mark = len(marks) == 1, marks[0]
            self.ends: dict[bytes, bytes] = {}
            self.model = self.library.model
            self.model._resize_cache(0)  # no unit comes twice
            self.symbols = dict(enumerate(byte_symbols())) | {ord(" "): " "}
        self.new: dict[bytes, bytes] = {b"": b""}
        self.old: dict[bytes, bytes] = {}
        self.held = 0

    @staticmethod
    def steps(config: dict) -> list[str]:
        norm = config.get("normalizer") or {}
        return [x.get("type") for x in norm.get("normalizers", [norm] if norm else [])]

    def _raw(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _plain(self, text: str | None) -> bytes:
        data = (text or "").encode("utf-8", "surrogatepass")
        if self.lowers and b"<" not in data:  # special strings are told apart by case
            data = data.lower()  # bytes: ASCII letters only, which the normalizer lowers too
        return data

    def ids_bytes_many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if not self.splits:
            return [self._raw(t) if t else b"" for t in texts]
        collects = gc.isenabled()
        gc.disable()  # nothing here is in a cycle, and long lists take the collector long
        try:
            return self._remembered(texts)
        finally:
            if collects:
                gc.enable()

    def _keep(self, units: list[bytes], ids: list[bytes]) -> None:
        self.new.update(zip(units, ids, strict=True))
        self.held += OVERHEAD * len(units) + sum(map(len, units)) + sum(map(len, ids))

    def _end(self, marks: bytes) -> bytes:
        """The ids of a run of marks behind a letter; of short runs, of which there are few, remembered."""
        ids = self.ends.get(marks)
        if ids is None:
            ids = self._raw(marks.decode())
            if len(marks) < 4 and len(self.ends) < AT_ONCE:
                self.ends[marks] = ids
        return ids

    def _remembered(self, texts: list[str | None]) -> list[bytes]:
        """Splits the texts into units, looks each distinct one up once, and puts the ids together."""
        if not texts:
            return []
        split = pc.ascii_split_whitespace(pa.array(map(self._plain, texts), pa.binary()).view(pa.string()))
        coded, cuts = split.values.dictionary_encode(), split.offsets.to_numpy()
        if not len(coded):
            return [b""] * len(texts)
        found = self._lookup(coded.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False).tolist())
        whole = pa.array(found, pa.large_binary()).take(coded.indices)
        _, ends, data = whole.buffers()
        stops, out = np.frombuffer(ends, np.int64, len(whole) + 1)[cuts].tolist(), memoryview(data or b"")
        return [bytes(out[x:y]) for x, y in zip(stops[:-1], stops[1:], strict=True)]

    def _lookup(self, units: list[bytes]) -> list[bytes]:
        """The ids of distinct units."""
        if self.held > REMEMBERED_BYTES:  # units that are met again move on to the next memory
            self.old, self.new, self.held = self.new, {b"": b""}, 0
        new, old = self.new, self.old
        found = list(map(new.get, units))
        missing = [u for u, ids in zip(units, found, strict=True) if ids is None]
        if not missing:
            return found
        if old:
            again = list(map(old.get, missing))
            self._keep([u for u, ids in zip(missing, again, strict=True) if ids is not None], [ids for ids in again if ids is not None])
            missing = [u for u, ids in zip(missing, again, strict=True) if ids is None]
        words, ended, bodies, rest = self._kinds(missing)
        words = [w for w in {*words, *bodies} if w not in new]
        self._keep(words, self._encode_words(words))
        self._keep(ended, [new[w] + self._end(u[len(w) :]) for u, w in zip(ended, bodies, strict=True)])
        self._keep(rest, self._encode_rest(rest))
        found = [new[u] if ids is None else ids for u, ids in zip(units, found, strict=True)]
        for u in [u for u in {*missing, *words} if len(u) > LONGEST]:
            self.held -= OVERHEAD + len(u) + len(new.pop(u))
        return found

    def _kinds(self, units: list[bytes]) -> tuple[list[bytes], list[bytes], list[bytes], list[bytes]]:
        """Units of Latin-1 letters only, such units with marks behind, these without their marks, and
        all others."""
        words, ended, bodies, rest = [], [], [], []
        for u in units:
            body = u.rstrip(ENDS)
            if not body.isalpha():  # bytes: ASCII letters only
                s = body.decode("utf-8", "surrogatepass")
                if not s.isalpha() or max(s) > "\u00ff":
                    rest.append(u)
                    continue
            if len(body) == len(u):
                words.append(u)
            else:
                ended.append(u)
                bodies.append(body)
        return words, ended, bodies, rest

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of units of Latin-1 letters.  Each is a pre-token, which the normalizer only lowers, so
        they go to the library's model without either."""
        tokenize, out = self.model.tokenize, []
        for at in range(0, len(words), AT_ONCE):
            text = b" ".join(words[at : at + AT_ONCE]).decode("utf-8")
            text = text.lower() if self.lowers else text
            if not text.isascii():
                text = text.encode("utf-8").decode("latin-1").translate(self.symbols)
            tokens = list(map(tokenize, text.split(" ")))
            raw = array("I", [t.id for word in tokens for t in word]).tobytes()
            stops = [0, *accumulate([4 * len(word) for word in tokens])]
            out += [raw[a:b] for a, b in pairwise(stops)]
        return out

    def _encode_rest(self, units: list[bytes]) -> list[bytes]:
        """The ids of other units, through all of the library, with a number sign between them that is
        always a token of its own."""
        out = []
        for at in range(0, len(units), AT_ONCE):
            part = units[at : at + AT_ONCE]
            ids = np.array(self.library.encode_batch_fast([BETWEEN.encode().join(part).decode("utf-8", "surrogatepass")], add_special_tokens=False)[0].ids, "<u4")
            marks = np.flatnonzero(ids == self.mark)
            if len(marks) != len(part) - 1:  # as where a unit has the number sign itself
                out += [self._raw(u.decode("utf-8", "surrogatepass")) for u in part]
                continue
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *(4 * marks + 4).tolist()], [*(4 * marks).tolist(), len(raw)], strict=True)]
        return out

    def ids_bytes(self, text: str | None) -> bytes:
        return self.ids_bytes_many([text])[0]

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.ids_bytes(text), "<u4")


def in_groups(texts, characters: int = 1 << 21):
    """Lists of neighbouring texts of about so many characters in all."""
    group, held = [], 0
    for t in texts:
        group.append(t)
        held += len(t or "")
        if held >= characters:
            yield group
            group, held = [], 0
    if group:
        yield group


def splits_at_space(config: dict) -> bool:
    """Whether no token of this tokenizer, nor its normalizer, reaches over ASCII white space."""
    pre, norm = config.get("pre_tokenizer") or {}, config.get("normalizer") or {}
    steps = Encoder.steps(config)
    first = (pre.get("pretokenizers") or [pre])[0]
    return (
        set(steps) <= {"NFC", "Replace", "Lowercase"}
        and all(x.get("pattern") == {"Regex": r"\s+"} and x.get("content") == " " for x in norm.get("normalizers", []) if x.get("type") == "Replace")
        and first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
        and first.get("pattern") == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
        and all("<" in x["content"] and not any(c.isspace() for c in x["content"]) and not x["lstrip"] and not x["rstrip"] and not x["single_word"] for x in config.get("added_tokens", []))
    )


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder a file and process."""
    return Encoder(path)
