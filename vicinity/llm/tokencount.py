"""Token counts of byte-level BPE by rank-synchronous array merging.

Pre-tokens that have not been seen are held as one ragged array: all symbols in a row and where each
pre-token starts.  Each round looks up the rank of every neighbouring pair, finds the lowest rank of
each pre-token, and merges that pair wherever it stands in its pre-token, in all of them at once.
Pre-tokens without a pair that merges leave; what is left of them are their tokens.

Counts are remembered by unit (a stretch of text from one single space to the next, which pre-tokens
never reach over), so common units are counted once a process.  Nulls count as empty texts; special
strings inside a text are one token each, as the library has it by default.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.llm.common import bounded_batches, own_names
from vicinity.llm.tokens import byte_symbols

#: Bytes that the newer of two memories of a process may take, about; then it becomes the older, whose
#: units are forgotten unless they are met again.  A process holds twice this at most.
REMEMBERED_BYTES = 32 << 20
#: Bytes that a remembered unit takes beside its characters, at two bytes each.
OVERHEAD = 110
LONGEST = 64
LIMIT = 512
#: Symbols merged at once at most, beyond one pre-token.
AT_ONCE = 1 << 22
#: Fixed value: the pattern of byte-level BPE's pre-tokens.  White space is Unicode's property.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NONE = np.int64(1 << 40)
AMID = re.compile(r"\s \s").search


class Counter:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        pre = config["pre_tokenizer"]
        if config["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or config["normalizer"] or config["model"].get("ignore_merges"):
            raise ValueError("a byte-level BPE without normalizer is needed")
        vocab = config["model"]["vocab"]
        self.of_byte = np.array([vocab[c] for c in byte_symbols()], np.int64)
        self.width = np.int64(max(vocab.values()) + 1)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in config["model"]["merges"]]
        keys = np.array([vocab[a] * int(self.width) + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in config["added_tokens"]):
            raise ValueError("added tokens that take white space or stand as whole words only are not supported")
        specials = [regex.escape(t["content"]) for t in config["added_tokens"]]
        self.special = regex.compile("|".join(specials)) if specials else None
        self.find = regex.compile(PRE_TOKENS).findall
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.held = 0

    def merge(self, words: list[bytes]) -> np.ndarray:
        """How many symbols are left of each (non-empty) pre-token."""
        out = np.ones(len(words), np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        begin = 0
        ends = np.cumsum(sizes)
        while begin < len(words):
            stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + AT_ONCE, "right")))
            out[begin:stop] = self._merge(b"".join(words[begin:stop]), sizes[begin:stop])
            begin = stop
        return out

    def _merge(self, data: bytes, sizes: np.ndarray) -> np.ndarray:
        symbols = self.of_byte[np.frombuffer(data, np.uint8)]
        left, owner, out = sizes.copy(), np.arange(len(sizes)), sizes.copy()
        while len(left):
            starts = np.cumsum(left) - left
            last = np.zeros(len(symbols), bool)
            last[starts + left - 1] = True
            pairs = symbols[:-1] * self.width + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
            rank = np.full(len(symbols), _NONE)
            rank[:-1] = np.where((self.keys[at] == pairs) & ~last[:-1], self.ranks[at], _NONE)
            lowest = np.minimum.reduceat(rank, starts)
            live = lowest < _NONE
            out[owner[~live]] = left[~live]
            row = np.repeat(np.arange(len(left)), left)
            hit = (rank == lowest[row]) & live[row]
            # of hits in a row (as in aaa) every other one merges, from the left
            spots = np.flatnonzero(hit)
            fresh = np.ones(len(spots), bool)
            fresh[1:] = np.diff(spots) != 1
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(spots)), 0))
            spots = spots[(np.arange(len(spots)) - run) % 2 == 0]
            symbols[spots] = self.made[rank[spots]]
            stay = live[row]
            stay[spots + 1] = False
            symbols = symbols[stay]
            left = (left - np.bincount(row[spots], minlength=len(left)))[live]
            owner = owner[live]
        return out

    def count_many(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text.  Texts with single spaces only between pre-tokens are split there in
        Arrow, and each distinct part is looked up once; other texts go through the pattern whole."""
        total, plain, owner = np.zeros(len(texts), np.int64), [], []
        for i, text in enumerate(texts):
            pieces = [text or ""]
            if self.special and self.special.search(pieces[0]):
                total[i] = len(self.special.findall(pieces[0]))
                pieces = self.special.split(pieces[0])
            for piece in filter(None, pieces):
                if "  " in piece or piece[0] == " " or piece[-1] == " " or AMID(piece):
                    units = self.find(piece)
                    distinct = list(dict.fromkeys(units))
                    size = dict(zip(distinct, self._lookup(distinct), strict=True))
                    total[i] += sum(map(size.__getitem__, units))
                else:
                    plain.append(piece)
                    owner.append(i)
        if plain:
            split = pc.split_pattern(pa.array([x.encode("utf-8", "surrogatepass") for x in plain], pa.binary()).view(pa.string()), " ")
            coded, cuts = split.values.dictionary_encode(), split.offsets.to_numpy()
            parts = [x.decode("utf-8", "surrogatepass") for x in coded.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False)]
            each = np.array(self._lookup([" " + x for x in parts]), np.int64)[coded.indices.to_numpy()]
            first = [parts[k] for k in coded.indices.to_numpy()[cuts[:-1]].tolist()]  # no space before these
            size = dict(zip(distinct := list(dict.fromkeys(first)), self._lookup(distinct), strict=True))
            each[cuts[:-1]] = [size[x] for x in first]
            np.add.at(total, owner, np.add.reduceat(each, cuts[:-1]))
        return total

    def _lookup(self, units: list[str]) -> list[int]:
        """The tokens of distinct units."""
        if self.held > REMEMBERED_BYTES:  # units that are met again move on to the next memory
            self.old, self.new, self.held = self.new, {}, 0
        new, old = self.new, self.old
        missing = [u for u in units if u not in new]
        self._keep({u: old[u] for u in missing if u in old})
        missing = [u for u in missing if u not in new]
        found = [self.find(u) for u in missing]
        flat = list({w for words in found for w in words})
        size = dict(zip(flat, self.merge([w.encode("utf-8", "surrogatepass") for w in flat]).tolist(), strict=True))
        self._keep({u: sum(map(size.__getitem__, words)) for u, words in zip(missing, found, strict=True)})
        out = list(map(new.__getitem__, units))
        for u in [u for u in missing if len(u) > LONGEST]:
            del new[u]
            self.held -= OVERHEAD + 2 * len(u)
        return out

    def _keep(self, counts: dict[str, int]) -> None:
        self.new.update(counts)
        self.held += OVERHEAD * len(counts) + 2 * sum(map(len, counts))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter a file and process."""
    return Counter(path)


#: Characters of the texts that are counted together.
TOGETHER = 1 << 20


def count_tokens(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of each row.  Repeated rows and keys give a row each, null
    keys stay null, null and empty texts have no tokens, an empty table gives an empty one.  Other
    columns are not read; a ``key`` with the name of a new column is an error."""
    own_names(key, "n_bytes", "n_tokens", "over_limit")

    bounded_batches(docs.sparkSession)

    @F.pandas_udf("n_bytes long, n_tokens long, over_limit boolean")
    def counts(texts: pd.Series) -> pd.DataFrame:
        count, values, out, group, held = counter(tokenizer), [x or "" for x in texts], [], [], 0
        for x in values:
            group.append(x)
            held += len(x)
            if held >= TOGETHER:
                out.append(count.count_many(group))
                group, held = [], 0
        tokens = np.concatenate([*out, count.count_many(group)])
        return pd.DataFrame({"n_bytes": np.fromiter((len(x.encode("utf-8", "surrogatepass")) for x in values), np.int64, len(values)), "n_tokens": tokens, "over_limit": tokens > limit})

    return docs.select(F.col(key), counts(F.col(text)).alias("counts")).select(key, "counts.*")
