"""URL filters: prefix rules first, then logistic regression on hashed character trigrams.

Host and path are cut out of the URL by expressions.  The longest rule that fits decides; a rule
``host/path`` fits the host and all its subdomains if the URL's path starts with the rule's.  Where
none fits, the trained model does: character trigrams of the host and of the path, with their ends
marked, are hashed into a fixed number of weights.  Weights are whole numbers (thousandths), so
scores are exact.  Scoring is one expression a row, without join or shuffle.

Null URLs and those without ``://`` have an empty host and path, which no rule fits; the model then
judges two empty strings.  Rows are kept as they are, repeated ones too.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEIGHTS = 4096
#: Rows of a labelled URL table at most.
MOST_LABELLED = 20_000
_A, _B, _C, _PATH = 7919, 104_729, 1_299_709, 611_953
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"

_GOOD = "news garden library history museum weather science travel cooking school college health sports theater music recipes forum wiki research journal archive books mountain river city council transport stories language teacher student paper theory theatre others there thing nation station edition mention lesson reading heather thunder tender hander ember"
_BAD = "casino-win free-bets cheap-pills ads-track spam-farm adult-x casino-online poker-bonus win-money free-casino bets-now best-bets pills-shop cheap-meds viagra-store adult-cams x-adult xxx-tube porn-hub spam-links link-farm ads-click track-pixel click-track payday-loans replica-watch free-prizes lucky-slots slots-win jackpot-win"


def default_labelled() -> list[tuple[str, int]]:
    """A small labelled table: 1 for hosts to block."""
    out = []
    for label, words in ((0, _GOOD.split()), (1, _BAD.split())):
        for i, word in enumerate(words):
            front, end, lang = ("", "www.", "m.", "blog.")[i % 4], ("com", "net", "org")[i % 3], ("en", "de", "fr", "es")[i % 4]
            out.append((f"https://{front}{word}.example.{end}/{lang}/{(i * 37) % 9000 + 100}" + ("", ".html", "/")[i % 3], label))
            out.append((f"http://{word}.{end}/{('about', 'index.html', 'a/b', '')[i % 4]}", label))
    return out


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host between the first ``://`` and the next of ``/?#``, ASCII letters lowered;
    the path from there to ``?`` or ``#``."""
    found = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(found, PARTS, 1), _UPPER, _LOWER), F.regexp_extract(found, PARTS, 2)


def _marked(column: str) -> str:
    return f"concat('^', {column}, '$')"


def _indexes_sql(column: str, extra: int) -> str:
    """The weights' places for the trigrams of a string, as SQL."""
    codes = f"transform(split({_marked(column)}, ''), c -> cast(ascii(c) as bigint))"
    return f"transform(array({codes}), c -> transform(if(size(c) < 3, array(), sequence(0, size(c) - 3)), i -> cast((c[i] * {_A} + c[i + 1] * {_B} + c[i + 2] * {_C} + {extra}) % {WEIGHTS} as int)))[0]"


def indexes(text: str, extra: int) -> list[int]:
    codes = [ord(c) for c in f"^{text}$"]
    return [(a * _A + b * _B + c * _C + extra) % WEIGHTS for a, b, c in zip(codes, codes[1:], codes[2:], strict=False)]


def _split(url: str) -> tuple[str, str]:
    import re

    found = re.match(PARTS, url)
    return (found[1].translate(str.maketrans(_UPPER, _LOWER)), found[2]) if found else ("", "")


def train(labelled: DataFrame | Iterable[tuple[str, int]], rounds: int = 400, rate: float = 0.5, ridge: float = 1e-3) -> tuple[np.ndarray, int]:
    """(weights, bias) in thousandths from (url, label) rows, label 1 for block.  The table is small by
    contract: more than ``MOST_LABELLED`` rows are an error, not a sample."""
    if isinstance(labelled, DataFrame):
        labelled = [tuple(r) for r in labelled.limit(MOST_LABELLED + 1).collect()]
    rows = [(u or "", y) for u, y in labelled if y is not None]
    if len(rows) > MOST_LABELLED:
        raise ValueError(f"a labelled table has at most {MOST_LABELLED} rows")
    x, y = np.zeros((len(rows), WEIGHTS)), np.array([r[1] for r in rows], float)
    for i, (url, _) in enumerate(rows):
        host, path = _split(url)
        np.add.at(x[i], indexes(host, 0) + indexes(path, _PATH), 1)
    weights, bias = np.zeros(WEIGHTS), 0.0
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    for _ in range(rounds if len(rows) else 0):
        miss = (1 / (1 + np.exp(-(x @ weights + bias))) - y) * share
        weights -= rate * (x.T @ miss + ridge * weights)
        bias -= rate * miss.sum()
    return np.round(weights * 1000).astype(np.int64), int(round(bias * 1000))


def score(host: str, path: str, model: tuple[np.ndarray, int]) -> Column:
    """The log odds of block, in thousandths, from the string columns ``host`` and ``path``."""
    weights, bias = model
    table = F.array(*[F.lit(int(w)) for w in weights]).cast("array<bigint>")
    places = F.concat(F.expr(_indexes_sql(host, 0)), F.expr(_indexes_sql(path, _PATH)))
    return F.aggregate(places, F.lit(bias).cast("bigint"), lambda total, i: total + F.get(table, i))


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null where none fits.  ``rules``: (verdict, rule)."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):  # longer ones end up outside
        at, start = text.partition("/")[0], "/" + text.partition("/")[2]
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, rules: list[tuple[str, str]], model: tuple[np.ndarray, int], key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict) of each row."""
    host, path = url_parts(F.col(url))
    cut = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    return cut.select(key, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(score("host", "path", model) > 0, "block").otherwise("allow")).alias("verdict"))


def judge_sql(rules: list[tuple[str, str]], model: tuple[np.ndarray, int], table: str = "pages", key: str = "page_id", url: str = "url") -> str:
    """The same rows in DuckDB's SQL."""
    weights, bias = model
    ordered = sorted(rules, key=lambda r: -len(r[1]))

    def cases(value) -> str:
        arms = [f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{value(v, r)}'" for v, r in ordered]
        return f"CASE {' '.join(arms)} END" if arms else "CAST(NULL AS VARCHAR)"

    def total(column: str, extra: int) -> str:
        s = f"('^' || {column} || '$')"
        code = lambda k: f"unicode(substr({s}, i + {k}, 1))"
        return f"coalesce(list_sum(list_transform(range(1, length({s}) - 1), lambda i: w[(({code(0)}::BIGINT * {_A} + {code(1)}::BIGINT * {_B} + {code(2)}::BIGINT * {_C} + {extra}) % {WEIGHTS}) + 1])), 0)"

    return f"""
    WITH model AS (SELECT [{', '.join(str(int(w)) for w in weights)}]::BIGINT[] AS w),
    cut AS (SELECT {key}, translate(regexp_extract(coalesce({url}, ''), '{PARTS}', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce({url}, ''), '{PARTS}', 2) AS path FROM {table})
    SELECT {key}, host, path, {cases(lambda v, r: r)} AS rule,
           coalesce({cases(lambda v, r: v)}, CASE WHEN {bias} + {total('host', 0)} + {total('path', _PATH)} > 0 THEN 'block' ELSE 'allow' END) AS verdict
    FROM cut, model"""
