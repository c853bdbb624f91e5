"""Quality rules: a decision list learned from labelled statistics, as ordered Spark expressions.

Statistics of a text are one expression: words, characters, symbols, repeated lines, words in
repeated three-word windows.  It reads the text once, within its row, without a shuffle.  Windows are
compared by 64-bit hashes first and, where two of a text are equal, word by word.

Sequential covering learns the list: each rule grows by the threshold condition with the best
information gain until it covers no good text, is pruned from its end on held-back rows, and is kept
if it is precise there; texts that it covers are then set aside.  The list becomes nested
conditional expressions in the order learned.  It is learned from at most ``MOST_LABELLED`` labelled
rows: labels with the lowest hashes of their key, and of the rows that these find (a key may have many)
those with the lowest hashes of key and text.  Everything else covers all rows.

Null texts have no words.  A text without words fails the base rule.  Repeated rows and keys are judged
each; ties between conditions go to the first in the order of ``FEATURES`` and cuts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinity.llm.common import fresh, own_names

#: Labelled rows that a list is learned from, at most.
MOST_LABELLED = 20_000
FEATURES = ("symbol_ratio", "upper_ratio", "pipe_ratio", "bang_ratio", "repeat_ratio", "dup_line_ratio", "word_length", "distinct_ratio", "stop_ratio", "n_words")
MAX_RULES, MAX_CONDITIONS, MIN_PRECISION, MIN_COVER, CUTS = 24, 4, 0.9, 3, 40
_SPACE = r"\\x20\\x09-\\x0D"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is then evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def statistics(text: str) -> Column:
    """A struct with the base counts of the string column ``text`` and the features of the rules."""
    blanks = "' \\t\\n\\u000b\\u000c\\r'"
    words = f"filter(split(t, '[{_SPACE}]+'), x -> x <> '')"
    lines = f"filter(split(t, '\\n'), x -> x rlike '[^{_SPACE}]')"
    hashes = "if(size(w) < 3, cast(array() as array<bigint>), transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])))"
    # windows that are found twice or more: neighbours in the order of hashes and words; then the words that they cover
    same = lambda i: f"(get(s, {i}).h = x.h and get(s, {i}).v = x.v)"
    twice = f"filter(transform(s, (x, i) -> if((i > 0 and {same('i - 1')}) or (i < size(s) - 1 and {same('i + 1')}), x.p, -1)), p -> p >= 0)"
    covered = "aggregate(sequence(0, size(d) - 1), 0L, (n, i) -> n + if(i = size(d) - 1, 3, least(3, get(d, i + 1) - d[i])))"
    repeated = _let(hashes, "h", "if(size(array_distinct(h)) = size(h), 0L, " + _let("sort_array(transform(h, (x, i) -> named_struct('h', x, 'v', concat_ws(' ', w[i], w[i + 1], w[i + 2]), 'p', i)))", "s", _let(f"sort_array({twice})", "d", covered)) + ")")
    counted = (
        "named_struct('n_words', cast(size(w) as bigint), "
        f"'word_chars', cast(length(translate(t, {blanks}, '')) as bigint), "
        "'n_symbols', cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint), "
        f"'n_dup_lines', cast({_let(lines, 'l', 'size(l) - size(array_distinct(l))')} as bigint), "
        f"'n_repeat_words', {repeated}, "
        "'n_pipes', cast(length(t) - length(replace(t, '|', '')) as bigint), "
        "'n_bangs', cast(length(t) - length(replace(t, '!', '')) as bigint), "
        "'n_upper', cast(regexp_count(t, '\\\\p{Lu}') as bigint), "
        "'n_lines', cast(length(t) - length(replace(t, '\\n', '')) + 1 as bigint), "
        "'n_stops', cast(length(t) - length(replace(t, '.', '')) as bigint), "
        "'n_distinct', cast(size(array_distinct(w)) as bigint))"
    )
    per = lambda a, b: f"round(a.{a} / greatest(a.{b}, 1), 6)"
    features = ", ".join(f"'{n}', {v}" for n, v in (("symbol_ratio", per("n_symbols", "n_words")), ("upper_ratio", per("n_upper", "word_chars")), ("pipe_ratio", per("n_pipes", "n_words")), ("bang_ratio", per("n_bangs", "n_words")), ("repeat_ratio", per("n_repeat_words", "n_words")), ("dup_line_ratio", per("n_dup_lines", "n_lines")), ("word_length", per("word_chars", "n_words")), ("distinct_ratio", per("n_distinct", "n_words")), ("stop_ratio", per("n_stops", "n_words"))))
    base = ", ".join(f"'{c}', a.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    failed = "a.n_words < 50 or 100 * a.n_repeat_words > 50 * a.n_words"
    return F.expr(_let(f"coalesce(`{text}`, '')", "t", _let(words, "w", _let(counted, "a", f"named_struct({base}, 'base_failed', {failed}, {features})"))))


Condition = tuple[str, str, float]  # feature, ">=" or "<", threshold


def _covers(conditions: list[Condition], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, sign, cut in conditions:
        value = x[:, FEATURES.index(name)]
        out &= value >= cut if sign == ">=" else value < cut
    return out


def _grow(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray]) -> list[Condition]:
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < MAX_CONDITIONS and (y[inside] == 0).any():
        p0, n0 = int((y[inside] == 1).sum()), int((y[inside] == 0).sum())
        best, chosen = 0.0, None
        for k, name in enumerate(FEATURES):
            v, bad = x[inside, k], y[inside] == 1
            for cut in cuts[k]:
                above = v >= cut
                for sign, hit in ((">=", above), ("<", ~above)):
                    p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
                    if p >= MIN_COVER and (p, n) != (p0, n0):
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if gain > best + 1e-9:
                            best, chosen = gain, (name, sign, float(cut))
        if chosen is None:
            break
        rule.append(chosen)
        inside = _covers(rule, x)
    return rule


def learn(x: np.ndarray, y: np.ndarray, held: np.ndarray) -> list[list[Condition]]:
    """Ordered rules that reject.  ``x``: rows by ``FEATURES``; ``y``: 1 for texts to reject; ``held``:
    rows that prune and judge.  No rows, or one kind of label only: no rules."""
    out: list[list[Condition]] = []
    cuts = []
    for k in range(len(FEATURES)):
        values = np.unique(x[:, k])
        if len(values) > CUTS:  # from all rows and from those to reject, so that rare kinds get cuts of their own
            values = np.unique(np.concatenate([np.quantile(v, np.linspace(0, 1, CUTS), method="nearest") for v in (x[:, k], x[y == 1, k]) if len(v)]))
        cuts.append(np.round((values[1:] + values[:-1]) / 2, 7))
    grow, check, tried = ~held, held.copy(), 0
    while len(out) < MAX_RULES and (y[grow] == 1).sum() >= MIN_COVER and tried < 2 * MAX_RULES:
        tried += 1
        rule = _grow(x[grow], y[grow], cuts)
        if not rule:
            break

        def worth(r: list[Condition], check: np.ndarray = check) -> float:
            hit = _covers(r, x[check])
            p, n = int((hit & (y[check] == 1)).sum()), int((hit & (y[check] == 0)).sum())
            return (p - n) / (p + n) if p + n else -1.0

        best = max((rule[:n] for n in range(len(rule), 0, -1)), key=worth)
        covered = _covers(best, x)
        p, n = int((covered & (grow | check) & (y == 1)).sum()), int((covered & (grow | check) & (y == 0)).sum())
        if worth(best) < 2 * MIN_PRECISION - 1 or p < MIN_PRECISION * (p + n):
            grow = grow & ~(covered & (y == 1) & grow)  # no rule of its own for these; the next may differ
            continue
        out.append(best)
        grow, check = grow & ~covered, check & ~covered
    return out


def rejects(rules: list[list[Condition]], stats: str) -> Column:
    """Whether the first rule that holds rejects, as ordered conditional expressions on a lambda's or
    column's struct named ``stats``."""
    return F.expr(rejects_sql(rules, stats))


def rejects_sql(rules: list[list[Condition]], stats: str) -> str:
    arms = " ".join("when " + " and ".join(f"{stats}.{name} {sign} {cut!r}D" for name, sign, cut in rule) + " then true" for rule in rules)
    return f"case {arms} else false end" if arms else "false"


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = MOST_LABELLED, only: Column | None = None) -> list[list[Condition]]:
    """The list learned from rows of ``docs`` with a label of 0 (reject) or 1.  ``only`` narrows the
    labelled rows by a condition on ``key``.  Rows of a key that is labelled twice differently count
    for both.  No labelled row, or labels of one kind: an empty list."""
    own = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1))
    own = (own if only is None else own.where(only)).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    chosen = own.orderBy(F.xxhash64("k"), "k", "y").limit(most)
    found = docs.select(F.col(key).alias("k"), F.col(text).alias("body")).join(F.broadcast(chosen), "k")  # at most ``most`` pairs of integers
    rows = found.select("y", held_part("k").alias("part"), F.xxhash64("k", "body").alias("turn"), statistics("body").alias("s"))
    got = rows.select("turn", "y", "part", *[F.col(f"s.{f}").cast("double").alias(f) for f in FEATURES]).orderBy("turn", "y").limit(most).collect()
    x = np.array([[r[f] for f in FEATURES] for r in got], float).reshape(-1, len(FEATURES))
    return learn(x, np.array([1 - r["y"] for r in got], int), np.array([r["part"] == 0 for r in got], bool))


def held_part(key: str) -> Column:
    """0, 1 or 2 by a hash of the key: rows of part 0 prune and judge rules."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit("held:"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(3))


def judge(docs: DataFrame, rules: list[list[Condition]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, base counts, base_failed, kept) of each row.  Other columns are not read, whatever
    their names; a ``key`` with the name of a new column is an error.  An empty table gives an empty one."""
    own_names(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    stats = docs.select(F.col(key), statistics(text).alias("stats"))
    return stats.select(key, *[f"stats.{c}" for c in base], (~F.col("stats.base_failed") & ~rejects(rules, "stats")).alias("kept"))


def keep(docs: DataFrame, rules: list[list[Condition]], text: str = "text") -> DataFrame:
    """The rows that neither the base rule nor the list rejects, all columns.  One expression: the
    statistics are evaluated once a row."""
    body, = fresh(docs, "body")
    verdict = F.transform(F.array(statistics(body)), lambda s: ~s["base_failed"] & ~_rejects_of(s, rules))[0]
    return docs.withColumn(body, F.col(text)).where(verdict).drop(body)


def _rejects_of(s: Column, rules: list[list[Condition]]) -> Column:
    out = F.lit(False)
    for rule in reversed(rules):
        holds = F.lit(True)
        for name, sign, cut in rule:
            value = s[name].cast("double")
            holds = holds & (value >= cut if sign == ">=" else value < cut)
        out = F.when(holds, True).otherwise(out)
    return out


def statistics_sql(table: str = "documents") -> str:
    """A chain of DuckDB's WITH tables that ends in ``stats``: row number, doc_id and all statistics."""
    blanks = r"\x20\x09-\x0D"
    ratio = lambda a, b: f"round({a}::DOUBLE / greatest({b}, 1), 6)"
    without = lambda c: f"(length(t) - length(replace(t, '{c}', '')))"
    return f"""
    texts AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM {table}),
    worded AS (SELECT *, list_filter(regexp_split_to_array(t, '[{blanks}]+'), lambda x: x <> '') AS w,
               list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{blanks}]')) AS l FROM texts),
    spots AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS v FROM worded WHERE len(w) > 2),
    windows AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, v) AS n FROM spots),
    repeated AS (SELECT rid, count(DISTINCT i + k) AS n FROM windows, range(3) AS r(k) WHERE n > 1 GROUP BY rid),
    counted AS (SELECT worded.rid, doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[{blanks}]', '', 'g'))::BIGINT AS word_chars,
                (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
                {without('|')} AS n_pipes, {without('!')} AS n_bangs, {without('.')} AS n_stops, len(regexp_extract_all(t, '\\p{{Lu}}')) AS n_upper, len(string_split(t, chr(10))) AS n_lines, len(list_distinct(w)) AS n_distinct
                FROM worded LEFT JOIN repeated ON worded.rid = repeated.rid),
    stats AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {ratio('n_symbols', 'n_words')} AS symbol_ratio, {ratio('n_upper', 'word_chars')} AS upper_ratio, {ratio('n_pipes', 'n_words')} AS pipe_ratio,
              {ratio('n_bangs', 'n_words')} AS bang_ratio, {ratio('n_repeat_words', 'n_words')} AS repeat_ratio, {ratio('n_dup_lines', 'n_lines')} AS dup_line_ratio, {ratio('word_chars', 'n_words')} AS word_length,
              {ratio('n_distinct', 'n_words')} AS distinct_ratio, {ratio('n_stops', 'n_words')} AS stop_ratio FROM counted)"""


def judge_sql(rules: list[list[Condition]], table: str = "documents") -> str:
    """The rows of :func:`judge` for a learned list, in DuckDB's SQL."""
    verdict = rejects_sql(rules, "stats").replace("D and", " and").replace("D then", " then")
    return f"WITH {statistics_sql(table)} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({verdict}) AS kept FROM stats"
