"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

Statistics of a text are standardised and mapped by fixed random cosine features, which approximate
a Gaussian kernel.  Parts of the labelled sample, by a hash of the key, sum the normal equations of their
rows (a matrix of a fixed size each); the sums are added and solved for ridge weights.  The isotonic map
from raw scores to the share of good texts is fitted across: each fold of parts is scored by weights from
the other folds' sums, so every labelled row serves both ends, at every size.  Scores use the text alone:
no label, language, source or key.

The model is fitted on at most ``MOST_LABELLED`` labelled rows: labels with the lowest hashes of their
key, and of the rows that these find (a key may have many) those with the lowest hashes of key and text.
Sums are of sorted rows and added in order, so a repeated task or another cluster gives the same model.
All rows are scored.  Nulls count as empty texts, which get a score like any other.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinity.llm.common import bounded_batches, discard_saved, fresh, own_names, save

MOST_LABELLED = 20_000
FEATURES = 256
BANDWIDTH = 4.0
RIDGE = 1e-3
#: Parts whose sums are added on the driver, each a matrix of FEATURES + 1 squared doubles, and their folds.
PARTS, FOLDS = 16, 4
THRESHOLD = 0.7
_MARKS = re.compile(r"[#*$%&|<>]")
_UPPER = re.compile(r"\b[^\W\d_a-z]{2,}\b")
_SENTENCES = re.compile(r"[.!?]+(?:\s|$)")


def statistics(text: str | None) -> list[float]:
    """Numbers about a text: sizes, ratios of symbols, repetition of lines, words and windows."""
    t = text or ""
    words = t.split()
    n, m = max(1, len(words)), max(1, len(t))
    lines = [x for x in t.split("\n") if x.strip()]
    counts = Counter(words)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    sentences = Counter(x.strip() for x in re.split(r"[.!?\n]+", t) if x.strip())
    return [
        np.log1p(len(words)), np.log1p(len(lines)), float(lengths.mean()), float(lengths.std()),
        np.sqrt(len(_MARKS.findall(t)) / n), np.sqrt(t.count("|") / n), np.sqrt(t.count("!") / n), np.sqrt(len(_UPPER.findall(t)) / n), np.sqrt(sum(map(str.isdigit, t)) / m) if any(c in t for c in "0123456789") else 0.0,
        len(counts) / n, max(counts.values(), default=0) / n, len(set(windows)) / max(1, len(windows)),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        len(set(lines)) / max(1, len(lines)), max(sentences.values(), default=0) / max(1, sum(sentences.values())), len(sentences) / max(1, sum(sentences.values())),
        np.log1p(len(_SENTENCES.findall(t)) / n * 20), t.count(",") / n, sum(x.rstrip()[-1] in ".!?" for x in lines) / max(1, len(lines)), m / n,
    ]


WIDTH = len(statistics(""))


def table(texts) -> np.ndarray:
    return np.array([statistics(x) for x in texts], float).reshape(-1, WIDTH)


@dataclass
class Model:
    """Fitted numbers; a few thousand doubles, whatever the size of the input."""

    centre: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray
    learned: bool = True  # False: there was no labelled row, and scores say nothing

    def waves(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        return np.hstack([np.ones((len(z), 1)), np.sqrt(2 / len(self.phase)) * np.cos(z @ self.turn + self.phase)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.waves(x) @ self.weights

    def sums(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The normal equations of these rows."""
        z = self.waves(x)
        return z.T @ z, z.T @ y

    def finish(self, parts: dict[int, tuple[np.ndarray, np.ndarray]], x: np.ndarray, y: np.ndarray, part: np.ndarray) -> None:
        """Weights from the sums of all parts, and the isotonic map from scores by the other folds' sums."""

        def solved(chosen: list[int]) -> np.ndarray:
            gram, right = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
            for p in chosen:
                gram, right = gram + parts[p][0], right + parts[p][1]
            free = np.eye(FEATURES + 1)
            free[0, 0] = 0
            return np.linalg.lstsq(gram + RIDGE * max(1.0, gram[0, 0]) * free, right, rcond=None)[0]

        self.weights, raw = solved(sorted(parts)), np.zeros(len(x))
        for fold in range(FOLDS):
            inside = part % FOLDS == fold
            others = [p for p in sorted(parts) if p % FOLDS != fold]
            if inside.any():  # labelled rows of one fold only: they have no others
                raw[inside] = self.waves(x[inside]) @ (solved(others) if others else self.weights)
        self.knots, self.levels = isotonic(np.round(raw, 9), y)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.levels), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(knots, levels) of the nondecreasing fit of y on x, by pooling adjacent violators."""
    values, at = np.unique(x, return_inverse=True)
    pools: list[list[float]] = []  # sum of y, count, first x, last x
    for a, n, s in zip(values, np.bincount(at), np.bincount(at, weights=y), strict=True):
        pools.append([s, n, a, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, n, _, z = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += n
            pools[-1][3] = z
    knots = np.array([v for p in pools for v in (p[2], p[3])])
    levels = np.repeat([p[0] / p[1] for p in pools], 2)
    return knots, levels


def _start(x: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    scale = x.std(axis=0) if len(x) else np.ones(WIDTH)
    return (x.mean(axis=0) if len(x) else np.zeros(WIDTH)), np.where(scale > 1e-9, scale, 1.0), rng.normal(0, 1 / BANDWIDTH, (WIDTH, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = MOST_LABELLED, only: Column | None = None) -> Model:
    """A model from rows with a label of 0 or 1.  ``only``: a condition on the labels' ``key`` that all
    rows used in any way meet.  Without any such row every score is 0.5, and ``keep`` keeps all.  A key
    labelled twice counts for both labels, repeated rows count each."""
    bounded_batches(docs.sparkSession)
    own = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1))
    own = (own if only is None else own.where(only)).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    chosen = own.orderBy(F.xxhash64("k"), "k", "y").limit(most)

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series(list(table(texts)), dtype=object)

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("body")).join(F.broadcast(chosen), "k")  # at most ``most`` pairs of integers
    part = F.pmod(F.xxhash64(F.lit("calibrate"), "k"), F.lit(PARTS)).cast("int")
    turned = rows.select("y", part.alias("part"), F.xxhash64("k", "body").alias("turn"), measured("body").alias("x"))
    sample = save(turned.orderBy("turn", "y", "part").limit(most), "sample")
    got = in_order(sample.toPandas())  # at most ``most`` rows
    if not len(got):
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros((WIDTH, 1)), np.zeros(1), np.zeros(2), np.array([0.0]), np.array([0.5]), learned=False)
    x = np.stack(got["x"].to_list())
    centre, scale, turn, phase = _start(x)
    model = Model(centre, scale, turn, phase, np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1))

    def sums(group: pd.DataFrame) -> pd.DataFrame:
        group = in_order(group)
        gram, right = model.sums(np.stack(group["x"].to_list()), group["y"].to_numpy(float))
        return pd.DataFrame({"part": group["part"][:1], "gram": [gram.tobytes()], "right": [right.tobytes()]})

    summed = sample.groupBy("part").applyInPandas(sums, "part int, gram binary, right binary").collect()  # PARTS rows at most
    discard_saved(sample)
    model.finish({r["part"]: (np.frombuffer(bytes(r["gram"])).reshape(FEATURES + 1, -1), np.frombuffer(bytes(r["right"]))) for r in summed}, x, got["y"].to_numpy(float), got["part"].to_numpy())
    return model


def in_order(rows: pd.DataFrame) -> pd.DataFrame:
    """Sorted by all columns, so that sums do not depend on how rows came; equal rows are alike."""
    values = np.stack(rows["x"].to_list()) if len(rows) else np.zeros((0, WIDTH))
    return rows.iloc[np.lexsort([*values.T[::-1], rows["y"], rows["turn"]])].reset_index(drop=True)


def score_column(text: str, model: Model):
    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(table(texts)))

    return scores(F.col(text))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, score, predicted) of each row, repeated rows each.  Other columns are not read, whatever
    their names; a ``key`` with the name of a new column is an error.  An empty table gives an empty one."""
    own_names(key, "score", "predicted")
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(key), score_column(text, model).alias("score")).select(key, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows scored at the threshold or above, all columns, repeated rows each; every row if nothing
    was learned.  An empty table gives an empty one."""
    if not model.learned:
        return docs
    bounded_batches(docs.sparkSession)
    mark, = fresh(docs, "score")
    return docs.withColumn(mark, score_column(text, model)).where(F.col(mark) >= threshold).drop(mark)
