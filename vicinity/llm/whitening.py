"""Whitening of embeddings by principal components.

Entries are scaled and rounded down to whole numbers, so sums over all rows are exact whatever the order
in which tasks add them.  One aggregation gives the sums of all dimensions; a second one has a Spark SQL
expression for each pair of dimensions of the upper triangle, which sums the products of centred entries.
The covariance (dimensions squared, whatever the number of rows) is put together on the driver and taken
apart by LAPACK.  Rows are then projected batch by batch, and the covariance of what came out is summed
by the same expressions to measure how far it is from the identity.

Rows are never dealt by a key, so equal vectors, keys or labels make no task larger.

Rows whose vector is null or has null or non-finite entries are left out, and so is an empty table: it
gives no rows.  Vectors shorter than the longest one end in zeros.  Null keys and repeated rows count and
are returned like others; other columns are ignored.  Directions without variance (fewer rows than
dimensions, constant entries) cannot be whitened: their values are null, their explained part is 0, and
they take no part in the identity error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.llm.common import discard_saved, own_names, save

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Sums of one aggregation: all pairs of 90 dimensions; wider vectors take several over the saved cells.
PAIRS = 4096
#: Eigenvalues below this part of the trace, for each dimension, are rounding.
FLAT = 1e-14


@dataclass(frozen=True)
class Whitening:
    """``total``: exact sums of the cells by dimension; ``vectors``: a column for each component."""

    n: int
    total: list[int]
    largest: int
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def kept(self) -> int:
        """Components with variance; they come first."""
        return int((self.values > FLAT * len(self.total) * self.trace).sum())

    @property
    def centre(self) -> list[tuple[int, float]]:
        """The mean of each dimension as its whole part and the rest."""
        return [(s // self.n, (s % self.n) / self.n) for s in self.total]


def cells(rows: DataFrame, key: str, vector: str, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(id, x): each usable vector as whole numbers, floor(scale * entry) + offset."""
    usable = F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform("v", lambda c: F.floor(scale * c) + F.lit(offset).cast("long"))
    return rows.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(usable).select("id", whole.alias("x"))


def products(rows: DataFrame, vector: str, centre: list[tuple[int, float]]) -> np.ndarray:
    """The symmetric matrix of summed centred products of the entries of ``vector``; missing entries are 0."""
    size = len(centre)
    pairs, out = [(i, j) for i in range(size) for j in range(i, size)], np.zeros((size, size))
    for at in range(0, len(pairs), PAIRS):
        some = pairs[at : at + PAIRS]
        entries = [f"(CAST(coalesce(get({vector}, {k}), 0) AS DOUBLE) - {float(centre[k][0])!r}D) - {centre[k][1]!r}D AS c{k}" for k in sorted({k for pair in some for k in pair})]
        sums = rows.selectExpr(*entries).selectExpr(*[f"sum(c{i} * c{j}) AS p{k}" for k, (i, j) in enumerate(some)]).first()
        for (i, j), s in zip(some, sums, strict=True):
            out[i, j] = out[j, i] = s
    return out


def fit(made: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of saved :func:`cells`; None if there are none."""
    n, size = made.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n or not size:
        return None
    entry = [f"coalesce(get(x, {k}), 0)" for k in range(size)]
    # in two halves of 32 bits, whose sums are exact for 2^31 rows
    halves = [F.expr(f"sum({half})") for e in entry for half in (f"shiftright({e}, 32)", f"{e} & 4294967295L")]
    *got, largest = made.agg(*halves, F.max(F.array_max(F.transform("x", lambda x: F.greatest(x, -1 - x))))).first()
    total = [(got[2 * k] << 32) + got[2 * k + 1] for k in range(size)]
    fitted = Whitening(n, total, (largest or 0) + 1, np.zeros(0), np.zeros((size, 0)), 0.0)
    values, vectors = np.linalg.eigh(products(made, "x", fitted.centre) / n)
    order = np.argsort(-values, kind="stable")[:components]
    return Whitening(n, total, fitted.largest, values[order], vectors[:, order], float(values.sum()))


def project(made: DataFrame, model: Whitening) -> DataFrame:
    """(id, deviation, w): the exact squared distance of each vector from the mean, times n squared (null
    beyond a long), and its whitened components that have variance."""
    n, total, kept = model.n, model.total, model.kept
    size, turned = len(total), model.vectors[:, : model.kept] / np.sqrt(model.values[: model.kept])
    reach = 2 * n * model.largest + 1
    narrow = size * reach * reach < 2**63

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.zeros((len(batch), size), np.int64)
            for i, v in enumerate(batch["x"]):
                x[i, : len(v)] = v
            if narrow:
                far = n * x - np.array(total, np.int64)
                deviation = pd.array((far * far).sum(axis=1), dtype="Int64")
            else:
                far = n * x.astype(object) - np.array(total, dtype=object)
                exact = (far * far).sum(axis=1)
                deviation = pd.array([e if e < 2**63 else None for e in exact], dtype="Int64")
            yield pd.DataFrame({"id": batch["id"], "deviation": deviation, "w": list((far / n).astype(float) @ turned)})

    return made.mapInPandas(run, f"id {made.schema['id'].dataType.simpleString()}, deviation long, w array<double>")


def identity_error(whitened: DataFrame, model: Whitening) -> float | None:
    """The largest absolute entry of the covariance of ``w`` less the identity."""
    if not model.kept:
        return None
    means = whitened.agg(*[F.expr(f"avg(get(w, {k}))") for k in range(model.kept)]).first()
    found = products(whitened, "w", [(0, m) for m in means]) / model.n
    return float(np.abs(found - np.eye(model.kept)).max())


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for each usable row and component."""
    own_names(key, "component", "n", "deviation", "whitened", "explained", "identity_error")
    made = save(cells(rows, key, vector), "cells")
    model = fit(made, components)
    if model is None:
        long, double = (F.lit(None).cast(t) for t in ("long", "double"))
        return made.where("false").select(F.col("id").alias(key), F.lit(0).alias("component"), long.alias("n"), long.alias("deviation"), *[double.alias(c) for c in ("whitened", "explained", "identity_error")])
    whitened = save(project(made, model), "whitened")
    discard_saved(made)
    error = identity_error(whitened, model)
    parts = [float(v) / model.trace if k < model.kept else 0.0 for k, v in enumerate(model.values)]
    each = F.explode(F.sequence(F.lit(1), F.lit(len(parts)))).alias("component")
    at = F.col("component") - 1
    return whitened.select("id", "deviation", "w", each).select(
        F.col("id").alias(key), "component", F.lit(model.n).cast("long").alias("n"), "deviation", F.get("w", at).alias("whitened"), F.get(F.array(*map(F.lit, parts)), at).alias("explained"), F.lit(error).cast("double").alias("identity_error")
    )
