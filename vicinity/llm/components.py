"""Connected components of a link table, without bringing links to the driver.

Each round contracts the links of every partition to a forest of stars (memory: the distinct nodes
of that partition), then joins the stars of all partitions by a small-star and a large-star step.
Rounds are written to the shared folder, so a lost executor costs no more than the current one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.llm.common import discard_saved, save


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star links (node, smallest node of its component) for links a-b; smallest nodes are left out."""
    if not len(a):
        return a[:0], b[:0]
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[left], label[right])
        if (low == label[left]).all() and (low == label[right]).all():
            break
        for side in (left, right):
            np.minimum.at(label, label[side], low)
        while (label[label] != label).any():
            label = label[label]
        keep = label[left] != label[right]
        left, right = left[keep], right[keep]
    moved = label != np.arange(len(ids))
    return ids[moved], ids[label[moved]]


#: Links taken up at least before they are contracted.
PENDING = 1 << 16


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contracts whenever as many links wait as the forest has, so the work follows the links' number."""
    a = b = np.empty(0, np.int64)
    waiting, held = [], 0
    for batch in batches:
        waiting.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)])
        held += batch.num_rows
        if held >= max(PENDING, len(a)):
            a, b = forest(*(np.concatenate([x, *(w[i] for w in waiting)]) for i, x in enumerate((a, b))))
            waiting, held = [], 0
    a, b = forest(*(np.concatenate([x, *(w[i] for w in waiting)]) for i, x in enumerate((a, b))))
    for i in range(0, len(a), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(a[i : i + (1 << 16)]), pa.array(b[i : i + (1 << 16)])], ["node", "root"])


#: Links that a task contracts, so that few links are not spread over many tasks.
LINKS_EACH = 1 << 20


def _contracted(links: DataFrame, tasks: int) -> DataFrame:
    return links.coalesce(tasks).mapInArrow(_contract, "node long, root long")


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for each node with a link; root is the smallest node of its component.

    ``links`` has two long columns without nulls, in any order, repeats allowed; smallest nodes have
    no row of their own.  An empty table gives an empty one.  The table is read twice: save it if it is dear.
    """
    tasks = 1 + links.count() // LINKS_EACH
    stars = save(_contracted(links.select(F.col(a).alias("node"), F.col(b).alias("root")), tasks), "stars")
    if tasks == 1:
        return stars  # one task has contracted all links
    while True:
        sides = stars.select(F.col("node"), F.lit(1).alias("child"), F.lit(0).alias("top")).unionByName(stars.select(F.col("root").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("top")))
        state = sides.groupBy("node").agg(F.sum("child").alias("child"), F.max("top").alias("top"))
        if state.where("child > 1 or (child = 1 and top = 1)").isEmpty():
            return stars
        # small star: all smaller neighbours of a node hang on the smallest of them
        low = stars.groupBy("node").agg(F.min("root").alias("low"))
        small = stars.join(low, "node").where("root <> low").select(F.col("root").alias("node"), F.col("low").alias("root")).unionByName(low.select("node", F.col("low").alias("root"))).distinct()
        # large star: the larger neighbours of a node hang on the smallest around it
        both = small.unionByName(small.select(F.col("root").alias("node"), F.col("node").alias("root")))
        low = both.groupBy("node").agg(F.least(F.col("node"), F.min("root")).alias("low"))
        large = both.where("root > node").join(low, "node").select(F.col("root").alias("node"), F.col("low").alias("root")).distinct()
        before, stars = stars, save(_contracted(large, tasks), "stars")
        discard_saved(before)
