"""Connected components of links, as Spark jobs: alternating large-star and small-star steps on min labels.

Each step is one aggregation (combined map-side) and one join whose skewed side Spark may split, so a hub with most of
the links does not meet in one task. Links and labels stay on the executors; every step's links are a stored table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, unstage


def local_forest(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Labels of n nodes, each the smallest index reachable by links i-j; label: labels so far."""
    label = np.arange(n) if label is None else label
    while True:
        low = np.minimum(label[i], label[j])
        if (low == label[i]).all() and (low == label[j]).all():
            return label
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while (up := label[label] != label).any():
            label[up] = label[label[up]]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    kids = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return kids.unionByName(low.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, root) for every node of edges(a, b), root the smallest id of its component.

    Self-links and repeated links do no harm; ends when a round changes nothing, usually after a few.
    """
    edges = staged(edges.where("a <> b").distinct(), "links")

    def state(df: DataFrame) -> tuple:
        h = F.xxhash64("a", "b")
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)))).first())

    seen = state(edges)
    while seen[0]:
        once = staged(_large_star(edges).where("a <> b").distinct(), "large")
        new = staged(_small_star(once).where("a <> b").distinct(), "small")
        for x in (edges, once):
            unstage(x)
        edges, now = new, state(new)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(roots)
