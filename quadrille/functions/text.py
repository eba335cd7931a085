"""Text forms of points and neighbour lists, with eight decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import axes

NUMBER = "%9.8f"


def format_point(id_col: Column, *coords: Column) -> Column:
    """id, x, y[, z], parted by tabs."""
    return F.format_string("%d" + f"\t{NUMBER}" * len(coords), id_col.cast("long"), *coords)


def format_coords(*coords: Column) -> Column:
    return F.format_string("\t".join([NUMBER] * len(coords)), *coords)


def format_points(points: DataFrame, id_col: str, dims: int) -> DataFrame:
    """(id, line)"""
    return points.select(F.col(id_col), format_point(F.col(id_col), *(F.col(a) for a in axes(dims))).alias("line"))


def format_neighbors(neighbors: DataFrame, k: int, order: str = "min") -> DataFrame:
    """(qid, line): tid and distance of at most k neighbours, each followed by a tab; ``min`` nearest first, ``max`` farthest first."""
    if order not in ("min", "max"):
        raise ValueError("order must be min or max")
    listed = neighbors.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("dist", "tid"))).alias("l"))
    chosen = F.slice("l", 1, k) if order == "min" else F.slice(F.reverse("l"), 1, k)
    return listed.select("qid", F.array_join(F.transform(chosen, lambda s: F.format_string(f"%d\t{NUMBER}\t", s["tid"].cast("long"), s["dist"])), "").alias("line"))
