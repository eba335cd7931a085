"""Cells for points: a grid by arithmetic, a tree by its table of leaves."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import axes
from ..functions.grid import grid_cell
from ..functions.tree import first_code, morton_code, tree_bounds
from ..staging import staged
from .asof import asof_rows

#: Tables of more rows than this are not broadcast by hint; Spark then joins them by size.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Grid:
    n: int
    dims: int = 2

    def __post_init__(self):
        if self.n < 1 or self.n**self.dims >= 1 << 62:
            raise ValueError("n is out of range")
        axes(self.dims)


@dataclass(frozen=True)
class Tree:
    """leaves: (addr, level) at least, as ``build_tree`` makes them."""

    leaves: DataFrame
    dims: int = 2

    @functools.cached_property
    def depth(self) -> int:
        """The level of the deepest leaf."""
        return self.leaves.agg(F.max("level")).first()[0] or 0

    @functools.cached_property
    def small(self) -> bool:
        return self.leaves.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS

    @functools.cached_property
    def few_blocks(self) -> bool:
        """Whether the leaves, once for each level above them, may be broadcast."""
        most = BROADCAST_ROWS // (self.depth + 1)
        return self.leaves.limit(most + 1).count() <= most

    @functools.cached_property
    def starts(self) -> DataFrame:
        """(start, addr): where each leaf's interval of Morton codes begins."""
        return self.leaves.select(first_code(F.col("addr"), self.dims, self.depth).alias("start"), "addr")

    @functools.cached_property
    def sent(self):
        """``starts`` of a small tree in their order, as a broadcast of two arrays."""
        held = self.starts.toArrow().sort_by("start").combine_chunks()
        codes, addresses = held.column("start").to_numpy(), pa.concat_arrays(held.column("addr").chunks)
        return self.leaves.sparkSession.sparkContext.broadcast((codes, addresses))


def hinted(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def assign_leaves(points: DataFrame, tree: Tree, cell: str = "cell") -> DataFrame:
    """points with the address of their leaf, the one whose interval of Morton codes begins last before theirs; one row stays one.

    The starts of a tree of a checked size are sent to the tasks, which search them for batches of codes. Those of a larger
    one meet the points in ranges of codes. Points without all coordinates have no leaf and are left out.
    """
    return with_leaf(points, tree, list(axes(tree.dims)), cell)


def with_leaf(rows: DataFrame, tree: Tree, coords: list[str], cell: str) -> DataFrame:
    """``assign_leaves`` by the named coordinates."""
    code, rows = morton_code(*(F.col(c) for c in coords), depth=tree.depth), rows.dropna(subset=coords)
    if not tree.small:
        starts = tree.starts.select(F.col("start").alias("_code"), F.col("addr").alias(cell))
        return asof_rows(rows.drop(cell).withColumn("_code", code), starts, "_code", cell).drop("_code")
    sent = tree.sent

    @F.arrow_udf("string")
    def leaf(codes: pa.Array) -> pa.Array:
        starts, addresses = sent.value
        return addresses.take(pa.array(np.searchsorted(starts, codes.to_numpy(zero_copy_only=False), side="right") - 1))

    return rows.withColumn(cell, leaf(code))


def with_cell(points: DataFrame, partitioning: Grid | Tree, cell: str = "cell") -> DataFrame:
    if isinstance(partitioning, Grid):
        return points.withColumn(cell, grid_cell(*(F.col(a) for a in axes(partitioning.dims)), n=partitioning.n))
    return assign_leaves(points, partitioning, cell)


def cell_counts(celled: DataFrame, cell: str = "cell") -> DataFrame:
    """(cell, n): points of each cell that has some; combined map-side."""
    return celled.groupBy(cell).agg(F.count(F.lit(1)).alias("n"))


def training_in_query_cells(training: DataFrame, queries: DataFrame, cell: str = "cell") -> DataFrame:
    """Training rows of cells that hold queries."""
    return training.join(queries.select(cell).distinct(), cell, "left_semi")


def overlap_point_counts(overlaps: DataFrame, counts: DataFrame) -> DataFrame:
    """(qid, cells, points): cells each query overlaps and the training points in them."""
    return overlaps.join(counts, "cell").groupBy("qid").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("points"))


def sample_points(points: DataFrame, rate: int, id_col: str = "tid", method: str = "hash", seed: int | None = None) -> DataFrame:
    """About ``rate`` percent of the rows: by a random draw, or by a hash of the id that always gives the same rows."""
    if not 0 <= rate <= 100:
        raise ValueError("rate is a percentage")
    if method == "bernoulli":
        return points.sample(fraction=rate / 100, seed=seed)
    if method == "hash":
        return points.where(F.pmod(F.col(id_col) * 7919, F.lit(100)) < rate)
    raise ValueError("method must be hash or bernoulli")


def sort_points(points: DataFrame, axis: str, order: str = "min", id_col: str = "tid") -> DataFrame:
    if axis not in ("x", "y", "z") or order not in ("min", "max"):
        raise ValueError("axis is x, y or z, and order min or max")
    return points.orderBy(F.col(axis).asc() if order == "min" else F.col(axis).desc(), id_col)


def with_place(rows: DataFrame, *order: str | Column, place: str = "place") -> DataFrame:
    """rows with their place in the whole order, from 0; equal ones in any order.

    Rows are dealt into ranges, numbered there, and lifted by the counts of earlier ranges: no task holds them all.
    """
    ranged = staged(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    before = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn(place, within).join(F.broadcast(before), "_part").withColumn(place, F.col(place) + F.col("_before")).drop("_part", "_before")


def leaf_bounds(leaves: DataFrame, dims: int) -> DataFrame:
    """leaves with xmin, xmax, ymin, ..."""
    bounds = tree_bounds(F.col("addr"), dims)
    return leaves.withColumns({f"{a}{n}": v for a, b in zip(axes(dims), bounds, strict=True) for n, v in zip(("min", "max"), b, strict=True)})


def box(dims: int, prefix: str = "") -> list[tuple[Column, Column]]:
    """The bounds columns of ``leaf_bounds``."""
    return [(F.col(f"{prefix}{a}min"), F.col(f"{prefix}{a}max")) for a in axes(dims)]
