"""Quadtrees and octrees from a sample of points, by counting address prefixes; no recursion, nothing on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import axes
from ..functions.tree import DEPTH, tree_address
from ..staging import staged
from .partition import Tree, cell_counts, leaf_bounds, with_cell, with_place

METHODS = ("capacity", "siblings", "avg_width")


def prefix_counts(sample: DataFrame, dims: int, depth: int) -> DataFrame:
    """(addr, n): sampled points under each address of up to ``depth`` digits. Points are counted at full depth before the prefixes are taken."""
    full = sample.select(tree_address(*(F.col(a) for a in axes(dims)), depth=depth).alias("full"))
    counted = full.groupBy("full").agg(F.count(F.lit(1)).alias("n"))
    prefixes = counted.select("n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(depth)), lambda k: F.substr("full", F.lit(1), k))).alias("addr"))
    return prefixes.groupBy("addr").agg(F.sum("n").alias("n"))


def _children(addresses: DataFrame, dims: int) -> DataFrame:
    return addresses.select(F.explode(F.array(*(F.concat("addr", F.lit(str(d))) for d in range(1 << dims)))).alias("addr"))


def _parent(addr: str = "addr"):
    return F.expr(f"substr({addr}, 1, length({addr}) - 1)")


def leaves_of(internal: DataFrame, dims: int) -> DataFrame:
    """(addr, level): children of internal nodes that are not internal; the root alone if none is."""
    root = internal.sparkSession.range(1).select(F.lit("").alias("addr"))
    known = root.unionByName(_children(internal, dims))
    return known.join(internal, "addr", "left_anti").withColumn("level", F.length("addr"))


def internal_nodes(sample: DataFrame, capacity: int, method: str = "capacity", dims: int = 2, depth: int | None = None, wide_depth: int | None = None) -> DataFrame:
    """(addr): nodes that are split.

    ``capacity``: those with more than ``capacity`` sampled points. ``siblings``: also every child of a split node that
    has a split sibling. ``avg_width``: also every node wider than the mean of the distinct leaf widths of the capacity
    tree; those below ``wide_depth`` are not split for that, by default there is none. No node at the depth cap is split,
    so equal points end somewhere.
    """
    if method not in METHODS or capacity < 1:
        raise ValueError(f"method is one of {METHODS}, capacity at least 1")
    depth = DEPTH[dims] if depth is None else depth
    over = prefix_counts(sample, dims, depth).where((F.col("n") > capacity) & (F.length("addr") < depth)).select("addr")
    if method == "siblings":
        parents = over.where("addr <> ''").select(_parent().alias("addr")).distinct()
        return over.unionByName(_children(parents, dims)).distinct()
    if method == "avg_width":
        mean = leaves_of(over, dims).select(F.pow(F.lit(2.0), -F.col("level")).alias("w")).distinct().agg(F.avg("w").alias("mean")).first()["mean"]
        deepest, most = 0, depth if wide_depth is None else min(depth, wide_depth + 1)
        while deepest < most and 2.0**-deepest > mean:
            deepest += 1
        wide = over.sparkSession.range(1).select(F.lit("").alias("addr")).where(F.lit(deepest > 0))
        every = wide
        for _ in range(deepest - 1):
            wide = _children(wide, dims)
            every = every.unionByName(wide)
        return over.unionByName(every).distinct()
    return over


def build_tree(sample: DataFrame, capacity: int, method: str = "capacity", dims: int = 2, depth: int | None = None, wide_depth: int | None = None) -> DataFrame:
    """The leaf table (addr, level, xmin, xmax, ymin, ymax[, zmin, zmax])."""
    return leaf_bounds(leaves_of(internal_nodes(sample, capacity, method, dims, depth, wide_depth), dims), dims)


def split_overfull(points: DataFrame, leaves: DataFrame, limit: int, dims: int = 2, depth: int | None = None) -> DataFrame:
    """The leaf table with every leaf of more than ``limit`` of all points split until none has more, or to the depth cap.

    A tree from a sample is not bound by what it didn't see. Points are counted by leaf, and only those of over-full
    leaves by prefixes of their addresses, all levels in one pass. Equal points stay together in a leaf at the cap.
    """
    depth = DEPTH[dims] if depth is None else depth
    held = with_cell(points.select(*axes(dims)), Tree(leaves, dims))
    over = staged(cell_counts(held).where((F.col("n") > limit) & (F.length("cell") < depth)).select("cell"), "overfull-leaves")
    if over.isEmpty():
        return leaves
    full = held.join(over, "cell").select("cell", tree_address(*(F.col(a) for a in axes(dims)), depth=depth).alias("full"))
    counted = full.groupBy("cell", "full").agg(F.count(F.lit(1)).alias("n"))
    below = F.transform(F.sequence(F.length("cell"), F.lit(depth)), lambda k: F.substr("full", F.lit(1), k))
    prefixes = counted.select("n", F.explode(below).alias("addr")).groupBy("addr").agg(F.sum("n").alias("n"))
    internal = staged(prefixes.where((F.col("n") > limit) & (F.length("addr") < depth)).select("addr"), "split-leaves")
    new = _children(internal, dims).join(internal, "addr", "left_anti").withColumn("level", F.length("addr"))
    stay = leaves.join(over.withColumnRenamed("cell", "addr"), "addr", "left_anti")
    return stay.unionByName(leaf_bounds(new, dims).select(*stay.columns))


def tree_width_stats(leaves: DataFrame) -> DataFrame:
    """(widths, mean_width): number and mean of the distinct leaf widths."""
    widths = leaves.select(F.pow(F.lit(2.0), -F.col("level")).alias("w")).distinct()
    return widths.agg(F.count(F.lit(1)).alias("widths"), F.avg("w").alias("mean_width"))


def tree_stats(leaves: DataFrame) -> DataFrame:
    return leaves.agg(F.count(F.lit(1)).alias("n_leaves"), F.max("level").alias("depth"))


def _nodes(leaves: DataFrame) -> DataFrame:
    """(addr, bit): every node of the tree, 1 for a split one."""
    above = leaves.where("level > 0").select(F.explode(F.transform(F.sequence(F.lit(0), F.col("level") - 1), lambda k: F.substr("addr", F.lit(1), k))).alias("addr")).distinct()
    return leaves.select("addr", F.lit("0").alias("bit")).unionByName(above.select("addr", F.lit("1").alias("bit")))


def tree_bitstring(leaves: DataFrame) -> DataFrame:
    """(bits): 1 for a split node and 0 for a leaf, in pre-order, which is the order of addresses; one value, for trees that fit one."""
    return _nodes(leaves).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("addr", "bit"))), lambda s: s["bit"]), "").alias("bits"))


def tree_bit_chunks(leaves: DataFrame, size: int = 1 << 16) -> DataFrame:
    """(chunk, bits): ``tree_bitstring`` in chunks of ``size`` bits, from 0; no task holds the whole tree."""
    placed = with_place(_nodes(leaves), "addr").withColumn("chunk", F.call_function("div", F.col("place"), F.lit(size)))
    return placed.groupBy("chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "bit"))), lambda s: s["bit"]), "").alias("bits"))
