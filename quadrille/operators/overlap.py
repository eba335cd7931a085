"""Which cells a ball around a query touches, found by equi-joins.

Cells are kept with all their ancestor blocks: for a grid, indices halved level by level; for a tree, address prefixes.
A ball is looked up at the level where blocks are at least as wide as the ball, so it touches two blocks an axis at most,
whatever its radius; the exact test of ball against cell follows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import axes, box_max_square, box_min_square
from ..functions.grid import grid_bounds, grid_ijk
from ..functions.tree import tree_bounds
from .partition import BROADCAST_ROWS, Grid, Tree, hinted, with_leaf

#: Slack for cell borders, as a coordinate may lie an ulp outside the computed bounds of its cell.
SLACK, LEAST = 1e-9, 1e-12


def padded(radius: Column) -> Column:
    return radius * (1 + SLACK) + LEAST


def _blocks_wide() -> Column:
    """Cells along one side of a block of the row's level."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_level"))


def _grid_levels(grid: Grid) -> int:
    return math.ceil(math.log2(grid.n)) if grid.n > 1 else 0


def grid_blocks(cells: DataFrame, grid: Grid) -> DataFrame:
    """cells(cell, ...) once for each level, with the block the cell lies in: columns _level and _x, _y[, _z]."""
    rows = cells.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(_grid_levels(grid)))))
    indices = grid_ijk(F.col("cell"), grid.n, grid.dims)
    return rows.withColumns({f"_{a}": F.call_function("div", i, _blocks_wide()) for a, i in zip(axes(grid.dims), indices, strict=True)})


def tree_blocks(cells: DataFrame) -> DataFrame:
    """cells(cell, ...) once for each prefix of its address: column _block."""
    return cells.withColumn("_block", F.explode(F.transform(F.sequence(F.lit(0), F.length("cell")), lambda k: F.substr("cell", F.lit(1), k))))


def cell_bounds(cell: Column, partitioning: Grid | Tree) -> list[tuple[Column, Column]]:
    if isinstance(partitioning, Grid):
        return grid_bounds(cell, partitioning.n, partitioning.dims)
    return tree_bounds(cell, partitioning.dims)


def with_bounds(rows: DataFrame, cell: str, partitioning: Grid | Tree) -> tuple[DataFrame, list[tuple[Column, Column]], list[str]]:
    """rows with the bounds of their cell as columns, those columns in pairs, and their names.

    A tree address is walked once for each row here, so rows should be the cells and not what is joined to them.
    """
    names = [f"_{a}{n}" for a in axes(partitioning.dims) for n in ("lo", "hi")]
    both = [v for b in cell_bounds(F.col(cell), partitioning) for v in b]
    return rows.withColumns(dict(zip(names, both, strict=True))), [(F.col(lo), F.col(hi)) for lo, hi in zip(names[::2], names[1::2], strict=True)], names


def cells_in_reach(balls: DataFrame, cells: DataFrame, partitioning: Grid | Tree) -> DataFrame:
    """balls(qid, x, y[, z], radius) x cells(cell): one row per ball and cell it touches, with the balls' columns.

    Balls are never broadcast: Spark takes their number from the size of their file, before they were copied to blocks.
    ``near2`` and ``far2`` are the squared distances to the nearest and to the farthest point of the cell.
    """
    names = axes(partitioning.dims)
    point = [F.col(a) for a in names]
    cells, bounds, extra = with_bounds(cells.select("cell").distinct(), "cell", partitioning)
    if isinstance(partitioning, Grid):
        n, top = partitioning.n, _grid_levels(partitioning)
        wide = F.ceil(F.log2(F.greatest(F.col("radius") * 2 * n, F.lit(1.0))))
        at = balls.withColumn("_level", F.least(F.greatest(wide, F.lit(0)), F.lit(top)).cast("int"))
        for a in names:
            side = _blocks_wide().cast("double") / n
            last = F.call_function("div", F.lit(n - 1).cast("long"), _blocks_wide())
            lo = F.floor((F.col(a) - F.col("radius") - LEAST) / side).cast("long")
            hi = F.floor((F.col(a) + F.col("radius") + LEAST) / side).cast("long")
            # a block more on either side would only be needed for an ulp, which the slack in radius covers
            at = at.withColumn(f"_{a}", F.explode(F.sequence(F.least(F.greatest(lo, F.lit(0)), last), F.least(F.greatest(hi, F.lit(0)), last))))
        keys = ["_level", *(f"_{a}" for a in names)]
        few = n**partitioning.dims * (top + 1) <= BROADCAST_ROWS
        met = at.hint("merge").join(grid_blocks(cells, partitioning).hint("broadcast" if few else "merge"), keys).drop(*keys)
    else:
        depth = partitioning.depth
        level = F.least(F.greatest(F.floor(-F.log2(F.greatest(F.col("radius") * 2, F.lit(2.0**-60)))), F.lit(0)), F.lit(depth)).cast("int")
        at = balls.withColumn("_level", level).withColumn("_side", F.pow(F.lit(2.0), -F.col("_level")))
        for a in names:
            lo, hi = (F.least(F.greatest(F.floor((F.col(a) + d) / F.col("_side")), F.lit(0)), F.pow(F.lit(2.0), "_level") - 1).cast("long") for d in (-F.col("radius") - LEAST, F.col("radius") + LEAST))
            at = at.withColumn(f"_{a}", F.explode(F.sequence(lo, hi)))
        # One leaf for each block, by its centre: the block lies in it, or is cut into it and others.
        at = at.withColumns({f"_at{a}": (F.col(f"_{a}") + 0.5) * F.col("_side") for a in names})
        at = with_leaf(at, partitioning, [f"_at{a}" for a in names], "cell")
        below = at.where("length(cell) > _level").withColumn("_block", F.substr("cell", F.lit(1), F.col("_level")))
        gone = ["_level", "_side", *(f"_{a}" for a in names), *(f"_at{a}" for a in names)]
        below = below.drop("cell", *gone).hint("merge").join(tree_blocks(cells).hint("broadcast" if partitioning.few_blocks else "merge"), "_block").drop("_block")
        # Several blocks may lie in one leaf.
        above = at.where("length(cell) <= _level").drop(*gone).dropDuplicates(["qid", "cell"]).hint("merge").join(cells.hint("broadcast" if partitioning.small else "merge"), "cell")
        met = below.unionByName(above)
    met = met.withColumns({"near2": box_min_square(point, bounds), "far2": box_max_square(point, bounds)}).drop(*extra)
    return met.where(F.col("near2") <= padded(F.col("radius")) * padded(F.col("radius")))


def range_query_cells(balls: DataFrame, tree: Tree) -> DataFrame:
    """(qid, cell): all leaves each ball touches, empty ones too. balls: (qid, x, y[, z], radius)."""
    return cells_in_reach(balls, tree.leaves.select(F.col("addr").alias("cell")), tree).select("qid", "cell")


def block_bound(queries: DataFrame, counts: DataFrame, k: int, partitioning: Grid | Tree) -> DataFrame:
    """(qid, bound): the far-corner distance to the smallest block around the query that holds k training points.

    queries: (qid, x, y[, z], cell); counts: (cell, n). Queries for which no block does have no row.
    """
    names = axes(partitioning.dims)
    point = [F.col(a) for a in names]
    if isinstance(partitioning, Grid):
        keys = ["_level", *(f"_{a}" for a in names)]
        full = grid_blocks(counts, partitioning).groupBy(*keys).agg(F.sum("n").alias("n")).where(F.col("n") >= k).drop("n")
        met = grid_blocks(queries.select("qid", *names, "cell"), partitioning).join(full, keys)
        side = _blocks_wide().cast("double") / partitioning.n
        bounds = [(F.col(f"_{a}") * side, (F.col(f"_{a}") + 1) * side) for a in names]
    else:
        full = tree_blocks(counts).groupBy("_block").agg(F.sum("n").alias("n")).where(F.col("n") >= k).drop("n")
        full, bounds, _ = with_bounds(full, "_block", partitioning)
        met = tree_blocks(queries.select("qid", *names, "cell")).join(full, "_block")
    return met.select("qid", F.sqrt(box_max_square(point, bounds)).alias("bound")).groupBy("qid").agg(F.min("bound").alias("bound"))


def search_radius(queries: DataFrame, local: DataFrame, weights: DataFrame, k: int, partitioning: Grid | Tree, need: int | None = None) -> DataFrame:
    """queries with ``radius``, a proven bound of the k-th distance: that of the local list if it is full, else ``block_bound``; ``starved`` tells which.

    weights: (cell, n), at most the number of distinct training points; ``need`` of them must be in a block, k by default.
    Null where there are fewer at all.
    """
    full = local.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.max("dist")).alias("radius"))
    known = queries.join(full, "qid", "left").withColumn("starved", F.col("radius").isNull())
    starved = known.where("starved").drop("radius")
    bound = block_bound(starved, weights, need or k, partitioning).withColumnRenamed("bound", "radius")
    return known.where("not starved").unionByName(starved.join(bound, "qid", "left").select(*known.columns))


def overlap_cells(queries: DataFrame, cells: DataFrame, local: DataFrame, k: int, partitioning: Grid | Tree, weights: DataFrame | None = None, need: int | None = None) -> DataFrame:
    """queries' columns, radius, starved, cell, near2 and far2: non-empty cells other than its own that may hold one of a query's k nearest.

    queries have their cell; cells: (cell, n) of non-empty cells; local is what ``local_knn`` gave for them.
    """
    known = search_radius(queries, local, cells if weights is None else weights, k, partitioning, need)
    known, extra = known.where("radius is not null").withColumnRenamed("cell", "_own"), []
    point = [F.col(a) for a in axes(partitioning.dims)]
    if isinstance(partitioning, Grid):
        bounds = cell_bounds(F.col("_own"), partitioning)
    else:  # addresses are walked once a leaf
        leaves, bounds, extra = with_bounds(partitioning.leaves.select(F.col("addr").alias("_own")), "_own", partitioning)
        known = known.join(hinted(leaves, partitioning.small), "_own")
    room = F.least(*(g for p, (lo, hi) in zip(point, bounds, strict=True) for g in (p - lo, hi - p)))
    reaching = known.where(padded(F.col("radius")) > room).drop(*extra)
    return cells_in_reach(reaching, cells, partitioning).where("cell <> _own").drop("_own")


def seed_cells(overlaps: DataFrame, weights: DataFrame, need: int) -> DataFrame:
    """Of a starved query's overlapped cells those that come first by farthest corner and hold ``need`` points together.

    Their points give a radius much below the bound that a whole block gives. overlaps: as ``overlap_cells`` has them;
    weights: (cell, n), as in ``search_radius``.
    """
    order = Window.partitionBy("qid").orderBy("far2", "cell").rowsBetween(Window.unboundedPreceding, -1)
    weighed = overlaps.where("starved").join(weights, "cell")
    return weighed.withColumn("_before", F.coalesce(F.sum("n").over(order), F.lit(0))).where(F.col("_before") < need).drop("_before", "n")


def tightened(overlaps: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """overlaps without the cells that lie beyond the k-th distance of the lists found(qid, ..., dist) so far, where these are full."""
    full = found.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.max("dist")).alias("_found"))
    rows = overlaps.join(full, "qid", "left").withColumn("radius", F.least("radius", "_found")).drop("_found")
    return rows.where(F.col("near2") <= padded(F.col("radius")) * padded(F.col("radius")))
