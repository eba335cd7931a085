"""A grid chosen by what its join is expected to cost."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import axes
from ..functions.grid import grid_index
from ..operators.partition import Grid

#: Cells along a side of the grid on which both sides are counted.
COARSE = {2: 256, 3: 32}
#: What a cell that a query's ball touches costs, in pairs of points.
CELL_COST = 64.0
#: What a cell costs that is swept as a group of its own, likewise.
GROUP_COST = 2e5
#: Training points a cell, about, where cells are searched as arrays.
SEARCHED_ROWS = 1 << 14
MAX_N = {2: 1 << 20, 3: 1 << 13}


def coarse_counts(queries: DataFrame, training: DataFrame, dims: int = 2, n: int | None = None) -> DataFrame:
    """(x, y[, z], nq, nt): queries and training points by the indices of a grid; combined map-side."""
    names, n = axes(dims), n or COARSE[dims]
    side = lambda df, q, t: df.select(*(grid_index(F.col(a), n).alias(a) for a in names), F.lit(q).alias("nq"), F.lit(t).alias("nt"))
    both = side(queries, 1, 0).unionByName(side(training, 0, 1))
    return both.groupBy(*names).agg(F.sum("nq").alias("nq"), F.sum("nt").alias("nt"))


def candidates(rows: int, k: int, dims: int, group_cost: float = 0.0) -> list[int]:
    """Cells along a side that are weighed: steps that double the number of cells, around a few times k points a cell, or fewer cells where each costs."""
    middle = int(math.log2(max(1.0, rows / (4 * k))))
    lowest = 0 if group_cost else max(0, middle - 6)
    return sorted({min(MAX_N[dims], max(1, round(2 ** (c / dims)))) for c in range(lowest, middle + 9)})


def grid_costs(coarse: DataFrame, sizes: list[int], k: int, dims: int = 2) -> DataFrame:
    """(n, cells, pairs, cost) for each n of sizes: cells with queries, pairs of a query and a training point in one cell, and the join's expected cost.

    Coarse cells are put together for smaller n and taken as evenly filled for larger ones. With m points a cell a
    query's ball of k points reaches into about (1 + 2 (k / (b m))^(1/d))^d cells, b being the volume of the unit ball;
    each costs m pairs and ``CELL_COST``.
    """
    names, fine = axes(dims), COARSE[dims]
    rows = coarse.withColumn("n", F.explode(F.array(*(F.lit(n) for n in sizes))))
    rows = rows.withColumns({a: F.when(F.col("n") < fine, F.floor(F.col(a) * F.col("n") / fine)).otherwise(F.col(a)) for a in names})
    cells = rows.groupBy("n", *names).agg(F.sum("nq").alias("nq"), F.sum("nt").alias("nt")).where("nq > 0")
    apart = F.pow(F.greatest(F.col("n") / fine, F.lit(1.0)), F.lit(dims))
    m = F.col("nt") / apart
    held = F.greatest(m, F.lit(0.25))
    ball = math.pi if dims == 2 else 4 * math.pi / 3
    met = F.pow(1 + 2 * F.pow(F.lit(k / ball) / held, F.lit(1.0 / dims)), F.lit(dims))
    return cells.groupBy("n").agg(F.sum(apart).alias("cells"), F.sum(F.col("nq") * m).alias("pairs"), F.sum(F.col("nq") * met * (held + CELL_COST)).alias("cost"))


def choose_grid(queries: DataFrame, training: DataFrame, k: int, dims: int = 2, group_cost: float = 0.0) -> Grid:
    """The grid whose join of the two costs least, from one table of counts; a row for each candidate comes to the driver.

    group_cost: what each cell with queries costs by itself, in pairs of points.
    """
    sizes = candidates(training.count(), k, dims, group_cost)
    costs = grid_costs(coarse_counts(queries, training, dims), sizes, k, dims)
    best = costs.orderBy(F.col("cost") + F.col("cells") * group_cost, "n").limit(1).collect()
    return Grid(best[0].n if best else 1, dims)


def search_grid(training: DataFrame, dims: int = 2) -> Grid:
    """A grid for joins by array searches, which need few cells; those that hold much more than others are dealt to parts."""
    return Grid(max(1, round((training.count() / SEARCHED_ROWS) ** (1 / dims))), dims)
