"""Cells of a uniform grid over the unit square or cube, numbered i + j*n + k*n*n."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import axes


def grid_index(v: Column, n: int) -> Column:
    return F.floor(v / F.lit(1.0 / n)).cast("long")


def grid_cell(*coords: Column, n: int) -> Column:
    """Cell number of a point, a long."""
    cell = grid_index(coords[0], n)
    for k, v in enumerate(coords[1:], 1):
        cell = cell + grid_index(v, n) * F.lit(n**k).cast("long")
    return cell


def grid_ijk(cell: Column, n: int, dims: int) -> list[Column]:
    """Indices i, j[, k] of a cell."""
    return [F.call_function("div", cell, F.lit(n**k).cast("long")) % n for k, _ in enumerate(axes(dims))]


def grid_bounds(cell: Column, n: int, dims: int) -> list[tuple[Column, Column]]:
    """(lo, hi) of a cell on each axis."""
    width = F.lit(1.0 / n)
    return [(i * width, (i + 1) * width) for i in grid_ijk(cell, n, dims)]


def surrounding_cells(cells: DataFrame, n: int, dims: int, rings: int = 1, cell: str = "cell") -> DataFrame:
    """(cell, neighbour): the cells within ``rings`` of each cell, clipped at the domain's edge, itself not included."""
    rows = cells.select(cell).withColumns({f"_{a}": i for a, i in zip(axes(dims), grid_ijk(F.col(cell), n, dims), strict=True)})
    near = F.lit(0).cast("long")
    for k, a in enumerate(axes(dims)):
        rows = rows.withColumn(f"_{a}", F.explode(F.sequence(F.greatest(F.col(f"_{a}") - rings, F.lit(0)), F.least(F.col(f"_{a}") + rings, F.lit(n - 1)))))
        near = near + F.col(f"_{a}") * F.lit(n**k).cast("long")
    return rows.select(cell, near.alias("neighbour")).where(F.col("neighbour") != F.col(cell))


def suggest_n(rows: int, per_cell: int = 64, dims: int = 2) -> int:
    """A power of two near (rows / per_cell)^(1/dims), so that cell borders are exact."""
    return 1 << max(0, round(math.log2(max(1.0, rows / per_cell)) / dims))


def cell_of(indices: Sequence[Column], n: int) -> Column:
    cell = F.lit(0).cast("long")
    for k, i in enumerate(indices):
        cell = cell + i * F.lit(n**k).cast("long")
    return cell
