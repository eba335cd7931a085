"""Cells and per-cell counts of a stream of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.partition import Grid, with_cell


def windowed_cell_counts(points: DataFrame, grid: Grid, time: str, window: str, late: str) -> DataFrame:
    """(window, cell, n) for a streaming or batch DataFrame of points with an event time; rows later than ``late`` are dropped by the watermark."""
    celled = with_cell(points, grid)
    return celled.withWatermark(time, late).groupBy(F.window(time, window), "cell").agg(F.count(F.lit(1)).alias("n"))
