"""Hand-worked cases of cells, addresses, bounds and ball tests."""

import pytest
from pyspark.sql import functions as F

from quadrille.functions.geometry import ball_inside_box, ball_intersects_box
from quadrille.functions.grid import grid_bounds, grid_cell, grid_ijk, suggest_n, surrounding_cells
from quadrille.functions.tree import tree_address, tree_bounds
from quadrille.operators.partition import Grid, sort_points
from quadrille.operators.tree_build import build_tree, tree_bitstring


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def lits(*values):
    return [F.lit(float(v)) for v in values]


def test_cells(spark):
    assert one(spark, grid_cell(*lits(0.1, 0.2), n=4), grid_cell(*lits(0.6, 0.3), n=4), grid_cell(*lits(0.6, 0.3, 0.9), n=4)) == [0, 6, 54]
    assert one(spark, *grid_ijk(F.lit(54).cast("long"), 4, 3)) == [2, 1, 3]
    assert one(spark, *(v for b in grid_bounds(F.lit(6).cast("long"), 4, 2) for v in b)) == [0.5, 0.75, 0.25, 0.5]


def test_addresses(spark):
    assert one(spark, tree_address(*lits(0.6, 0.3), depth=2), tree_address(*lits(0.6, 0.3, 0.9), depth=1)) == ["30", "7"]
    assert one(spark, *(v for b in tree_bounds(F.lit("30"), 2) for v in b)) == [0.5, 0.75, 0.25, 0.5]
    assert one(spark, *(v for b in tree_bounds(F.lit(""), 3) for v in b)) == [0.0, 1.0] * 3


@pytest.mark.parametrize(("n", "dims", "cell", "want"), [(4, 2, 0, {1, 4, 5}), (4, 2, 5, {0, 1, 2, 4, 6, 8, 9, 10}), (3, 3, 0, {1, 3, 4, 9, 10, 12, 13})])
def test_surrounding(spark, n, dims, cell, want):
    cells = spark.range(1).select(F.lit(cell).cast("long").alias("cell"))
    assert {r.neighbour for r in surrounding_cells(cells, n, dims).collect()} == want


def test_balls(spark):
    box = lambda lo, hi: [(F.lit(lo), F.lit(hi))] * 2
    assert one(spark, ball_intersects_box(lits(0, 0), F.lit(1.0), box(1.0, 2.0)), ball_intersects_box(lits(0, 0), F.lit(1.0), box(0.5, 1.5)), ball_inside_box(lits(0.5, 0.5), F.lit(0.5), box(0.0, 1.0))) == [False, True, True]


@pytest.mark.parametrize(("points", "want"), [([], "0"), ([(0.1, 0.1)] * 2 + [(0.1, 0.9)], "10000"), ([(0.6, 0.1), (0.9, 0.1), (0.6, 0.4)], "100010000")])
def test_bits(spark, points, want):
    capacity = 2
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "tid long, x double, y double")
    depth = 1 if want == "10000" else 2
    assert tree_bitstring(build_tree(df, capacity, depth=depth)).first().bits == want


def test_bad_arguments(spark):
    df = spark.createDataFrame([], "tid long, x double, y double")
    for call in (lambda: sort_points(df, "w"), lambda: sort_points(df, "x", "up"), lambda: Grid(0), lambda: build_tree(df, 0)):
        with pytest.raises(ValueError, match=r"."):
            call()
    assert suggest_n(150_000, 37) == 64
