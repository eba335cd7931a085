"""Distances and ball/box tests, in two or three dimensions."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def axes(dims: int) -> tuple[str, ...]:
    if dims not in (2, 3):
        raise ValueError("dims must be 2 or 3")
    return AXES[:dims]


def _sum(terms: Sequence[Column]) -> Column:
    return functools.reduce(lambda a, b: a + b, terms)


def square_distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Squared Euclidean distance of two points given by their coordinates; products, so that the bits are the same everywhere."""
    if len(a) != len(b):
        raise ValueError("points must have the same dimensions")
    return _sum([(p - q) * (p - q) for p, q in zip(a, b, strict=True)])


def distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return F.sqrt(square_distance(a, b))


def x_distance(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def box_min_square(point: Sequence[Column], box: Sequence[tuple[Column, Column]]) -> Column:
    """Squared distance from a point to the nearest point of a box."""
    gaps = [F.greatest(lo - p, F.lit(0.0), p - hi) for p, (lo, hi) in zip(point, box, strict=True)]
    return _sum([g * g for g in gaps])


def box_max_square(point: Sequence[Column], box: Sequence[tuple[Column, Column]]) -> Column:
    """Squared distance from a point to the farthest corner of a box."""
    gaps = [F.greatest(F.abs(p - lo), F.abs(p - hi)) for p, (lo, hi) in zip(point, box, strict=True)]
    return _sum([g * g for g in gaps])


def ball_intersects_box(point: Sequence[Column], radius: Column, box: Sequence[tuple[Column, Column]]) -> Column:
    """Closed test; a ball that only touches counts. Exact in 2D and 3D, for boxes of any shape."""
    return box_min_square(point, box) <= radius * radius


def ball_inside_box(point: Sequence[Column], radius: Column, box: Sequence[tuple[Column, Column]]) -> Column:
    """Whether the whole ball is in the box; touching from inside counts."""
    room = [g for p, (lo, hi) in zip(point, box, strict=True) for g in (p - lo, hi - p)]
    return F.least(*room) >= radius


def in_domain(dims: int, prefix: str = "") -> Column:
    """Whether all coordinates lie in [0, 1); null coordinates don't."""
    inside = [(F.col(f"{prefix}{a}") >= 0) & (F.col(f"{prefix}{a}") < 1) for a in axes(dims)]
    return F.coalesce(functools.reduce(lambda a, b: a & b, inside), F.lit(False))
