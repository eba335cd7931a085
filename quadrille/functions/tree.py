"""Addresses of quadtree and octree cells: a digit a level, bx + 2*(1 - by) + 4*bz, of the halves a point lies in.

In 2D 0 is the north-west quarter, 1 north-east, 2 south-west, 3 south-east; in 3D 4 is added in the upper half.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import axes

DEPTH = {2: 20, 3: 16}


def tree_address(*coords: Column, depth: int) -> Column:
    """The address of the cell of side 2^-depth that a point of the domain lies in."""
    if depth == 0:
        return F.lit("")
    at = [F.floor(v * float(1 << depth)).cast("long") for v in coords]
    bit = lambda i, level: F.shiftright(i, depth - level).bitwiseAND(F.lit(1))
    digits = []
    for level in range(1, depth + 1):
        digit = bit(at[0], level) + 2 * (1 - bit(at[1], level))
        digits.append((digit + 4 * bit(at[2], level) if len(at) == 3 else digit).cast("string"))
    return F.concat(*digits)


def morton_code(*coords: Column, depth: int) -> Column:
    """The address at ``depth`` as a long, two or three bits a digit: codes are in the order of addresses."""
    code, dims = F.lit(0).cast("long"), len(coords)
    at = [F.floor(v * float(1 << depth)).cast("long") for v in coords]
    bit = lambda i, level: F.shiftright(i, depth - level).bitwiseAND(F.lit(1).cast("long"))
    for level in range(1, depth + 1):
        digit = bit(at[0], level) + 2 * (1 - bit(at[1], level))
        code = code + F.shiftleft(digit + 4 * bit(at[2], level) if dims == 3 else digit, dims * (depth - level))
    return code


def first_code(address: Column, dims: int, depth: int) -> Column:
    """The least ``morton_code`` at ``depth`` below an address; the leaves' codes cut the domain's into intervals."""
    return F.coalesce(F.conv(F.rpad(address, depth, "0"), 1 << dims, 10).cast("long"), F.lit(0).cast("long")) if depth else F.lit(0).cast("long")


def tree_bounds(address: Column, dims: int) -> list[tuple[Column, Column]]:
    """(lo, hi) of a tree cell on each axis; the whole domain for the empty address."""
    upper = {"x": ("1", "3", "5", "7"), "y": ("0", "1", "4", "5"), "z": ("4", "5", "6", "7")}
    length = F.length(address)
    digits = F.when(length > 0, F.transform(F.sequence(F.lit(1), F.greatest(length, F.lit(1))), lambda i: F.substr(address, i, F.lit(1)))).otherwise(F.expr("cast(array() as array<string>)"))
    side = F.pow(F.lit(2.0), -length)
    out = []

    def steps_along(a: str) -> Column:
        return F.transform(digits, lambda d, i: F.when(d.isin(*upper[a]), F.pow(F.lit(2.0), -(i + 1))).otherwise(F.lit(0.0)))

    for a in axes(dims):
        steps = steps_along(a)
        lo = F.aggregate(steps, F.lit(0.0), lambda s, v: s + v)
        out.append((lo, lo + side))
    return out
