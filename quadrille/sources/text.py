"""Delimited text and Parquet forms of the library's tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import axes, in_domain
from ..functions.text import format_neighbors, format_points

COUNTS_SCHEMA = "cell string, n long"


def _parsed(spark: SparkSession, path: str, sep: str, dims: int, id_col: str) -> DataFrame:
    part = F.split(F.trim("value"), re.escape(sep))
    number = lambda k: F.try_element_at(part, F.lit(k + 2)).try_cast("double")
    rows = spark.read.text(path).select(
        F.col("value").alias("line"), F.size(part).alias("fields"), F.try_element_at(part, F.lit(1)).try_cast("long").alias(id_col),
        *(number(k).alias(a) for k, a in enumerate(axes(dims))),
    )
    good = F.col("fields") == dims + 1
    for c in (id_col, *axes(dims)):
        good = good & F.col(c).isNotNull()
    return rows.withColumn("good", good)


def read_points(spark: SparkSession, path: str, sep: str = "\t", dims: int = 2, id_col: str = "tid", on_bad: str = "fail") -> DataFrame:
    """Points from lines of id, x, y[, z]. A line of another shape fails the read, or with ``quarantine`` is left out (see ``bad_lines``)."""
    if on_bad not in ("fail", "quarantine"):
        raise ValueError("on_bad must be fail or quarantine")
    rows = _parsed(spark, path, sep, dims, id_col)
    if on_bad == "fail":
        checked = F.when(F.col("good"), F.col(id_col)).otherwise(F.raise_error(F.concat(F.lit("not a point: "), "line")))
        return rows.select(checked.cast("long").alias(id_col), *axes(dims))
    return rows.where("good").select(id_col, *axes(dims))


def bad_lines(spark: SparkSession, path: str, sep: str = "\t", dims: int = 2) -> DataFrame:
    """(line): what ``read_points`` leaves out with ``quarantine``."""
    return _parsed(spark, path, sep, dims, "tid").where(~F.col("good")).select("line")


def read_cell_counts(spark: SparkSession, path: str) -> DataFrame:
    """(cell, n) from tab-separated files; cells stay strings, as tree addresses start with zeros."""
    return spark.read.schema(COUNTS_SCHEMA).csv(path, sep="\t")


def write_cell_counts(counts: DataFrame, path: str, mode: str = "error") -> None:
    counts.select("cell", "n").write.mode(mode).csv(path, sep="\t")


def write_points(points: DataFrame, path: str, id_col: str, dims: int, mode: str = "error") -> None:
    format_points(points, id_col, dims).select("line").write.mode(mode).text(path)


def write_neighbors(neighbors: DataFrame, path: str, k: int, order: str = "min", mode: str = "error") -> None:
    format_neighbors(neighbors, k, order).select("line").write.mode(mode).text(path)


def save_tree(leaves: DataFrame, path: str, mode: str = "error") -> None:
    leaves.write.mode(mode).parquet(path)


def load_tree(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def normalise_points(points: DataFrame, dims: int) -> DataFrame:
    """Coordinates brought into [0, 1) by one min-max scale for all axes, so that distances keep their order."""
    bounds = points.agg(*(f(a).alias(f"{n}{a}") for a in axes(dims) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    lows = {a: bounds[f"lo{a}"] for a in axes(dims)}
    spans = [bounds[f"hi{a}"] - lows[a] for a in axes(dims) if lows[a] is not None]
    scale = (max(spans, default=0.0) or 1.0) * (1 + 2.0**-40)
    return points.withColumns({a: (F.col(a) - F.lit(lows[a])) / F.lit(scale) for a in axes(dims)})


def split_domain(points: DataFrame, dims: int) -> tuple[DataFrame, DataFrame]:
    """Points inside [0, 1) and the others."""
    return points.where(in_domain(dims)), points.where(~in_domain(dims))
