"""What the operators share: staged tables in the cluster's shared folder, row ids, text normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import cleanup, shared_dir, staged, staging_root, unstage

__all__ = ["cleanup", "fold_ascii", "free_name", "read", "shared_dir", "staged", "staging_root", "unstage"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def fold_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not use yet."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name in taken:
        name = f"_{name}"
    return name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
