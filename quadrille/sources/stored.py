"""Training points stored by cell, so that joins read them without a shuffle.

A store is a folder with a folder for each version. In it are the points with their cell, in files bucketed by (cell, part),
the counts of cells, and a tree's leaves. A cell of more than ``ROWS_A_PART`` points has several parts, so that no
task writes or reads all of it; without such cells the files are bucketed by cell alone. ``versions`` names the versions that are complete, a row each, appended last: a store whose writer died keeps its
older version. One writer at a time.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import axes
from ..operators.knn import ROWS_A_PART, dealt, hot_by_counts, sent_if_few
from ..operators.partition import Grid, Tree, cell_counts, with_cell
from ..staging import delete

#: Points in a bucket, about.
BUCKET_ROWS = 1 << 20
_VERSIONS = "version long, dims int, n int, buckets int, keys array<string>, rows long, unique_ids boolean, cell_type string, id_type string"


@dataclass(frozen=True)
class StoredTraining:
    """One version of a store. points: (tid, x, y[, z], cell, part); counts: (cell, n, weight, parts); keys: what files are bucketed by."""

    path: str
    version: int
    partitioning: Grid | Tree
    points: DataFrame
    counts: DataFrame
    keys: list[str]
    unique_ids: bool

    def check(self) -> None:
        """An error if the store has a newer version, or none."""
        now = current_version(self.points.sparkSession, self.path)
        if now != self.version:
            raise ValueError(f"version {self.version} of {self.path} is stale: the store has {now}")

    def deal(self, queries: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
        """queries, once for each part of their cell, the points, and the keys to join them on; points don't move."""
        split = sent_if_few(self.counts.where("parts > 1").select("cell", F.col("parts").alias("_parts")))
        if split is None:
            return queries, self.points, self.keys
        copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))
        return queries.join(split, "cell", "left").withColumn("part", copies).drop("_parts"), self.points, self.keys

    def pairings(self, queries: DataFrame, **limits: int) -> list[tuple[DataFrame, DataFrame, list[str]]]:
        """(queries, points, keys) whose joins together pair each query once with each point of its cell.

        Cells with more pairs than one task should have (limits: as for ``hot_by_counts``) are dealt to parts of queries and points, which moves their points
        only; all others are joined where they lie.
        """
        hot = sent_if_few(hot_by_counts(cell_counts(queries).withColumnRenamed("n", "nq"), self.counts.select("cell", F.col("n").alias("nt")), **limits))
        if hot is None:
            return [self.deal(queries)]
        keys, points = hot.select("cell"), self.points.drop("part")
        cold = self.deal(queries.join(keys, "cell", "left_anti"))
        return [cold, dealt(queries.join(keys, "cell", "left_semi"), points.join(keys, "cell", "left_semi"), hot, dims=self.partitioning.dims)]


def store_training(training: DataFrame, path: str, partitioning: Grid | Tree, unique_ids: bool = True, buckets: int | None = None, part_rows: int = ROWS_A_PART) -> StoredTraining:
    """Write a new version of the store at path, in a folder that driver and executors share, and open it.

    unique_ids: tids don't repeat. Rows without id or all coordinates are an error of the caller's: without coordinates a
    point has no cell and is left out. Older versions stay until ``drop_versions``.
    """
    spark, names = training.sparkSession, axes(partitioning.dims)
    version = (current_version(spark, path) or 0) + 1
    at = f"{path}/version-{version}"
    delete(spark, at)  # what a writer left that died
    rows = with_cell(training.select("tid", *names).dropna(subset=list(names)), partitioning)
    counts = cell_counts(rows)
    if not unique_ids:
        weights = cell_counts(rows.groupBy("tid").agg(F.min("cell").alias("cell"))).withColumnRenamed("n", "weight")
        counts = counts.join(weights, "cell", "left")
    weight = F.col("n") if unique_ids else F.coalesce("weight", F.lit(0))
    counts = counts.select("cell", "n", weight.cast("long").alias("weight"), F.ceil(F.col("n") / part_rows).cast("int").alias("parts"))
    counts.write.parquet(f"{at}/counts")
    counts = spark.read.schema(counts.schema).parquet(f"{at}/counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    buckets = buckets or max(1, -(-total // BUCKET_ROWS))
    split, place = sent_if_few(counts.where("parts > 1").select("cell", "parts")), F.lit(0)
    keys = ["cell"] if split is None else ["cell", "part"]
    if split is not None:
        rows = rows.join(split, "cell", "left")
        place = F.pmod(F.xxhash64("tid", *names), F.coalesce(F.col("parts"), F.lit(1))).cast("int")
    rows = rows.select("tid", *names, "cell", place.alias("part")).repartition(buckets, *keys)
    table = _table(path, version)
    spark.sql(f"drop table if exists {table}")
    rows.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{at}/points").saveAsTable(table)
    if isinstance(partitioning, Tree):
        partitioning.leaves.write.parquet(f"{at}/leaves")
    told = (version, partitioning.dims, partitioning.n if isinstance(partitioning, Grid) else None, buckets, keys, total, unique_ids, rows.schema["cell"].dataType.simpleString(), rows.schema["tid"].dataType.simpleString())
    spark.createDataFrame([told], _VERSIONS).coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return open_training(spark, path, version)


def _versions(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(_VERSIONS).parquet(f"{path}/versions")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def current_version(spark: SparkSession, path: str) -> int | None:
    """The newest complete version of the store at path; None if there is none."""
    told = _versions(spark, path)
    return None if told is None else told.agg(F.max("version")).first()[0]


def _table(path: str, version: int) -> str:
    return f"quadrille_points_{hashlib.sha256(path.encode()).hexdigest()[:16]}_{version}"


def open_training(spark: SparkSession, path: str, version: int | None = None) -> StoredTraining:
    """The newest version of the store at path. version: the one that the caller counts on; another one is refused."""
    now = current_version(spark, path)
    if now is None:
        raise ValueError(f"no training points are stored at {path}")
    if version is not None and version != now:
        raise ValueError(f"version {version} of {path} is stale: the store has {now}")
    told, at = _versions(spark, path).where(F.col("version") == now).first(), f"{path}/version-{now}"
    names, table, keys = axes(told.dims), _table(path, now), ", ".join(told.keys)
    columns = ", ".join([f"tid {told.id_type}", *(f"{a} double" for a in names), f"cell {told.cell_type}", "part int"])
    spark.sql(f"create table if not exists {table} ({columns}) using parquet clustered by ({keys}) sorted by ({keys}) into {told.buckets} buckets location '{at}/points'")
    partitioning = Grid(told.n, told.dims) if told.n else Tree(spark.read.parquet(f"{at}/leaves"), told.dims)
    counts = spark.read.schema(f"cell {told.cell_type}, n long, weight long, parts int").parquet(f"{at}/counts")
    return StoredTraining(path, now, partitioning, spark.table(table), counts, list(told.keys), told.unique_ids)


def drop_versions(spark: SparkSession, path: str, before: int) -> None:
    """Delete the files of versions older than ``before``; the newest stays. Joins that read them must have ended."""
    now = current_version(spark, path)
    for k in range(1, min(before, now or 1)):
        spark.sql(f"drop table if exists {_table(path, k)}")
        delete(spark, f"{path}/version-{k}")
