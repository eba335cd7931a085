"""Point sets made from the test tables; all coordinates are in [0, 1), and the same bits in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def training2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = "cast((o_orderkey * 9973 + o_custkey * 40503) % 65536 as double) / 65536D"
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("tid"), F.expr("o_totalprice / 524288D").alias("x"), F.expr(y).alias("y"))


def queries2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = "cast((c_custkey * 40503) % 65536 as double) / 65536D"
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("qid"), F.expr("(c_acctbal + 1000D) / 16384D").alias("x"), F.expr(y).alias("y"))


def skewed2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = "cast((event_id * 9973 + user_id * 40503) % 65536 as double) / 65536D"
    return _table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("tid"), F.expr("value / 1024D").alias("x"), F.expr(y).alias("y"))


def points3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda k: ((F.col("embedding")[k].cast("double") + 1.0) / 2.0)
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("tid"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


def dup_ids3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(
        F.expr("cast(l_orderkey * 8 + l_linenumber as bigint)").alias("tid"), F.expr("l_extendedprice / 131072D").alias("x"),
        F.expr("(l_quantity - 1D) / 64D").alias("y"), F.expr("cast(l_discount as double)").alias("z"),
    )


def as_queries(points: DataFrame) -> DataFrame:
    return points.withColumnRenamed("tid", "qid")


SQL = {
    "training2d": "select cast(o_orderkey as bigint) as tid, o_totalprice / 524288 as x, cast((o_orderkey * 9973 + o_custkey * 40503) % 65536 as double) / 65536 as y from orders",
    "queries2d": "select cast(c_custkey as bigint) as qid, (c_acctbal + 1000) / 16384 as x, cast((c_custkey * 40503) % 65536 as double) / 65536 as y from customer",
    "skewed2d": "select cast(event_id as bigint) as tid, value / 1024 as x, cast((event_id * 9973 + user_id * 40503) % 65536 as double) / 65536 as y from events",
    "points3d": "select cast(vec_id as bigint) as tid, (cast(embedding[1] as double) + 1) / 2 as x, (cast(embedding[2] as double) + 1) / 2 as y, (cast(embedding[3] as double) + 1) / 2 as z from embeddings",
    "dup_ids3d": "select cast(l_orderkey * 8 + l_linenumber as bigint) as tid, l_extendedprice / 131072 as x, (l_quantity - 1) / 64 as y, cast(l_discount as double) as z from lineitem",
}
