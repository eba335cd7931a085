"""As-of lookup over ranges of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged


def asof_rows(rows: DataFrame, starts: DataFrame, on: str, value: str, by: list[str] | None = None) -> DataFrame:
    """rows with the ``value`` of that row of starts(*by, on, value) which has the largest ``on`` not above their own, of equal ones the largest value; null if there is none.

    The union of both is dealt into ranges of (by, on), so that a key with most of the rows has several tasks; the
    last value of a key that goes on in the next range is carried there. Such keys are no more than the ranges.
    """
    by, others = by or [], [c for c in rows.columns if c not in (*(by or []), on)]
    kind = starts.schema[value].dataType
    t = starts.select(*by, on, F.lit(0).alias("_side"), F.col(value).alias("_value"), F.lit(0).cast("long").alias("_tie"), F.lit(None).cast(rows.select(F.struct(*others)).schema[0].dataType).alias("_row"))
    q = rows.select(*by, on, F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_value"), F.xxhash64(*others).alias("_tie"), F.struct(*others).alias("_row"))
    every = t.unionByName(q, allowMissingColumns=False).repartitionByRange(*by, on, "_side", "_value", "_tie")
    every = staged(every.withColumn("_part", F.spark_partition_id()), "ranges")
    order = Window.partitionBy("_part", *by).orderBy(on, "_side", "_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = every.withColumn("_value", F.last("_value", ignorenulls=True).over(order))
    last = F.max(F.when(F.col("_side") == 0, F.struct(on, "_value")))["_value"]
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    if by:
        edges = every.groupBy("_part").agg(F.min(F.struct(*by)).alias("low"), F.max(F.struct(*by)).alias("high"))
        # A key that ends one range and begins another; a key alone in its range does both there.
        crossing = edges.select(F.col("high").alias("key"), F.col("_part").alias("to")).join(edges.select(F.col("low").alias("key"), F.col("_part").alias("at")), "key")
        crossing = F.broadcast(crossing.where("at > to").select("key.*").distinct())
        lasts = every.join(crossing, by).groupBy("_part", *by).agg(last.alias("_last"))
    else:
        lasts = every.groupBy("_part").agg(last.alias("_last"))
    carried = lasts.select("_part", *by, F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    told = told.where("_side = 1").drop("_side", "_tie").join(F.broadcast(carried), ["_part", *by], "left")
    return told.select(*by, on, "_row.*", F.coalesce("_value", "_carried").alias(value))
