"""Exact dedup with a heavy-hitter split, in DataFrame operations only.

Misra-Gries (``DataFrame.freqItems``) finds the digests that may hold more than a ``support`` share of the rows; it
misses none of those and returns at most about ``1 / support`` digests. Their exact counts and winners are verified
with one aggregation, which combines map-side, and broadcast: rows of frequent digests never travel. All other digests
hold at most that share of the rows each and are resolved by an ordinary shuffle.

Defined results: a null text equals an empty one; null ids rank below all others; of repeated rows with the same id
exactly one is kept; an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fold_ascii, free_name, staged

SUPPORT = 0.001


def text_digest(text: Column) -> Column:
    """Hex SHA-256 of the text's UTF-8 bytes, A-Z lowered."""
    return F.sha2(fold_ascii(text).cast("binary"), 256)


def heavy_winners(rows: DataFrame, digest: str, rank: Column, support: float = SUPPORT) -> DataFrame:
    """(digest, winner, group_size) of the frequent digests: at most about 1 / support rows, counts exact.

    rows is read twice, so it should be a stored table.
    """
    found = rows.select(digest).freqItems([digest], support)
    candidates = found.select(F.explode(found.columns[0]).alias(digest)).distinct()
    return (
        rows.join(F.broadcast(candidates), digest)
        .groupBy(digest)
        .agg(F.max(rank).alias("winner"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
    )


def label_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    rows = staged(
        docs.select(F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("digest")).withColumn("rid", F.monotonically_increasing_id()),
        "digests",
    )
    rank = F.struct("id", "rid")
    heavy = F.broadcast(staged(heavy_winners(rows, "digest", rank, support), "heavy"))
    frequent = rows.join(heavy, "digest")
    group = Window.partitionBy("digest")
    rest = rows.join(heavy, "digest", "left_anti").withColumns(
        {"winner": F.max(rank).over(group), "group_size": F.count(F.lit(1)).over(group)}
    )
    both = frequent.select("id", "rid", "digest", "winner", "group_size").unionByName(
        rest.select("id", "rid", "digest", "winner", "group_size")
    )
    return both.select(
        F.col("id").alias(id_col),
        F.col("winner.id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("winner.rid")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows that stay, with all their columns.

    Losing rows of frequent digests go before the shuffle; the ranking limit that Spark puts before the exchange
    (WindowGroupLimit) drops most other losers map-side too.
    """
    digest, winner, place = (free_name(docs, x) for x in ("digest", "winner", "place"))
    tagged = docs.withColumn(digest, text_digest(F.col(text_col)))
    digests = staged(tagged.select(F.col(digest).alias("digest"), F.col(id_col).alias("id")), "digests")
    heavy = staged(heavy_winners(digests, "digest", F.col("id"), support), "heavy")
    winners = heavy.select(F.col("digest").alias(digest), F.col("winner").alias(winner), F.lit(True).alias(place))
    left = tagged.join(F.broadcast(winners), digest, "left").where(
        F.col(place).isNull() | F.col(id_col).eqNullSafe(F.col(winner))
    )
    order = Window.partitionBy(digest).orderBy(F.col(id_col).desc_nulls_last())
    first = left.drop(winner, place).withColumn(place, F.row_number().over(order)).where(F.col(place) == 1)
    return first.select(*docs.columns)
