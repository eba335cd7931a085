"""Sharding over fixed virtual slots, law ``bytes``: shard sizes as equal as whole slots allow.

Every record is hashed into one of ``n_slots`` slots, for good. Rows and bytes are summed per slot (map-side combined;
``n_slots`` rows come to the driver, however large the input), and a versioned map gives each slot a shard. The map is
stored as a table; changing the shard count or levelling grown slots edits it, moving as few slots as it can.

Defined results: the record hash covers id, text and a number that tells rows equal in both apart, so one id, or one row
repeated, with a third of all rows is spread. Such rows are numbered from 1 through the whole table, so that how many of them a slot
gets depends on the rows alone, not on files or tasks, and ``assign`` places them by the same rule as the count. Null ids and texts hash like any other value; a null text has no bytes. An empty table gives a map with
empty slots and an empty result. Ties go to the lowest shard and slot. Other columns pass through ``assign`` untouched, but for ``shard``.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, staged, staging_root

N_SLOTS = 8192
ROW_OVERHEAD = 8
#: Parts that equal rows are dealt to while they are numbered.
SALTS = 64


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_OVERHEAD


def slot_of(id_col: Column, text_crc: Column, repeat: Column, n_slots: int) -> Column:
    return F.pmod(F.xxhash64(id_col, text_crc, repeat), F.lit(n_slots)).cast("int")


@dataclass
class SlotMap:
    """Slot to shard, with each slot's rows and bytes as last counted; lists are indexed by slot."""

    version: int
    n_shards: int
    shard: list[int]
    rows: list[int]
    size: list[int]
    moved: int = 0
    load: list[int] = field(init=False)

    def __post_init__(self):
        self.load = [0] * self.n_shards
        for slot, s in enumerate(self.shard):
            self.load[s] += self.size[slot]

    @classmethod
    def fresh(cls, rows: list[int], size: list[int], n_shards: int) -> SlotMap:
        """Version 1: the largest slot goes to the emptiest shard, again and again."""
        load, shard = [0] * n_shards, [0] * len(size)
        for slot in sorted(range(len(size)), key=lambda k: (-size[k], k)):
            s = min(range(n_shards), key=lambda k: (load[k], k))
            shard[slot], load[s] = s, load[s] + size[slot]
        return cls(1, n_shards, shard, rows, size)

    def edited(self, n_shards: int | None = None, rows: list[int] | None = None, size: list[int] | None = None, tolerance: float = 0.01) -> SlotMap:
        """The next version, for another shard count or newly counted slots.

        Slots leave shards that are above the mean, largest first while they fit the gap, for the emptiest shard.
        When shards are only added and levelled before, rows move into the new ones alone.
        """
        n, size = n_shards or self.n_shards, size or self.size
        shard, moved = list(self.shard), 0
        held: list[list[int]] = [[] for _ in range(n)]
        orphans = []
        for slot, s in enumerate(shard):
            (held[s] if s < n else orphans).append(slot)
        load = [sum(size[k] for k in x) for x in held]
        goal = sum(size) / n

        def put(slot: int, to: int) -> None:
            nonlocal moved
            moved += shard[slot] != to
            shard[slot], load[to] = to, load[to] + size[slot]
            held[to].append(slot)

        for slot in sorted(orphans, key=lambda k: (-size[k], k)):
            put(slot, min(range(n), key=lambda k: (load[k], k)))
        for _ in range(len(shard)):
            most, least = max(range(n), key=lambda k: (load[k], -k)), min(range(n), key=lambda k: (load[k], k))
            gap = min(load[most] - goal, goal - load[least])
            if load[most] <= goal * (1 + tolerance) and load[least] >= goal * (1 - tolerance):
                break
            fits = [k for k in held[most] if 0 < size[k] <= max(gap, 0) * 1.0 + 1] or [k for k in held[most] if 0 < size[k] < load[most] - load[least]]
            if not fits:
                break
            slot = max(fits, key=lambda k: (size[k], -k))
            held[most].remove(slot)
            load[most] -= size[slot]
            put(slot, least)
        return SlotMap(self.version + 1, n, shard, rows or self.rows, size, moved)

    def table(self, spark: SparkSession) -> DataFrame:
        """(version, n_shards, vslot, shard, rows, bytes, base): base is the number of rows of earlier slots of the same shard."""
        base, seen = [], [0] * self.n_shards
        for slot, s in enumerate(self.shard):
            base.append(seen[s])
            seen[s] += self.rows[slot]
        data = [(self.version, self.n_shards, k, s, self.rows[k], self.size[k], base[k]) for k, s in enumerate(self.shard)]
        return spark.createDataFrame(data, "version int, n_shards int, vslot int, shard int, rows long, bytes long, base long")

    def save(self, spark: SparkSession, path: str) -> None:
        self.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/version={self.version}")

    @classmethod
    def load_from(cls, spark: SparkSession, path: str, version: int) -> SlotMap:
        rows = spark.read.parquet(f"{path}/version={version}").orderBy("vslot").collect()
        return cls(version, rows[0].n_shards, [r.shard for r in rows], [r.rows for r in rows], [r.bytes for r in rows])


def count_slots(rows: DataFrame, n_slots: int) -> tuple[list[int], list[int]]:
    """Rows and bytes of each slot; n_slots numbers each come to the driver."""
    n, size = [0] * n_slots, [0] * n_slots
    for r in rows.groupBy("vslot").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).collect():
        n[r.vslot], size[r.vslot] = r.n, r["size"]
    return n, size


def numbered(rows: DataFrame, alike: list[str], out: str) -> DataFrame:
    """rows with a number from 1 in column out, without gaps among rows that are equal in the columns alike, nulls included.

    Rows that have no equal stay where they are. Of the others each group is dealt to ``SALTS`` parts, numbered there and
    lifted by the counts of earlier parts, so that a group with most of the rows is many.
    """
    part, place = free_name(rows, "part"), free_name(rows, "place")
    names = {c: f"__as_{k}" for k, c in enumerate(alike)}

    def same(left: DataFrame, right: DataFrame, how: str, also: list[str] | None = None) -> DataFrame:
        on = [left[c].eqNullSafe(right[n]) for c, n in names.items()] + [left[c] == right[f"__{c}"] for c in also or []]
        return left.join(right, functools.reduce(lambda x, y: x & y, on), how)

    renamed = [F.col(c).alias(n) for c, n in names.items()]
    again = staged(rows.groupBy(*renamed).count().where("count > 1").drop("count"), "repeats")
    alone = same(rows, again, "left_anti").withColumn(out, F.lit(1).cast("long"))
    many = same(rows, again, "left_semi").withColumn(part, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    many = staged(many, "repeated-rows")
    earlier = Window.partitionBy(*names.values()).orderBy(f"__{part}").rowsBetween(Window.unboundedPreceding, -1)
    counts = many.groupBy(*renamed, F.col(part).alias(f"__{part}")).count()
    before = counts.withColumn("__before", F.coalesce(F.sum("count").over(earlier), F.lit(0))).drop("count")
    within = Window.partitionBy(*alike, part).orderBy(F.lit(0))
    many = same(many.withColumn(place, F.row_number().over(within)), before, "inner", [part])
    return alone.unionByName(many.withColumn(out, F.col(place) + F.col("__before")).select(*alone.columns))


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """(id, size, text_crc32, vslot) of each record."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias(id_col), size_of(F.col(text_col)).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = numbered(rows, [id_col, "text_crc32", "size"], "__repeat")
    return rows.withColumn("vslot", slot_of(F.col(id_col), F.col("text_crc32"), F.col("__repeat"), n_slots)).drop("__repeat")


def shard_documents(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """(id, size, text_crc32, vslot, shard, slot, version): slot is the row's place in its shard, gapless from 0.

    Places are counted within a slot, a small part of a shard, and lifted by the rows of earlier slots.
    """
    spark = docs.sparkSession
    rows = staged(records(docs, id_col, text_col, n_slots), "records")
    slots = SlotMap.fresh(*count_slots(rows, n_slots), n_shards)
    slots.save(spark, map_path or f"{staging_root(spark)}/slot_map")
    within = Window.partitionBy("vslot").orderBy(F.col(id_col), "text_crc32", "size")
    placed = rows.withColumn("place", F.row_number().over(within) - 1).join(F.broadcast(slots.table(spark).drop("rows", "bytes", "n_shards")), "vslot")
    return placed.select(id_col, "size", "text_crc32", "vslot", "shard", (F.col("base") + F.col("place")).alias("slot"), "version")


def assign(docs: DataFrame, slots: SlotMap, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with a ``shard`` column from a stored map, which replaces one of that name; only rows that have equals are shuffled."""
    docs = docs.drop("shard")
    slot, crc, size, repeat = (free_name(docs, x) for x in ("vslot", "crc", "size", "repeat"))
    rows = docs.withColumns({crc: F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")), size: size_of(F.col(text_col))})
    rows = numbered(rows, [id_col, crc, size], repeat)
    table = slots.table(docs.sparkSession).select(F.col("vslot").alias(slot), "shard")
    rows = rows.withColumn(slot, slot_of(F.col(id_col), F.col(crc), F.col(repeat), len(slots.shard)))
    return rows.join(F.broadcast(table), slot).drop(slot, crc, size, repeat)
