"""Best-fit packing by a grouping genetic algorithm on islands.

Pieces that fill a sequence stand alone. The others are dealt by hash into blocks of about ``BLOCK`` pieces, small enough
for one task. Every block is evolved on several islands, each a group of its own: a packing is a set of sequences, and
the first ones come from best fit by falling size and in random orders. Crossover injects whole, well-filled sequences of one parent into the
other and takes out the sequences that would then hold a piece twice, and the emptiest ones. Displaced pieces first
replace a smaller piece where they fill a sequence better, and are then put back by best fit, the largest first. Between
epochs each island's best packing migrates to the next island by a shuffle; in the end the best one of a block stays.
Evolution ends early at a lower bound on sequences. It is seeded by block and island, so a task that runs again gives the
same result.

The part-filled sequences of all blocks meet again: their pieces are dealt into fewer blocks and evolved anew, until
one block is left or no more than half of the pieces were loose.

Defined results: a null or empty text is its end id alone; null ids, repeated rows and ties are pieces like any other,
told apart by a row number; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import codec, encode_column, slices
from .common import staged

CAPACITY = 2048
BLOCK = 8192
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 8
POPULATION = 6
#: Sequences with more room than this part of the capacity meet those of other blocks.
LOOSE = 16
LEVELS = 64
END_ID = 0


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all are full but the first."""
    first = n % capacity or min(n, capacity)
    starts = [0, *range(first, n, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n], strict=True)]


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(rid, id, piece, start, length, ids_crc32) of every piece; rid tells rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in slices(batch, 2):
                ids, counts = encode_column(c, part.column(2))
                ids, ends = ids.astype("<u4"), np.cumsum(counts)
                row, start, length, crc, number = [], [], [], [], []
                for k, (e, n) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
                    own = np.append(ids[e - n : e], np.uint32(end_id))
                    for p, (at, size) in enumerate(cut(n + 1, capacity)):
                        row.append(k)
                        number.append(p)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(own[at : at + size].tobytes()))
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), part.column(1).take(at), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["rid", "id", "piece", "start", "length", "ids_crc32"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"rid long, id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


class Packing:
    """Bins of pieces, with the bins listed by the room they have left."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.room: list[int] = []
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = 0  # bit r is set if a bin with room r may be listed

    def _list(self, k: int) -> None:
        r = self.room[k]
        if r:
            self.by_room[r].append(k)
            self.open |= 1 << r

    def add(self, items: list[int], room: int) -> None:
        self.bins.append(list(items))
        self.room.append(room)
        self._list(len(self.bins) - 1)

    def put(self, item: int) -> None:
        """Best fit: into the bin with the least room that is enough."""
        size = self.sizes[item]
        fits = self.open >> size
        while fits:
            r = size + (fits & -fits).bit_length() - 1
            held = self.by_room[r]
            k = held.pop()
            if not held:
                self.open &= ~(1 << r)
            self.bins[k].append(item)
            self.room[k] = r - size
            self._list(k)
            return
        self.add([item], self.capacity - size)

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first; then fuller ones, as the sum of squares of what is filled has it."""
        return -len(self.bins), float(np.square(self.capacity - np.array(self.room, dtype=np.float64)).sum())

    def encoded(self) -> np.ndarray:
        where = np.empty(len(self.sizes), dtype=np.int32)
        for k, b in enumerate(self.bins):
            where[b] = k
        return where

    @classmethod
    def decoded(cls, where: np.ndarray, sizes: list[int], capacity: int) -> Packing:
        new = cls(sizes, capacity)
        order = np.argsort(where, kind="stable")
        for items in np.split(order, np.flatnonzero(np.diff(where[order])) + 1) if len(order) else []:
            items = items.tolist()
            new.add(items, capacity - sum(sizes[i] for i in items))
        return new


def best_fit(sizes: list[int], capacity: int, order: np.ndarray) -> Packing:
    new = Packing(sizes, capacity)
    for i in order.tolist():
        new.put(i)
    return new


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Bins that any packing needs: by the sum, and by what large pieces leave for those of at least a size."""
    x = np.sort(np.array(sizes, dtype=np.int64))
    sums, half = np.concatenate([[0], np.cumsum(x)]), int(np.searchsorted(x, capacity // 2, side="right"))
    least = np.unique(x[:half])
    low, high = np.searchsorted(x, least), np.searchsorted(x, capacity - least, side="right")
    room = (high - half) * capacity - (sums[high] - sums[half])
    more = np.maximum(0, -((room - (sums[half] - sums[low])) // capacity))
    return int(max([len(x) - half, -(-int(sums[-1]) // capacity), *(len(x) - half + more)]))


def replace(to: Packing, loose: list[tuple[int, int]]) -> None:
    """In each bin with room, lets a larger loose piece take the place of the one it betters most; loose: sorted (size, piece)."""
    for k, held in enumerate(to.bins):
        room, most = to.room[k], (0, 0, 0)
        for at, i in enumerate(held) if room else ():
            size = to.sizes[i]
            j = bisect_right(loose, (size + room, len(to.sizes))) - 1
            if j >= 0 and loose[j][0] - size > most[0]:
                most = (loose[j][0] - size, at, j)
        gain, at, j = most
        if gain:
            old, held[at] = held[at], loose.pop(j)[1]
            to.room[k] -= gain
            insort(loose, (to.sizes[old], old))


def crossover(to: Packing, giver: Packing, rng: np.random.Generator) -> Packing:
    """Injects some of the giver's fullest bins into a copy of ``to``; ends with no piece twice and none missing."""
    full = np.argsort(giver.room, kind="stable")[: max(1, len(giver.room) * 2 // 3)]
    chosen = full[rng.random(len(full)) < 0.5].tolist() or full[:1].tolist()
    injected = {i for k in chosen for i in giver.bins[k]}
    emptiest = set(np.argsort(to.room, kind="stable")[::-1][: max(1, len(to.room) // 10)].tolist())
    child, loose = Packing(to.sizes, to.capacity), []
    for k, held in enumerate(to.bins):
        if k in emptiest or not injected.isdisjoint(held):
            loose += [(to.sizes[i], i) for i in held if i not in injected]
        else:
            child.bins.append(list(held))
            child.room.append(to.room[k])
    for k in chosen:
        child.bins.append(list(giver.bins[k]))
        child.room.append(giver.room[k])
    loose.sort()
    replace(child, loose)
    for k in range(len(child.bins)):
        child._list(k)
    for _, i in reversed(loose):
        child.put(i)
    return child


def evolve(population: list[Packing], sizes: list[int], capacity: int, rng: np.random.Generator, generations: int) -> list[Packing]:
    """Random mates, crossover and replacement of the worst; ends early at the lower bound on bins.

    After the given generations it goes on as long as half as many children again bring a packing of fewer bins.
    """
    least = lower_bound(sizes, capacity)
    population.sort(key=Packing.fitness, reverse=True)
    left = generations * len(population) if len(population) > 1 else 0
    patience, fewest = left // 2, len(population[0].bins)
    while left > 0:
        left -= 1
        if len(population[0].bins) <= least:
            break
        if len(population[0].bins) < fewest:
            left, fewest = max(left, patience), len(population[0].bins)
        a, b = rng.choice(len(population), size=2, replace=False)
        child = crossover(population[a], population[b], rng)
        if child.fitness() > population[-1].fitness():
            population[-1] = child
            population.sort(key=Packing.fitness, reverse=True)
    return population


def founders(sizes: list[int], capacity: int, rng: np.random.Generator, n: int) -> list[Packing]:
    """Best fit by falling size, which evolution then never ends above, and in random orders."""
    orders = [np.argsort(-np.array(sizes, dtype=np.int64), kind="stable"), *(rng.permutation(len(sizes)) for _ in range(n - 1))]
    return [best_fit(sizes, capacity, order) for order in orders[:n]]


def pack(items: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION) -> DataFrame:
    """(key, bin, offset) for items(key long, length long), lengths from 1 to capacity - 1; bins are numbered across blocks and levels.

    items is read twice, so it should be a stored table. Each level's result is one.
    """
    options, n = (capacity, islands, epochs, generations, population), items.count()
    done, level, left = None, 0, items
    while True:
        n_blocks = max(1, round(n / block))
        placed = staged(_pack_blocks(left, n_blocks, *options).withColumn("bin", F.col("bin") * LEVELS + level), "packed")
        last, loose, n_left = n_blocks == 1, F.col("room") > capacity // LOOSE, 0
        if not last:
            n_left = placed.where(loose).count()
            last = not n_left or 2 * n_left > n or level + 1 == LEVELS
        kept = (placed if last else placed.where(~loose)).select("key", "bin", "offset")
        done = kept if done is None else done.unionByName(kept)
        if last:
            return done
        left, n, level = placed.where(loose).select("key", "length"), n_left, level + 1


def _pack_blocks(items: DataFrame, n_blocks: int, capacity: int, islands: int, epochs: int, generations: int, population: int) -> DataFrame:
    """(key, length, bin, offset, room), each block packed by itself; room is what the bin has left."""
    dealt = items.select("key", "length", F.pmod(F.xxhash64("key"), F.lit(n_blocks)).alias("block"))
    state = "block long, island int, elite boolean, keys binary, sizes binary, packings array<binary>"

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        """A block as one row per island, its pieces as packed arrays in order of key."""
        keys, sizes = (table.column(c).to_numpy().astype(np.int64) for c in ("key", "length"))
        order = np.argsort(keys, kind="stable")
        row = {"block": key[0].as_py(), "elite": False, "keys": keys[order].tobytes(), "sizes": sizes[order].tobytes(), "packings": []}
        return pa.Table.from_pylist([row | {"island": k} for k in range(islands)], schema=STATE)

    def epoch(number: int):
        def run(key: tuple, table: pa.Table) -> pa.Table:
            block_no, island = key[0].as_py(), key[1].as_py()
            rows = sorted(table.to_pylist(), key=lambda r: r["elite"])
            sizes = np.frombuffer(rows[0]["sizes"], dtype=np.int64).tolist()
            rng = np.random.default_rng([block_no, island, number])
            known = [Packing.decoded(np.frombuffer(p, dtype=np.int32), sizes, capacity) for r in rows for p in r["packings"]]
            if not known:
                known = founders(sizes, capacity, rng, population)
            ranked = evolve(known, sizes, capacity, rng, generations)[:population]
            told = [p.encoded().tobytes() for p in ranked]
            row = {"block": block_no, "island": island, "elite": False, "keys": rows[0]["keys"], "sizes": rows[0]["sizes"], "packings": told}
            migrant = row | {"island": (island + 1) % islands, "elite": True, "packings": told[:1]}
            return pa.Table.from_pylist([row, migrant] if number + 1 < epochs and islands > 1 else [row], schema=STATE)

        return run

    def finish(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        sizes = np.frombuffer(rows[0]["sizes"], dtype=np.int64)
        found = [Packing.decoded(np.frombuffer(r["packings"][0], dtype=np.int32), sizes.tolist(), capacity) for r in sorted(rows, key=lambda r: r["island"])]
        best = max(found, key=Packing.fitness)
        where, order, offset = best.encoded(), [i for b in best.bins for i in b], np.empty(len(sizes), dtype=np.int64)
        room = np.array(best.room, dtype=np.int64)[where]
        for b in best.bins:
            at = 0
            for i in b:
                offset[i] = at
                at += int(sizes[i])
        order = np.array(order, dtype=np.int64)
        keys = np.frombuffer(rows[0]["keys"], dtype=np.int64)
        bins = where[order].astype(np.int64) * n_blocks + key[0].as_py()
        return pa.table({"key": keys[order], "length": sizes[order], "bin": bins, "offset": offset[order], "room": room[order]})

    at = dealt.groupBy("block").applyInArrow(gather, state)
    for k in range(epochs):
        at = at.groupBy("block", "island").applyInArrow(epoch(k), state)
    return at.groupBy("block").applyInArrow(finish, "key long, length long, bin long, offset long, room long")


STATE = pa.schema([("block", pa.int64()), ("island", pa.int32()), ("elite", pa.bool_()), ("keys", pa.binary()), ("sizes", pa.binary()), ("packings", pa.list_(pa.binary()))])


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, **options: int) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    Sequence numbers are even for full pieces and odd for packed ones, and leave gaps.
    """
    known = staged(pieces(docs, path, id_col, text_col, capacity).withColumn("key", F.monotonically_increasing_id()), "pieces")
    alone = known.where(F.col("length") == capacity).withColumns({"sequence_id": F.col("key") * 2, "offset": F.lit(0).cast("long")})
    rest = known.where(F.col("length") < capacity)
    placed = pack(rest.select("key", "length"), capacity, **options)
    joined = rest.join(placed, "key").withColumn("sequence_id", F.col("bin") * 2 + 1)
    columns = [F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return alone.select(columns).unionByName(joined.select(columns))


def sequences(docs: DataFrame, packed: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """(sequence_id, ids, lengths): the packed sequences themselves; ids of documents must be unique."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                made = [np.append(c.encode(t), end_id)[a : a + n].tolist() for t, a, n in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(4), pa.array(made, pa.list_(pa.int32()))], names=["sequence_id", "offset", "ids"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = packed.withColumnRenamed(id_col, "id").join(texts, "id").select("sequence_id", "text", "start", "length", "offset")
    cuts = rows.mapInArrow(run, "sequence_id long, offset long, ids array<int>")
    both = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return cuts.groupBy("sequence_id").agg(both.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.transform("p.ids", F.size).alias("lengths")
    )
