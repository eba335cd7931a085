"""SimHash near-dedup by tiled exact comparison.

Fingerprints are made per document in Python tasks (bounded memory for texts of any length). Distinct fingerprints are
sorted by population count, then by those of their parts, and packed into tiles of bounded size; each tile knows the
range of each count. Two fingerprints within ``radius`` bits differ by at most that in their population counts, so
only tile pairs whose ranges allow it are compared, exactly, with numpy exclusive-or and bit counts. A tile pair
yields a spanning forest of its links, not the links, and a star-contraction job joins the forests.

Equal fingerprints are one node, so copies cost nothing. The number of comparisons still grows with the square of the
number of distinct fingerprints, at about 2 ns each; the parts' counts prune more the more fingerprints there are.

Defined results: null and empty texts have fingerprint zero and link like any other; a null id is carried along but
never names a component unless all its members are null; repeated rows share a component; empty tables give empty
results; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, staged
from .components import connected_components, local_forest

RADIUS = 3
SHINGLE = 3
SEED = 42
TILE = 4096
PIECE = 1 << 20
#: Tile pairs that a task compares, about; their bytes say nothing of the work.
PAIRS_A_TASK = 16
SPACE = re.compile(rb"[ \t\n\r\v\f]")
#: Bits whose population counts a tile keeps the range of: all, then quarters.
PARTS = (0xFFFFFFFFFFFFFFFF, *(0xFFFF << s for s in (48, 32, 16, 0)))


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """Lists of words; long texts come in pieces cut at white space."""
    if len(data) <= PIECE:
        yield data.split()
        return
    at, end = 0, len(data)
    while at < end:
        to = min(at + PIECE, end)
        if to < end:
            cut = SPACE.search(data, to)
            to = cut.start() if cut else end
        yield data[at:to].split()
        at = to


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits, each set if it is set in over half the shingles' XXH64; no words: 0.

    ``bytes.lower`` and ``bytes.split`` are A-Z and ASCII white space only, as wanted.
    """
    data = (text or "").encode().lower()
    digest = xxhash.xxh64_intdigest
    ones, n, tail = np.zeros(64, dtype=np.int64), 0, []
    for words in _pieces(data):
        words = tail + words
        if len(words) >= shingle:
            columns = zip(*(words[k:] for k in range(shingle)), strict=False)
            h = np.fromiter((digest(x, seed) for x in map(b" ".join, columns)), dtype=">u8", count=len(words) - shingle + 1)
            n += len(h)
            for k in range(0, len(h), 1 << 16):
                ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        tail = words[-(shingle - 1) :] if shingle > 1 else []
    if not n:
        return digest(b" ".join(tail), seed) if tail else 0
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def _tiles(fps: DataFrame, size: int) -> DataFrame:
    """(tile, lows, highs, fps): tiles of at most ``size`` fingerprints, sorted by population counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        left = np.empty(0, dtype=np.uint64)

        def tile(x: np.ndarray) -> pa.RecordBatch:
            nonlocal k
            counts = [np.bitwise_count(x & np.uint64(m)) for m in PARTS]
            row = {"tile": (part << 32) + k, "lows": [int(c.min()) for c in counts], "highs": [int(c.max()) for c in counts], "fps": x.tobytes()}
            k += 1
            return pa.RecordBatch.from_pylist([row], schema=TILE_SCHEMA)

        for batch in batches:
            left = np.concatenate([left, batch.column(0).to_numpy().view(np.uint64)])
            while len(left) >= size:
                yield tile(left[:size])
                left = left[size:]
        if len(left):
            yield tile(left)

    order = [F.bit_count(F.col("fp").bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64)))) for m in PARTS]
    sorted_fps = fps.select("fp").orderBy(*order, "fp")
    return sorted_fps.mapInArrow(run, "tile long, lows array<int>, highs array<int>, fps binary")


TILE_SCHEMA = pa.schema([("tile", pa.int64()), ("lows", pa.list_(pa.int32())), ("highs", pa.list_(pa.int32())), ("fps", pa.binary())])


def tile_pairs(tiles: DataFrame, radius: int) -> DataFrame:
    """(x, y), x <= y: tile pairs whose population counts can be within radius; met by an equi-join on the whole count."""
    left = tiles.select(F.col("tile").alias("x"), F.col("lows").alias("xl"), F.col("highs").alias("xh"))
    right = tiles.select(F.col("tile").alias("y"), F.col("lows").alias("yl"), F.col("highs").alias("yh"))
    left = left.withColumn("count", F.explode(F.sequence(F.col("xl")[0], F.col("xh")[0])))
    right = right.withColumn("count", F.explode(F.sequence(F.col("yl")[0] - radius, F.col("yh")[0] + radius)))
    apart = lambda k: F.greatest(F.lit(0), F.col("yl")[k] - F.col("xh")[k], F.col("xl")[k] - F.col("yh")[k])
    parts = sum((apart(k) for k in range(2, len(PARTS))), apart(1))
    near = left.join(right, "count").where((F.col("x") <= F.col("y")) & (apart(0) <= radius) & (parts <= radius))
    return near.select("x", "y").distinct()


def compare(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles of distinct fingerprints, as two arrays of ends."""
    both = a if same else np.concatenate([a, b])
    shift, label, step = 0 if same else len(a), None, max(1, (1 << 18) // max(1, len(b)))
    for k in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(a[k : k + step, None] ^ b[None, :]) <= radius)
        i += k
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):
            label = local_forest(len(both), i, j + shift, label)
    if label is None:
        return a[:0], a[:0]
    child = np.flatnonzero(label != np.arange(len(both)))
    return both[child], both[label[child]]


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints of fps(fp) that are within radius bits of each other.

    Every pair is compared unless population counts rule it out. One row per tile pair is shuffled with both tiles,
    2 * tile * 8 bytes.
    """
    tiles = staged(_tiles(fps, tile), "tiles")
    pairs = staged(tile_pairs(tiles, radius), "tile-pairs")
    tasks = max(1, -(-pairs.count() // PAIRS_A_TASK))

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("side").to_numpy())
        got = [np.frombuffer(table.column("fps")[int(k)].as_py(), dtype=np.uint64) for k in order]
        a, b = compare(got[0], got[-1], len(got) == 1, radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    ends = pairs.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("tile"))
    ends = ends.join(tiles.select("tile", "fps"), "tile").select("x", "y", F.col("tile").alias("side"), "fps")
    return ends.repartition(tasks, "x", "y").groupBy("x", "y").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """One row per input row: id, fp (signed long), component_id, the smallest id reachable by links."""
    rows = staged(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = staged(rows.groupBy("fp").agg(F.min("id").alias("rep")), "nodes")
    roots = connected_components(links(nodes, radius, tile)).withColumnRenamed("id", "fp")
    linked = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = linked.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of docs that stay: one row of each component, whole, that with the smallest id, null ids last.

    Rows with one id are told apart by their texts, the smaller MD5 first; of rows equal in both any one stays.
    """
    place, digest = free_name(docs, "place"), free_name(docs, "digest")
    tagged = docs.withColumn(digest, F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    rank = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(digest).alias("digest"))
    labelled = near_duplicates(tagged.select(rank.alias("rank"), F.col(text_col).alias("text")), "rank", "text", radius)
    stay = labelled.where(F.col("rank").eqNullSafe(F.col("component_id"))).select("rank.id", "rank.digest").distinct()
    same = tagged[id_col].eqNullSafe(stay["id"]) & (tagged[digest] == stay["digest"])
    first = Window.partitionBy(id_col, digest).orderBy(F.lit(0))
    kept = tagged.join(stay, same, "left_semi").withColumn(place, F.row_number().over(first)).where(F.col(place) == 1)
    return kept.drop(place, digest)
