"""Embedding near-dedup by PCA-ordered tiled comparison, exact.

Vectors of one label are scaled to length one and turned onto principal axes. Sorted by the first axis they are packed
into tiles; a pair with cosine >= t is at most sqrt(2 - 2t) apart on that axis, so most tile pairs need no look. Within
a tile pair the products of the leading axes are summed first; the rest is bounded by the product of the suffix norms
(Cauchy-Schwarz), and a pair is dropped as soon as it cannot reach t. What is left gets its cosine from the original
vectors in double precision. A tile pair yields link counts and a spanning forest, never the links.

Axes come from at most ``sample_rows`` vectors, chosen by hash; any axes give the same links, they only prune better or
worse. Equal vectors of a label are one node with a weight.

Defined results: a null label, and a null, empty or zero vector or one with null or non-finite parts, links with
nothing (n_links 0, itself its component); vectors of unequal length never link; a null id links with nothing and has
a null component; ids must fit ``long``; repeated rows are copies of each other and link; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from .common import staged
from .components import connected_components, local_forest

THRESHOLD = 0.98
TILE = 1024
SAMPLE_ROWS = 4096
#: Neighbouring tiles that travel together (a power of two): a tile is sent once for each group it meets, not for each tile.
GROUP = 8
GROUPS_A_TASK = 4
SLACK = 1e-9


def _plain(vectors: DataFrame, vec_col: str) -> Column:
    """The vectors as they are if their parts are floats, which are half as long on the way as doubles; else as doubles."""
    kind = vectors.schema[vec_col].dataType
    return F.col(vec_col) if isinstance(kind, ArrayType) and isinstance(kind.elementType, (FloatType, DoubleType)) else F.transform(vec_col, lambda x: x.cast("double"))


def nodes_of(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(label, v, rep, weight): each distinct valid vector of a label."""
    v = _plain(vectors, vec_col)
    ok = F.forall("v", lambda x: F.coalesce((x == x) & (F.abs(x) < math.inf), F.lit(False))) & F.exists("v", lambda x: x != 0)  # noqa: PLR0124
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v"), F.col(label_col).alias("label"))
    rows = rows.where(F.col("label").isNotNull() & F.col("id").isNotNull() & F.coalesce(ok, F.lit(False)))
    return rows.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"))


def principal_axes(nodes: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict[int, np.ndarray]:
    """For each vector length an orthonormal matrix, strongest axis first, from a bounded sample.

    The sample is of all rows' hashes, so it does not depend on how rows are partitioned.
    """
    lengths = {r.d: r.n for r in nodes.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).limit(16).collect()}
    axes = {}
    for d, n in lengths.items():
        limit = max(1, min(sample_rows, (1 << 22) // max(1, d)))
        below = int(min(1.0, limit / n) * (1 << 31))
        some = nodes.where((F.size("v") == d) & (F.pmod(F.xxhash64("rep"), F.lit(1 << 31)) < below)).select("v").limit(2 * limit)
        x = np.array([r.v for r in some.collect()], dtype=np.float64).reshape(-1, d)
        x = _unit(x)
        _, _, axes_t = np.linalg.svd(x.T @ x)
        axes[d] = np.ascontiguousarray(axes_t.T)
    return axes


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by the largest part first, so that no square overflows or vanishes."""
    x = np.asarray(x, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _lists(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _parts(vectors: DataFrame) -> tuple[str, type]:
    """The type of the parts of v, in Spark and in numpy."""
    kind = vectors.schema["v"].dataType.elementType.simpleString()
    return kind, np.float32 if kind == "float" else np.float64


def _tiles(nodes: DataFrame, axes: dict[int, np.ndarray], size: int) -> DataFrame:
    """(tile, grp, lo, hi, ids, weights, vectors): at most ``size`` vectors of one label, sorted by the first axis."""
    label_type = nodes.schema["label"].dataType.simpleString()

    def first_axis(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, key = batch.column(1), np.zeros(batch.num_rows)
            sizes = v.value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                x = _unit(_lists(v.take(pa.array(at)), int(d)))
                key[at] = x @ (axes[d][:, 0] if d in axes else np.eye(int(d), 1)[:, 0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes.astype(np.int32)), pa.array(key)], names=[*batch.schema.names, "d", "key"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held, now = TaskContext.get().partitionId(), 0, [], None

        def out() -> pa.RecordBatch:
            nonlocal k
            t = pa.Table.from_batches(held).combine_chunks()
            d, key = t.column("d")[0].as_py(), t.column("key").to_numpy()
            v = t.column("v").chunk(0) if t.column("v").num_chunks else t.column("v").combine_chunks()
            row = [
                pa.array([(part << 32) + k]), t.column("label").slice(0, 1).combine_chunks(), pa.array([d], pa.int32()),
                pa.array([float(key.min())]), pa.array([float(key.max())]), pa.array([t.column("rep").to_numpy().astype(np.int64).tobytes()]),
                pa.array([t.column("weight").to_numpy().astype(np.int64).tobytes()]), pa.array([_lists(v, d).tobytes()]),
            ]
            k += 1
            return pa.RecordBatch.from_arrays([x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in row], names=["tile", "label", "d", "lo", "hi", "ids", "weights", "vectors"])

        for batch in batches:
            labels, d = batch.column(batch.schema.names.index("label")), batch.column(batch.schema.names.index("d")).to_numpy()
            names = labels.dictionary_encode()
            codes = names.indices.to_numpy()
            cuts = [0, *(np.flatnonzero((codes[1:] != codes[:-1]) | (d[1:] != d[:-1])) + 1), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                run_of = (labels[int(lo)].as_py(), int(d[lo]))
                if held and run_of != now:
                    yield out()
                    held = []
                now = run_of
                while lo < hi:
                    room = size - sum(x.num_rows for x in held)
                    held.append(batch.slice(int(lo), int(min(room, hi - lo))))
                    lo += min(room, hi - lo)
                    if sum(x.num_rows for x in held) >= size:
                        yield out()
                        held = []
        if held:
            yield out()

    keyed = nodes.select("label", "v", "rep", "weight").mapInArrow(first_axis, f"label {label_type}, v array<{_parts(nodes)[0]}>, rep long, weight long, d int, key double")
    schema = f"tile long, label {label_type}, d int, lo double, hi double, ids binary, weights binary, vectors binary"
    return keyed.orderBy("label", "d", "key", "rep").mapInArrow(pack, schema)


def _reach(threshold: float) -> float:
    """How far apart on an axis two unit vectors of that cosine can be."""
    return math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK


def tile_pairs(tiles: DataFrame, threshold: float) -> DataFrame:
    """(x, y), x <= y: tiles of one label whose first-axis ranges come within reach; met on bins of that width."""
    reach = _reach(threshold)
    side = lambda a, extra: tiles.select(
        "label", "d", F.col("tile").alias(a), F.col("lo").alias(f"{a}lo"), F.col("hi").alias(f"{a}hi"),
        F.explode(F.sequence(F.floor(F.col("lo") / reach) - extra, F.floor(F.col("hi") / reach) + extra)).alias("bin"),
    )
    near = side("x", 0).join(side("y", 1), ["label", "d", "bin"])
    return near.where((F.col("x") <= F.col("y")) & (F.col("ylo") - F.col("xhi") <= reach) & (F.col("xlo") - F.col("yhi") <= reach)).select("x", "y").distinct()


def compare(a: np.ndarray, b: np.ndarray, axes: np.ndarray | None, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with cosine >= threshold, by blocks of rows of a; with same, i < j only."""
    ua, ub = _unit(a), _unit(b)
    d = ua.shape[1]
    ra, rb = (ua, ub) if axes is None else (ua @ axes, ub @ axes)
    steps = sorted({min(d, k) for k in (8, 16, 32)} | {d})
    after = lambda r: np.stack([np.sqrt((r[:, k:] ** 2).sum(axis=1)) for k in steps])
    na, nb = after(ra), after(rb)
    block = max(1, (1 << 18) // max(1, len(b)))
    for at in range(0, len(a), block):
        rows = slice(at, at + block)
        head = ra[rows, : steps[0]] @ rb[:, : steps[0]].T
        i, j = np.nonzero(head + na[0, rows, None] * nb[0][None, :] >= threshold - SLACK)
        total = head[i, j]
        i = i + at
        if same:
            later = i < j
            i, j, total = i[later], j[later], total[later]
        for k in range(1, len(steps)):
            if not len(i):
                break
            part = slice(steps[k - 1], steps[k])
            total = total + np.einsum("ij,ij->i", ra[i, part], rb[j, part])
            alive = total + na[k, i] * nb[k, j] >= threshold - SLACK
            i, j, total = i[alive], j[alive], total[alive]
        if len(i):
            exact = np.einsum("ij,ij->i", ua[i], ub[j]) >= threshold
            if exact.any():
                yield i[exact], j[exact]


def links(nodes: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, n_links, up): per tile pair and linked node its links there and its root in the pair's spanning forest."""
    axes = principal_axes(nodes, sample_rows)
    tiles = staged(_tiles(nodes, axes, tile), "vector-tiles")
    reach, bits = _reach(threshold), GROUP.bit_length() - 1
    pairs = tile_pairs(tiles, threshold).withColumns({"bx": F.shiftright("x", bits), "by": F.shiftright("y", bits)})
    ends = staged(pairs.select("bx", "by", F.explode(F.array("x", "y")).alias("tile")).distinct(), "tile-groups")
    groups, part = ends.select("bx", "by").distinct().count(), _parts(nodes)[1]

    def pair(a: dict, b: dict) -> pa.Table | None:
        d, same = a["d"], a["tile"] == b["tile"]
        ids, weights = (np.concatenate([np.frombuffer(t[name], dtype=np.int64) for t in ((a,) if same else (a, b))]) for name in ("ids", "weights"))
        vectors = [np.frombuffer(t["vectors"], dtype=part).reshape(-1, d) for t in (a, b)]
        shift, count, label = 0 if same else len(vectors[0]), np.zeros(len(ids), dtype=np.int64), None
        for i, j in compare(vectors[0], vectors[1], axes.get(d), threshold, same):
            j = j + shift
            np.add.at(count, i, weights[j])
            np.add.at(count, j, weights[i])
            label = local_forest(len(ids), i, j, label)
        met = np.flatnonzero(count)
        return pa.table({"id": ids[met], "n_links": count[met], "up": ids[label[met]]}) if len(met) else None

    def run(key: tuple, table: pa.Table) -> pa.Table:
        found, rows = [], sorted(table.to_pylist(), key=lambda t: t["tile"])
        left, right = ([t for t in rows if t["tile"] >> bits == k.as_py()] for k in key)
        for a in left:
            for b in right:
                if a["tile"] <= b["tile"] and (a["d"], a["label"]) == (b["d"], b["label"]) and b["lo"] - a["hi"] <= reach and a["lo"] - b["hi"] <= reach:
                    found.append(pair(a, b))
        none = pa.table({c: pa.array([], pa.int64()) for c in ("id", "n_links", "up")})
        return pa.concat_tables([none, *(x for x in found if x is not None)])

    sent = ends.join(tiles, "tile").repartition(max(1, -(-groups // GROUPS_A_TASK)), "bx", "by")
    return sent.groupBy("bx", "by").applyInArrow(run, "id long, n_links long, up long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, tile: int = TILE, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept."""
    nodes = staged(nodes_of(vectors, id_col, vec_col, label_col), "vectors")
    found = staged(links(nodes, threshold, tile, sample_rows), "vector-links")
    roots = connected_components(found.select(F.col("id").alias("a"), F.col("up").alias("b")))
    met = found.groupBy("id").agg(F.sum("n_links").alias("n_links")).join(roots, "id", "left")
    known = nodes.select("label", "v", "weight", F.col("rep").alias("id")).join(met, "id", "left").select(
        "label", "v", (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "id").alias("root")
    )
    rows = vectors.select(F.col(id_col).alias("id"), _plain(vectors, vec_col).alias("v"), F.col(label_col).alias("label"))
    named = rows.join(known, (rows["label"] == known["label"]) & (rows["v"] == known["v"]) & rows["id"].isNotNull(), "left")
    out = named.select(
        F.col("id").cast("long").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("root", "id").cast("long").alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
