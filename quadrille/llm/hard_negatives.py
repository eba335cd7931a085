"""Hard-negative mining by cover trees over norm-augmented candidates, exact.

Candidates are sorted by label and nearest pivot and packed into tiles, and each tile gets a cover tree. A candidate x gets one
more component, sqrt(M^2 - |x|^2) with M the tile's greatest norm, and an anchor a zero: then an inner product falls as
the distance grows, and a node's covering radius bounds the products of all it holds from both sides, as does the
radius without the added component. Level by level a node's points are covered by centres taken farthest first, until
the radius is ``SHRINK`` times smaller or there are ``CHILDREN`` of them; each node keeps the radius that it really has.

An anchor descends the trees of a few tiles at once, best bound first. Nodes outside all of its windows, and nodes that
cannot reach the last place of a list that is full, are skipped; leaves are verified by exact integer products.
The first pass finds the positives, in tiles that hold the anchor's label, and gives each its window of scores; the
second finds the negatives. All anchors meet all rows, in blocks of tiles: a tile travels once for every ``ANCHORS`` anchors, so the
rows sent, but not the products, grow as anchors times candidates.

Pivots come from at most ``SAMPLE_ROWS`` rows, chosen by hash; any pivots give the same results, they only prune
better or worse.

Defined results: rows with a null id, label or vector, or a null component, take no part; an anchor's other rows are
those with another id, and repeated rows are candidates each, and anchors each; vectors of unequal length have
no product; components must fit ``long`` and so must products, else the job fails; an anchor without positives, or a
positive with an empty window (a negative score has one), gives no rows; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

N_POSITIVES, N_NEGATIVES = 5, 10
LOW, HIGH = 30, 90
TILE, ANCHORS = 2048, 512
#: Candidate tiles that are searched together.
BUNDLE = 4
PIVOTS, SAMPLE_ROWS = 64, 4096
LEAF, CHILDREN, SHRINK = 256, 16, 1.5
ANY = 1 << 63
EXACT = float(1 << 53)


def participants(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(row, id, label, v, d) of the rows that take part; v are longs, row tells rows with one id apart."""
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<bigint>").alias("v"))
    whole = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())
    return rows.where(whole).withColumn("d", F.size("v"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), d)


def _square(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def choose_pivots(rows: DataFrame, pivots: int = PIVOTS, sample_rows: int = SAMPLE_ROWS) -> dict[int, np.ndarray]:
    """For each of the commonest vector lengths up to ``pivots`` points that lie far apart, from a bounded sample."""
    found = {}
    for r in rows.groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).limit(16).collect():
        limit = max(1, min(sample_rows, (1 << 22) // max(1, r.d)))
        below = int(min(1.0, limit / r.n) * (1 << 31))
        some = rows.where((F.col("d") == r.d) & (F.pmod(F.xxhash64("id", "v"), F.lit(1 << 31)) < below)).select("v").limit(2 * limit)
        x = np.array([s.v for s in some.collect()], dtype=np.float64).reshape(-1, r.d)
        x = x[np.lexsort(x.T)] if x.size else x
        chosen, far = [], np.full(len(x), np.inf)
        while len(x) and len(chosen) < pivots and far.max() > 0:
            chosen.append(x[int(far.argmax())])
            far = np.minimum(far, _square(x - chosen[-1]))
        found[r.d] = np.array(chosen).reshape(-1, r.d)
    return found


class CoverTree:
    """Nodes in order of levels: centre, covering radii with and without the added component, the stretch of points and of children."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        square = _square(x)
        self.most = float(square.max(initial=0.0))
        added = np.sqrt(np.maximum(0.0, self.most - square))
        plain = np.maximum(0.0, square[:, None] + square[None, :] - 2 * (x @ x.T))
        apart = np.sqrt(plain + (added[:, None] - added[None, :]) ** 2)
        np.sqrt(plain, out=plain)
        self.order = np.arange(n)
        middle = int(apart.max(axis=1, initial=0.0).argmin()) if n else 0
        center, stretch, child = [middle], [(0, n)], []
        at = 0
        while at < len(center):
            lo, hi = stretch[at]
            own, c = self.order[lo:hi].copy(), center[at]
            far = apart[c, own]
            radius = float(far.max(initial=0.0))
            if hi - lo <= LEAF or radius <= 1e-9:
                child.append((0, 0))
            else:
                group, centers = np.zeros(len(own), dtype=np.int64), [c]
                while len(centers) < CHILDREN and far.max() > radius / SHRINK:
                    new = int(own[far.argmax()])
                    nearer = apart[new, own] < far
                    group[nearer] = len(centers)
                    far = np.where(nearer, apart[new, own], far)
                    centers.append(new)
                self.order[lo:hi] = own[np.argsort(group, kind="stable")]
                ends = lo + np.cumsum(np.bincount(group, minlength=len(centers)))
                held = [(g, int(a), int(b)) for g, (a, b) in enumerate(zip([lo, *ends[:-1]], ends, strict=True)) if a < b]
                child.append((len(center), len(center) + len(held)))
                center += [centers[g] for g, _, _ in held]
                stretch += [(a, b) for _, a, b in held]
            at += 1
        own = [self.order[lo:hi] for lo, hi in stretch]
        self.radius = np.array([apart[c, p].max(initial=0.0) for c, p in zip(center, own, strict=True)])
        self.plain = np.array([plain[c, p].max(initial=0.0) for c, p in zip(center, own, strict=True)])
        self.center, self.stretch, self.child = np.array(center, dtype=np.int64), np.array(stretch, dtype=np.int64), np.array(child, dtype=np.int64)


TILE_FIELDS = "tile long, d int, labels array<{label}>, ends array<int>, rows binary, ids binary, vectors binary"
TREE_FIELDS = ", bundle long, centers binary, nodes binary, radii binary"


def _tiles(rows: DataFrame, size: int, pivots: dict[int, np.ndarray] | None) -> DataFrame:
    """Tiles of at most ``size`` rows of one vector length, by label; with pivots candidates with their cover trees, neighbouring ones in bundles."""
    kind, keyed = rows.schema["label"].dataType.simpleString(), rows
    if pivots is not None:

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d, key = batch.column(4).to_numpy(), np.zeros(batch.num_rows, dtype=np.int32)
                for one in np.unique(d):
                    p = pivots.get(int(one))
                    if p is not None and len(p):
                        at = np.flatnonzero(d == one)
                        x = _matrix(batch.column(3).take(pa.array(at)), int(one)).astype(np.float64)
                        key[at] = (_square(p)[None, :] - 2 * (x @ p.T)).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key)], names=[*batch.schema.names, "pivot"])

        keyed = rows.mapInArrow(nearest, f"row long, id long, label {kind}, v array<bigint>, d int, pivot int")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held, now = TaskContext.get().partitionId(), 0, [], None

        def out() -> pa.RecordBatch:
            nonlocal k
            t = pa.concat_tables([pa.Table.from_batches([b]) for b in held]).combine_chunks()
            x = _matrix(pa.concat_arrays(t.column("v").chunks), now)
            names, ids, row = t.column("label").to_pylist(), t.column("id").to_numpy(), t.column("row").to_numpy()
            order = np.arange(len(x))
            if pivots is not None:
                tree = CoverTree(x.astype(np.float64))
                order = tree.order
            names = [names[i] for i in order.tolist()]
            # A tree's order mixes labels, so stretches of equal labels tell them.
            cuts = [i for i in range(1, len(names)) if names[i] != names[i - 1]]
            fields = {"tile": (part << 32) + k, "d": now, "labels": [names[i] for i in (0, *cuts)], "ends": [*cuts, len(names)], "rows": row[order].tobytes(), "ids": ids[order].tobytes(), "vectors": x[order].tobytes()}
            if pivots is not None:
                fields |= {"bundle": (part << 32) + k // BUNDLE, "centers": x[tree.center].tobytes(), "nodes": np.concatenate([tree.stretch, tree.child], axis=1).tobytes(), "radii": np.concatenate([[tree.most], tree.radius, tree.plain]).tobytes()}
            k += 1
            return pa.RecordBatch.from_pylist([fields], schema=arrow)

        arrow = pa.schema([
            ("tile", pa.int64()), ("d", pa.int32()), ("labels", pa.list_(label_kind)), ("ends", pa.list_(pa.int32())), ("rows", pa.binary()), ("ids", pa.binary()), ("vectors", pa.binary()),
            *([("bundle", pa.int64()), ("centers", pa.binary()), ("nodes", pa.binary()), ("radii", pa.binary())] if pivots is not None else []),
        ])
        for batch in batches:
            d = batch.column(batch.schema.names.index("d")).to_numpy()
            cuts = [0, *(np.flatnonzero(d[1:] != d[:-1]) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo < hi and held and int(d[lo]) != now:
                    yield out()
                    held = []
                while lo < hi:
                    now = int(d[lo])
                    take = min(size - sum(b.num_rows for b in held), hi - lo)
                    held.append(batch.slice(lo, take))
                    lo += take
                    if sum(b.num_rows for b in held) >= size:
                        yield out()
                        held = []
        if held:
            yield out()

    from pyspark.sql.pandas.types import to_arrow_type

    label_kind = to_arrow_type(rows.schema["label"].dataType)
    order = ["d", "label", *(["pivot"] if pivots is not None else []), "id", "row"]
    return keyed.orderBy(*order).mapInArrow(pack, TILE_FIELDS.format(label=kind) + (TREE_FIELDS if pivots is not None else ""))


class _Tile:
    """A tile as the search reads it."""

    def __init__(self, row: dict):
        self.d, self.names = row["d"], row["labels"]
        self.x = np.frombuffer(row["vectors"], dtype=np.int64).reshape(-1, self.d)
        self.ids, self.rows = (np.frombuffer(row[c], dtype=np.int64) for c in ("ids", "rows"))
        self.floats = self.x.astype(np.float64)
        number = {name: k for k, name in enumerate(dict.fromkeys(self.names))}
        self.number = number
        self.label = np.repeat([number[name] for name in self.names], np.diff([0, *row["ends"]])) if self.names else np.empty(0, dtype=np.int64)
        if row.get("nodes") is not None:
            nodes = np.frombuffer(row["nodes"], dtype=np.int64).reshape(-1, 4)
            self.stretch, self.child = nodes[:, :2].tolist(), nodes[:, 2:].tolist()
            radii = np.frombuffer(row["radii"])
            self.most, self.radius, self.plain = radii[0], radii[1 : 1 + len(nodes)], radii[1 + len(nodes) :]
            self.centers = np.frombuffer(row["centers"], dtype=np.int64).reshape(-1, self.d).astype(np.float64)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest product that each anchor of q can have with a point of each node."""
        product, square = q @ self.centers.T, _square(q)[:, None]
        whole, side = square + self.most, np.sqrt(square) * self.plain
        away = np.sqrt(np.maximum(0.0, whole - 2 * product))
        slack = 1e-9 * whole + 1e-3
        upper = np.minimum(product + side, (whole - np.maximum(0.0, away - self.radius - 1e-6) ** 2) / 2)
        lower = np.maximum(product - side, (whole - (away + self.radius + 1e-6) ** 2) / 2)
        return lower - slack, upper + slack

    def products(self, lo: int, hi: int, q: np.ndarray, q_float: np.ndarray) -> np.ndarray:
        """Exact products of one anchor and points lo to hi; doubles hold them where norms are moderate, else Python integers."""
        if self.most * (q_float @ q_float) < EXACT * EXACT:
            return self.floats[lo:hi] @ q_float
        return np.array([sum(a * b for a, b in zip(x, q.tolist(), strict=True)) for x in self.x[lo:hi].tolist()], dtype=object)


def best_products(anchors: _Tile, tiles: list[_Tile], windows: list[list[tuple[int, int]]], n: int, same: bool) -> Iterator[tuple[int, int, int, int]]:
    """(anchor, window, score, id): for each anchor and window the n best products within it, ends included, with points of its own label, or of others.

    Ties go to the smaller id; a point with the anchor's id doesn't count.
    """
    tiles = [t for t in tiles if t.d == anchors.d]
    limits = [t.bounds(anchors.floats) for t in tiles]
    inverse = {k: name for name, k in anchors.number.items()}
    for a in range(len(anchors.x)):
        own, label = windows[a], inverse[int(anchors.label[a])]
        if not own:
            continue
        need, top, lists = [lo for lo, _ in own], max(hi for _, hi in own), [[] for _ in own]
        least, me = min(need), int(anchors.ids[a])
        q, q_float = anchors.x[a], anchors.floats[a]
        heap, rows = [], {}
        for s, t in enumerate(tiles):
            mine = t.number.get(label)
            if (mine is None) if same else (mine is not None and len(t.number) == 1):
                continue
            heapq.heappush(heap, (-min(float(limits[s][1][a, 0]), top), s, 0))
        while heap:
            bound, s, node = heapq.heappop(heap)
            if -bound < least:
                break
            t = tiles[s]
            if s not in rows:
                rows[s] = limits[s][0][a].tolist(), limits[s][1][a].tolist()
            lower, upper = rows[s]
            if not any(upper[node] >= w and lower[node] <= hi for w, (_, hi) in zip(need, own, strict=True)):
                continue
            first, stop = t.child[node]
            if first < stop:
                for c in range(first, stop):
                    if upper[c] >= least and lower[c] <= top:
                        heapq.heappush(heap, (-min(upper[c], top), s, c))
                continue
            lo, hi = t.stretch[node]
            mine, codes, ids = t.number.get(label, -1), t.label, t.ids
            scores = t.products(lo, hi, q, q_float)
            for k in np.flatnonzero((scores >= least) & (scores <= top) & ((codes[lo:hi] == mine) == same)).tolist():
                score, name = int(scores[k]), int(ids[lo + k])
                if name == me:
                    continue
                for w, (_, most) in enumerate(own):
                    if need[w] <= score <= most:
                        bisect.insort(lists[w], (-score, name))
                        if len(lists[w]) > n:
                            lists[w].pop()
                        if len(lists[w]) == n:
                            need[w] = max(need[w], -lists[w][-1][0])
                least = min(need)
        for w, found in enumerate(lists):
            for score, name in found:
                yield a, w, -score, name


def window_of(positive: int, low: int, high: int) -> tuple[int, int]:
    """The scores s with low * positive <= 100 * s <= high * positive."""
    return -((-low * positive) // 100), (high * positive) // 100


FOUND = "atile long, arow long, anchor_id long, place int, positive_id long, positive_score long, id long, score long"


def _search(pairs: DataFrame, anchors: DataFrame, tiles: DataFrame, n: int, low: int, high: int) -> DataFrame:
    """Rows of FOUND for pairs(atile, bundle): the n best of each anchor; with ``positives`` in anchors, of each positive's window."""
    second = "positives" in anchors.columns

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        trees = [_Tile(r) for r in sorted(right.to_pylist(), key=lambda r: r["tile"])]
        for row in left.to_pylist():
            block = _Tile(row)
            given: list[list[tuple]] = [[] for _ in block.ids]
            if second:
                at = {int(r): k for k, r in enumerate(block.rows)}
                for p in row["positives"]:
                    given[at[p["arow"]]].append((p["place"], p["id"], p["score"]))
                windows = [[window_of(score, low, high) for _, _, score in own] for own in given]
            else:
                windows = [[(-ANY, ANY)] for _ in given]
            for a, w, score, name in best_products(block, trees, windows, n, same=not second):
                out.append((row["tile"], int(block.rows[a]), int(block.ids[a]), *(given[a][w] if second else (0, None, None)), name, score))
        columns = list(zip(*out, strict=True)) if out else [[]] * 8
        return pa.table([pa.array(c, pa.int32() if k == 3 else pa.int64()) for k, c in enumerate(columns)], names=[f.split()[0] for f in FOUND.split(", ")])

    pairs = staged(pairs, "tile-pairs")
    # Both sides come from one table, so their columns get names of their own.
    left = pairs.join(anchors.withColumn("atile", F.col("tile")), "atile")
    left, right = (df.select(*(F.col(c).alias(c) for c in df.columns)) for df in (left, pairs.join(tiles, "bundle")))
    return left.groupBy("atile", "bundle").cogroup(right.groupBy("atile", "bundle")).applyInArrow(run, FOUND)


def mine(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", n_positives: int = N_POSITIVES, n_negatives: int = N_NEGATIVES, low: int = LOW, high: int = HIGH, tile: int = TILE, anchors_a_tile: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where is_anchor, a condition on ``id``.

    An anchor's positives are the ``n_positives`` rows of its label with the greatest inner products, a positive's
    negatives the ``n_negatives`` best rows of other labels from ``low`` to ``high`` percent of its score; ties go to smaller ids.
    """
    rows = staged(participants(vectors, id_col, vec_col, label_col), "mining-rows")
    tiles = staged(_tiles(rows, tile, choose_pivots(rows)), "cover-trees")
    anchors = staged(_tiles(rows.where(is_anchor), anchors_a_tile, None), "anchor-tiles")
    named = lambda df, key: df.select(F.col(key), "d", F.explode("labels").alias("label")).distinct()
    alike = named(anchors.withColumn("atile", F.col("tile")), "atile").join(named(tiles, "bundle"), ["d", "label"]).select("atile", "bundle").distinct()
    best = Window.partitionBy("arow").orderBy(F.desc("score"), "id")
    positives = _search(alike, anchors, tiles, n_positives, low, high)
    positives = staged(positives.withColumn("place", F.row_number().over(best)).where(F.col("place") <= n_positives).select("atile", "arow", "place", "id", "score"), "positives")
    given = positives.groupBy("atile").agg(F.collect_list(F.struct("arow", "place", "id", "score")).alias("positives"))
    wanted = anchors.join(given, anchors["tile"] == given["atile"]).drop("atile")
    # Every block of anchors meets every bundle of tiles of its vector length.
    every = wanted.select(F.col("tile").alias("atile"), "d").join(tiles.select("bundle", "d").distinct(), "d").select("atile", "bundle")
    best = Window.partitionBy("arow", "place").orderBy(F.desc("score"), "id")
    negatives = _search(every, wanted, tiles, n_negatives, low, high).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n_negatives)
    return negatives.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
