"""Hot cells in parts, grids by cost, leaves by Morton code, over-full leaves, and as-of lookup with a hot key."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.functions.tree import tree_address
from quadrille.operators import asof, knn, partition
from quadrille.operators.knn import asof_x, dealt, hot_cells, local_knn
from quadrille.operators.partition import Grid, Tree, assign_leaves, cell_counts, with_cell
from quadrille.operators.tree_build import build_tree, split_overfull
from quadrille.plans import grids
from quadrille.plans.joins import knn_join
from test_joins import brute, frames, got


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def crowded(rng, n):
    """A third of the points in one cell of sixteen."""
    return [(rng.random() / 4, rng.random() / 4) if k % 3 == 0 else (rng.random(), rng.random()) for k in range(n)]


@pytest.mark.parametrize("pairs,rows", [(900, 10**6), (100, 30), (10**9, 40)])
def test_only_rows_of_hot_cells_are_copied(spark, pairs, rows):
    rng = random.Random(1)
    q, t = (with_cell(df, Grid(4)) for df in frames(spark, crowded(rng, 300), crowded(rng, 600)))
    hot = hot_cells(q, t, pairs=pairs, rows=rows)
    parts = {r.cell: (r.q_parts, r.t_parts) for r in hot.collect()}
    nq, nt = ({r.cell: r.n for r in cell_counts(df).collect()} for df in (q, t))
    assert set(parts) == {c for c in nq if c in nt and (nq[c] * nt[c] > pairs or max(nq[c], nt[c]) > rows)} and 0 in parts
    qs, ts, keys = dealt(q, t, hot)
    assert qs.count() == sum(n * parts.get(c, (1, 1))[1] for c, n in nq.items())
    assert ts.count() == sum(n * parts.get(c, (1, 1))[0] for c, n in nt.items())
    group = lambda df: {tuple(r[:3]): r[3] for r in df.groupBy(*keys).count().collect()}
    left, right = group(qs), group(ts)
    # Rows are dealt by hash, so parts differ somewhat.
    for k, n in left.items():
        m = right.get(k, 0)
        assert k[0] not in parts or (n * m <= 2.5 * pairs + 60 and max(n, m) <= 1.6 * rows + 20)


@pytest.mark.parametrize("method", ["bf", "ps"])
@pytest.mark.parametrize("ids", [600, 40])
def test_parts_give_the_same_lists(spark, method, ids):
    rng = random.Random(2)
    qs, ts = crowded(rng, 200), crowded(rng, 600)
    q, t = (with_cell(df, Grid(4)) for df in frames(spark, qs, ts))
    t = t.withColumn("tid", F.col("tid") % ids)
    rows = lambda **o: sorted((r.qid, r.tid, r.dist, r["rank"]) for r in local_knn(q, t, 5, method=method, unique_ids=ids == 600, exclude_self=True, **o).collect())
    plain = rows()
    assert len(plain) > 500 and rows(hot=hot_cells(q, t, pairs=300, rows=50)) == plain
    if method == "ps":  # blocks of queries against all pairs
        assert plain == sorted((r.qid, r.tid, r.dist, r["rank"]) for r in local_knn(q, t, 5, unique_ids=ids == 600, exclude_self=True).collect())


def test_join_with_hot_cells(spark, monkeypatch):
    rng = random.Random(3)
    qs, ts = crowded(rng, 90), crowded(rng, 500)
    q, t = frames(spark, qs, ts)
    monkeypatch.setattr(knn.known_hot, "__defaults__", ("cell", 200, 60))
    want = brute(qs, ts, 7)
    for method in ("bf", "ps"):
        assert got(knn_join(q, t, 7, Grid(4), method)) == want
    equal = [(0.3, 0.3)] * 300 + ts[:50]
    q, t = frames(spark, qs[:20], equal)
    assert got(knn_join(q, t, 4, Tree(build_tree(t, 20, depth=6)))) == brute(qs[:20], equal, 4)


def test_a_cell_of_a_million_rows(spark):
    """Groups are bounded: no part has more than the rows that one group may hold, but for the hash's spread."""
    n, limit = 1_000_000, 1 << 17
    points = spark.range(n).select(F.col("id").alias("tid"), (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)).alias("x"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30)) / float(1 << 30)).alias("y"))
    q, t = points.where("tid < 40").withColumnRenamed("tid", "qid").withColumn("cell", F.lit(0)), points.withColumn("cell", F.lit(0))
    hot = hot_cells(q, t, rows=limit)
    _, ts, keys = dealt(q, t, hot)
    sizes = [r["count"] for r in ts.groupBy(*keys).count().collect()]
    assert len(sizes) == 8 and max(sizes) <= limit * 1.02
    found = {}
    for r in local_knn(q, t, 3, method="ps", hot=hot).orderBy("qid", "rank").collect():
        found.setdefault(r.qid, []).append(r.tid)
    held = points.toPandas()
    x, y = held["x"].to_numpy(), held["y"].to_numpy()
    for k in range(40):
        d = np.sqrt((x - x[k]) ** 2 + (y - y[k]) ** 2)
        assert found[k] == held["tid"].to_numpy()[np.argsort(d, kind="stable")[:3]].tolist()


@pytest.mark.parametrize("dims", [2, 3])
def test_pairs_grow_with_the_data(spark, dims):
    """Twice the rows on both sides: a finer grid, and twice the pairs within a fifth."""
    pairs, sizes = [], []
    for n in (20_000, 40_000, 80_000):
        at = lambda k: (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1 << 30)) / float(1 << 30))  # noqa: E731,B023
        points = spark.range(n).select("id", *(at(k).alias(a) for k, a in enumerate("xyz"[:dims])))
        grid = grids.choose_grid(points, points, 10, dims)
        counts = cell_counts(with_cell(points, grid)).collect()
        sizes.append(grid.n)
        pairs.append(sum(r.n**2 for r in counts))
    assert sizes == sorted(set(sizes)) and all(1.6 <= b / a <= 2.4 for a, b in zip(pairs, pairs[1:], strict=False))


def test_join_chooses_its_grid(spark):
    rng = random.Random(4)
    for dims in (2, 3):
        qs, ts = ([tuple(rng.random() ** 2 for _ in range(dims)) for _ in range(n)] for n in (40, 300))
        q, t = frames(spark, qs, ts)
        assert got(knn_join(q, t, 5, dims=dims)) == brute(qs, ts, 5)
    assert grids.choose_grid(q.limit(0), t.limit(0), 5, 3).n == 1 and knn_join(q.limit(0), t, 5, dims=3).count() == 0
    one = grids.grid_costs(grids.coarse_counts(q, t, 3), [1], 5, 3).first()
    assert one.pairs == 40 * 300


def by_prefix(points, leaves, dims, depth):
    """Leaves by the text of addresses, in plain Python."""
    known = {r.addr for r in leaves.collect()}
    rows = points.select("tid", tree_address(*(F.col(a) for a in "xyz"[:dims]), depth=depth).alias("a")).collect()
    return {r.tid: next(r.a[:k] for k in range(depth + 1) if r.a[:k] in known) for r in rows}


@pytest.mark.parametrize("dims", [2, 3])
def test_leaves_by_code(spark, dims, monkeypatch):
    rng = random.Random(dims)
    points = spark.createDataFrame([(k, *(rng.random() ** 3 for _ in range(dims))) for k in range(2000)], "tid long, " + ", ".join(f"{a} double" for a in "xyz"[:dims]))
    odd = points.unionByName(spark.createDataFrame([(-1, *[None] * dims)], points.schema))
    for leaves in (build_tree(points.where("tid < 500"), 9, dims=dims, depth=8).cache(), build_tree(points, 10**6, dims=dims)):
        depth = leaves.agg(F.max("level")).first()[0]
        want = by_prefix(points, leaves, dims, depth)
        found = assign_leaves(odd, Tree(leaves, dims))
        assert "Generate" not in plan_of(found) and "Exchange" not in plan_of(found)
        assert sorted((r.tid, r.cell) for r in found.collect()) == sorted(want.items())
        monkeypatch.setattr(partition, "BROADCAST_ROWS", 0)
        found = assign_leaves(odd, Tree(leaves, dims))
        assert sorted((r.tid, r.cell) for r in found.collect()) == sorted(want.items()) and found.columns[:1] != ["_code"]
        monkeypatch.undo()


def test_more_leaves_than_are_sent(spark):
    address = F.lpad(F.conv(F.col("id").cast("string"), 10, 4), 9, "0")
    leaves = spark.range(1 << 18).select(address.alias("addr"), F.lit(9).alias("level"))
    rng = random.Random(6)
    points = spark.createDataFrame([(k, rng.random(), rng.random()) for k in range(3000)], "tid long, x double, y double")
    tree = Tree(leaves)
    assert not tree.small
    found = assign_leaves(points, tree)
    assert "Generate" not in plan_of(found)
    assert found.where(F.col("cell") != tree_address(F.col("x"), F.col("y"), depth=9)).count() == 0 and found.count() == 3000


@pytest.mark.parametrize("dims", [2, 3])
def test_overfull_leaves_are_split(spark, dims):
    """A tree from one point in a hundred, which misses a crowd; equal points end at the cap."""
    rng = random.Random(7)
    rows = [tuple(rng.random() for _ in range(dims)) for _ in range(3000)] + [tuple(0.2 + rng.random() / 500 for _ in range(dims)) for _ in range(3000)] + [(0.7,) * dims] * 200
    points = spark.createDataFrame([(k, *p) for k, p in enumerate(rows)], "tid long, " + ", ".join(f"{a} double" for a in "xyz"[:dims]))
    sampled = build_tree(points.where("tid % 100 = 0 and tid < 3000"), 3, dims=dims, depth=14).cache()
    leaves = split_overfull(points, sampled, 64, dims, depth=14).cache()
    assert leaves.columns == sampled.columns
    levels = [r.level for r in leaves.collect()]
    assert sum(2.0 ** (-dims * n) for n in levels) == 1.0 and len(levels) > sampled.count()
    counts = {r.cell: r.n for r in cell_counts(with_cell(points, Tree(leaves, dims))).collect()}
    assert {n for c, n in counts.items() if n > 64} == {200} and max(len(c) for c in counts) == 14
    kept = split_overfull(points, leaves, 200, dims, depth=14)
    assert kept is leaves


def test_asof_with_a_hot_key(spark, monkeypatch):
    """Half of the rows have one key: several ranges hold it, and values are carried over their borders."""
    rng = random.Random(8)
    key = lambda k: 5 if k % 2 else rng.randrange(12)
    t = [(key(k), round(rng.random(), 2), k) for k in range(1500)]
    t = [r for r in t if not (r[0] == 5 and 0.3 < r[1] < 0.8)]
    q = [(key(k), round(rng.random(), 3), k) for k in range(1500)] + [(99, 0.5, 2000)]
    qs, ts = spark.createDataFrame(q, "by int, x double, qid long"), spark.createDataFrame(t, "by int, x double, tid long")
    stored, plain = [], asof.staged
    monkeypatch.setattr(asof, "staged", lambda df, name: stored.append(plain(df, name)) or stored[-1])
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r.qid: (r.by, r.tid) for r in asof_x(qs, ts, by="by").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert stored[0].where("by = 5").select("_part").distinct().count() > 1
    lists = collections.defaultdict(list)
    for by, x, tid in t:
        lists[by].append((x, tid))
    assert found == {qid: (by, max(((a, tid) for a, tid in lists[by] if a <= x), default=(0, None))[1]) for by, x, qid in q}
