"""kNN joins against brute force, and the cases in which a bound can go wrong."""

import random

import pytest

from quadrille.operators.knn import asof_x, broadcast_knn, merge_neighbors
from quadrille.operators.partition import Grid, Tree
from quadrille.operators.tree_build import build_tree
from quadrille.plans.joins import knn_join, range_join


def frames(spark, qs, ts):
    names = "x double, y double" + (", z double" if len((qs or ts)[0]) == 3 else "")
    q = spark.createDataFrame([(k, *p) for k, p in enumerate(qs)], f"qid long, {names}")
    t = spark.createDataFrame([(k, *p) for k, p in enumerate(ts)], f"tid long, {names}")
    return q, t


def brute(qs, ts, k):
    out = {}
    for i, q in enumerate(qs):
        d = sorted((sum((a - b) * (a - b) for a, b in zip(q, t, strict=True)) ** 0.5, j) for j, t in enumerate(ts))
        out[i] = [j for _, j in d[:k]]
    return out


def got(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.qid, r["rank"])):
        out.setdefault(r.qid, []).append(r.tid)
    return out


CASES = {
    "ring two": (10, 1, [(0.501, 0.501)], [(0.599, 0.599), (0.3985, 0.501)]),
    "ring three": (10, 2, [(0.501, 0.501)], [(0.599, 0.599), (0.699, 0.599), (0.2995, 0.501)]),
    "few points": (4, 5, [(0.1, 0.1), (0.9, 0.9)], [(0.2, 0.2), (0.5, 0.5), (0.9, 0.8)]),
    "zero radius": (8, 3, [(0.3, 0.3)], [(0.3, 0.3), (0.9, 0.9), (0.1, 0.95), (0.95, 0.1)]),
    "ties": (4, 3, [(0.5, 0.5)], [(0.25, 0.5), (0.75, 0.5), (0.5, 0.25), (0.5, 0.75)]),
    "borders": (10, 3, [(k / 10, k / 10) for k in range(10)], [(k / 10, (9 - k) / 10) for k in range(10)]),
    "z only": (4, 1, [(0.1, 0.1, 0.24)], [(0.1, 0.2, 0.05), (0.1, 0.1, 0.26)]),
}


@pytest.mark.parametrize("name", CASES)
def test_hard_cases(spark, name):
    n, k, qs, ts = CASES[name]
    q, t = frames(spark, qs, ts)
    dims = len(qs[0])
    want = brute(qs, ts, k)
    assert got(knn_join(q, t, k, Grid(n, dims))) == want
    assert got(knn_join(q, t, k, Tree(build_tree(t, 1, dims=dims, depth=5), dims))) == want


@pytest.mark.parametrize("dims", [2, 3])
def test_random(spark, dims):
    rng = random.Random(dims)
    point = lambda: tuple(min(0.999, rng.random() ** 3) for _ in range(dims))
    qs, ts = [point() for _ in range(60)], [point() for _ in range(400)]
    q, t = frames(spark, qs, ts)
    want = brute(qs, ts, 7)
    for method, salts in (("bf", 1), ("ps", 1), ("bf", 3)):
        assert got(knn_join(q, t, 7, Grid(11, dims), method, salts=salts)) == want
    for how in ("capacity", "siblings", "avg_width"):
        assert got(knn_join(q, t, 7, Tree(build_tree(t, 20, how, dims, 6), dims))) == want


def test_range_and_plan(spark):
    q, t = frames(spark, [(0.5, 0.5)], [(0.5, 0.75), (0.5, 0.76), (0.1, 0.1)])
    from pyspark.sql import functions as F

    balls = q.withColumn("radius", F.lit(0.25))
    assert [r.tid for r in range_join(balls, t, Grid(8)).collect()] == [0]
    plan = range_join(balls, t, Grid(8))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_asof_and_merge(spark):
    t = spark.createDataFrame([(1, 0.1), (2, 0.9)], "tid long, x double")
    q = spark.createDataFrame([(1, 0.5), (2, 0.05), (3, 0.9)], "qid long, x double")
    assert {r.qid: r.tid for r in asof_x(q, t).collect()} == {1: 1, 2: None, 3: 2}
    a = spark.createDataFrame([(0, 5, 0.3), (0, 6, 0.2)], "qid long, tid long, dist double")
    assert [(r.tid, r["rank"]) for r in merge_neighbors(a, a, k=2).orderBy("rank").collect()] == [(6, 1), (5, 2)]


def test_broadcast(spark):
    rng = random.Random(5)
    qs, ts = [(rng.random(), rng.random()) for _ in range(20)], [(round(rng.random(), 1), rng.random()) for _ in range(200)]
    q, t = frames(spark, qs, ts)
    for method in ("ps", "bf"):
        assert got(broadcast_knn(q, t, 5, method=method)) == brute(qs, ts, 5)
        with pytest.raises(ValueError):
            broadcast_knn(q, t, 5, limit=199, method=method)
    own = t.withColumnRenamed("tid", "qid")
    assert all(r.qid != r.tid for r in broadcast_knn(own, t, 2, exclude_self=True).collect())
    assert broadcast_knn(q, t.limit(0), 5).count() == 0 and broadcast_knn(q.limit(0), t, 5).count() == 0


@pytest.mark.parametrize("ids", [2, 9])
def test_repeated_ids_far_from_queries(spark, ids):
    """Queries whose cells hold no training points; with two ids there are fewer than k neighbours at all."""
    rng = random.Random(ids)
    qs = [(0.7 + rng.random() / 4, 0.7 + rng.random() / 4) for _ in range(10)]
    ts = [(k % ids, rng.random() / 2, rng.random() / 2) for k in range(120)]
    q, _ = frames(spark, qs, qs)
    t = spark.createDataFrame(ts, "tid long, x double, y double")
    want = {}
    for k, (x, y) in enumerate(qs):
        least = {}
        for tid, a, b in ts:
            least[tid] = min(least.get(tid, 9.0), ((x - a) * (x - a) + (y - b) * (y - b)) ** 0.5)
        want[k] = [tid for _, tid in sorted((d, tid) for tid, d in least.items())[:3]]
    assert got(knn_join(q, t, 3, Grid(8), unique_ids=False)) == want
