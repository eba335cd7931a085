"""Plans without a cross join or a window over everything, held against brute force."""

import random

import numpy as np
import pytest

from quadrille.functions.text import format_neighbors
from quadrille.operators.knn import asof_x, local_knn
from quadrille.operators.partition import Grid, with_cell
from quadrille.operators.tree_build import build_tree
from quadrille.plans.joins import knn_join
from quadrille.sources.text import load_tree, save_tree


def brute(q, t, k, without_self=False):
    out = []
    for qid, x, y in q:
        best = {}
        for tid, a, b in t:
            if not (without_self and tid == qid):
                d = np.sqrt((x - a) ** 2 + (y - b) ** 2)
                best[tid] = min(d, best.get(tid, 9))
        out += [(qid, tid, round(float(d), 8)) for tid, d in sorted(best.items(), key=lambda x: (x[1], x[0]))[:k]]
    return sorted(out)


@pytest.mark.parametrize("exclude_self", [False, True])
def test_few_ids_of_many_rows(spark, exclude_self):
    rng = random.Random(1)
    q = [(k, rng.random(), rng.random()) for k in range(30)]
    t = [(k % 3, rng.random(), rng.random()) for k in range(400)]
    qs, ts = spark.createDataFrame(q, "qid long, x double, y double"), spark.createDataFrame(t, "tid long, x double, y double")
    out = knn_join(qs, ts, 5, Grid(8), unique_ids=False, exclude_self=exclude_self)
    assert "CartesianProduct" not in out._jdf.queryExecution().toString() and "NestedLoop" not in out._jdf.queryExecution().toString()
    got = sorted((r.qid, r.tid, round(r.dist, 8)) for r in out.collect())
    assert got == brute(q, t, 5, exclude_self)


@pytest.mark.parametrize("partitions", [1, 5])
def test_asof_over_ranges(spark, partitions):
    rng = random.Random(2)
    q = [(k, rng.randrange(200) / 200) for k in range(300)]
    t = [(k, 0.3 if k % 3 else rng.randrange(20, 200) / 200) for k in range(300)]
    qs, ts = spark.createDataFrame(q, "qid long, x double"), spark.createDataFrame(t, "tid long, x double")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(partitions == 1).lower())
    try:
        got = {r.qid: r.tid for r in asof_x(qs, ts).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == {qid: max(((a, tid) for tid, a in t if a <= x), default=(0, None))[1] for qid, x in q}
    assert {r.tid for r in asof_x(qs, ts.limit(0)).collect()} == {None}


def test_sweep_of_a_table_against_itself(spark):
    rng = random.Random(3)
    p = [(k, rng.random(), rng.random()) for k in range(80)]
    ts = with_cell(spark.createDataFrame(p, "tid long, x double, y double"), Grid(2))
    qs = ts.withColumnRenamed("tid", "qid")
    sweep, all_pairs = (sorted((r.qid, r.tid, r["rank"]) for r in local_knn(qs, ts, 4, method=m).collect()) for m in ("ps", "bf"))
    assert sweep == all_pairs


def test_farthest_first_lists(spark):
    rows = [(1, 10, 0.5, 1), (1, 11, 0.75, 2), (1, 12, 1.0, 3), (2, 10, 0.25, 1)]
    df = spark.createDataFrame(rows, "qid long, tid long, dist double, rank int")
    lines = {r.qid: r.line for r in format_neighbors(df, 2, "max").collect()}
    assert lines == {1: "12\t1.00000000\t11\t0.75000000\t", 2: "10\t0.25000000\t"}


def test_trees_are_kept_and_replaced(spark, tmp_path):
    rng = random.Random(4)
    points = spark.createDataFrame([(k, rng.random(), rng.random()) for k in range(200)], "tid long, x double, y double")
    path = str(tmp_path / "tree")
    for capacity in (20, 60):
        leaves = build_tree(points, capacity)
        save_tree(leaves, path, mode="overwrite")
        assert sorted(map(tuple, load_tree(spark, path).collect())) == sorted(map(tuple, leaves.collect()))
