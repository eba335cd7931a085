"""Counters of a whole join against counting by hand, merging in one shuffle, and writers' modes."""

import random

import pytest
from pyspark.sql import functions as F

from quadrille.functions.grid import surrounding_cells
from quadrille.operators.knn import merge_neighbors
from quadrille.operators.partition import Grid, sample_points, with_place
from quadrille.operators.tree_build import build_tree, tree_bit_chunks, tree_bitstring
from quadrille.plans.joins import JoinCounters, knn_join
from quadrille.sources.text import read_points, write_points
from quadrille.streaming.cells import windowed_cell_counts
from test_joins import frames


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def counted(spark, qs, ts, n, k):
    q, t = frames(spark, qs, ts)
    counters = JoinCounters()
    rows = knn_join(q, t, k, Grid(n), counters=counters).collect()
    assert len(rows) == len(qs) * min(k, len(ts))
    return counters.read()


def test_by_hand(spark):
    """One cell; a query in an empty cell whose other cells are both read; one whose second cell its shrunken ball leaves out."""
    names = ("local_distances", "seed_distances", "rest_distances", "distances", "overlapped_cells", "query_copies", "pruned_cells")
    told = lambda *n: dict(zip(names, n, strict=True))
    assert counted(spark, [(0.1, 0.1), (0.5, 0.5)], [(0.2, 0.2), (0.7, 0.7), (0.9, 0.1)], 1, 2) == told(6, 0, 0, 6, 0, 0, 0)
    assert counted(spark, [(0.6, 0.1)], [(0.1, 0.1), (0.9, 0.9)], 2, 1) == told(0, 1, 1, 2, 2, 2, 0)
    assert counted(spark, [(0.6, 0.02)], [(0.3, 0.02), (0.9, 0.9)], 2, 1) == told(0, 1, 0, 1, 2, 1, 1)


def test_full_cells(spark):
    rng = random.Random(1)
    qs, ts = ([(rng.random(), rng.random()) for _ in range(n)] for n in (60, 900))
    n, k, side = 4, 5, 0.25
    cell = lambda p: (int(p[0] * n), int(p[1] * n))
    held = {}
    for p in ts:
        held.setdefault(cell(p), []).append(p)
    local = copies = rest = 0
    for x, y in qs:
        own = cell((x, y))
        near = sorted(((x - a) ** 2 + (y - b) ** 2) ** 0.5 for a, b in held[own])
        assert len(near) >= k
        local += len(near)
        for (i, j), points in held.items():
            gap = max(i * side - x, 0, x - (i + 1) * side) ** 2 + max(j * side - y, 0, y - (j + 1) * side) ** 2
            if (i, j) != own and gap <= near[k - 1] ** 2:
                copies, rest = copies + 1, rest + len(points)
    got = counted(spark, qs, ts, n, k)
    assert got == {"local_distances": local, "seed_distances": 0, "rest_distances": rest, "distances": local + rest, "overlapped_cells": copies, "query_copies": copies, "pruned_cells": 0}
    with pytest.raises(ValueError):
        knn_join(*frames(spark, qs, ts), k, Grid(n), "ps", counters=JoinCounters())


@pytest.mark.parametrize("disjoint", [False, True])
def test_lists_merge_in_one_shuffle(spark, disjoint):
    rng = random.Random(2)
    lists = [[(q, part * 100 + t if disjoint else t, rng.random()) for q in range(20) for t in rng.sample(range(50), 6)] for part in range(3)]
    dfs = [spark.createDataFrame(x, "qid long, tid long, dist double") for x in lists]
    out = merge_neighbors(*dfs, k=6, disjoint=disjoint)
    assert plan_of(out).count("Exchange ") == 1 and (not disjoint or plan_of(out).count("WindowGroupLimit") == 2)
    want = []
    for q in range(20):
        least = {}
        for x in lists:
            for i, t, d in x:
                if i == q:
                    least[t] = min(d, least.get(t, 9.0))
        want += [(q, t, d, n) for n, (d, t) in enumerate(sorted((d, t) for t, d in least.items())[:6], 1)]
    assert sorted((r.qid, r.tid, r.dist, r["rank"]) for r in out.collect()) == sorted(want)


def test_append_and_overwrite(spark, tmp_path):
    p = spark.createDataFrame([(1, 0.25, 0.5), (2, 0.75, 0.125)], "tid long, x double, y double")
    path = str(tmp_path / "points")
    ids = lambda: sorted(r.tid for r in read_points(spark, path).collect())
    write_points(p, path, "tid", 2)
    write_points(p.where("tid = 1"), path, "tid", 2, "append")
    assert ids() == [1, 1, 2]
    write_points(p.where("tid = 2"), path, "tid", 2, "overwrite")
    assert ids() == [2]


def test_bits_in_chunks_and_places(spark):
    rng = random.Random(5)
    points = spark.createDataFrame([(k, rng.random() ** 2, rng.random()) for k in range(900)], "tid long, x double, y double")
    for leaves in (build_tree(points, 7).cache(), build_tree(points, 1000)):
        whole = tree_bitstring(leaves).first().bits
        chunks = tree_bit_chunks(leaves, 37).orderBy("chunk").collect()
        assert [r.chunk for r in chunks] == list(range(len(chunks))) and "".join(r.bits for r in chunks) == whole
        assert all(len(r.bits) == 37 for r in chunks[:-1])
    placed = with_place(points, F.desc("y"), "tid").orderBy("place").collect()
    assert [r.place for r in placed] == list(range(900)) and [r.tid for r in placed] == [r.tid for r in sorted(placed, key=lambda r: (-r.y, r.tid))]


def test_stream_of_points(spark, tmp_path):
    """Points by window and cell, from files that arrive one after the other."""
    schema = "tid long, x double, y double, at timestamp"
    points = spark.sql("select id as tid, (id % 8) / 8d as x, (id % 5) / 5d as y, timestamp'2024-01-01' + make_dt_interval(0, 0, 0, id) as at from range(120)")
    for k in range(3):
        points.where(F.col("tid") % 3 == k).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = windowed_cell_counts(stream, Grid(4), "at", "1 minute", "10 minutes")
    query = out.writeStream.format("memory").queryName("cells").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination(120)
    got = {(r.start.minute, r.cell): r.n for r in spark.table("cells").selectExpr("window.start as start", "cell", "n").collect()}
    want = {}
    for k in range(120):
        key = (k // 60, int(k % 8 / 8 * 4) + int(k % 5 / 5 * 4) * 4)
        want[key] = want.get(key, 0) + 1
    assert got == want


def test_rings_and_draws(spark):
    cells = spark.createDataFrame([(k,) for k in (0, 12, 24)], "cell long")
    got = sorted(map(tuple, surrounding_cells(cells, 5, 2, rings=2).collect()))
    near = lambda c, d: max(abs(c % 5 - d % 5), abs(c // 5 - d // 5)) <= 2
    assert got == sorted((c, d) for c in (0, 12, 24) for d in range(25) if c != d and near(c, d))
    points = spark.range(4000).withColumnRenamed("id", "tid")
    drawn = sample_points(points, 25, method="bernoulli", seed=3)
    ids = [r.tid for r in drawn.collect()]
    assert 800 < len(ids) == len(set(ids)) < 1200 and ids == [r.tid for r in sample_points(points, 25, method="bernoulli", seed=3).collect()]
    assert sample_points(points, 0, method="bernoulli").count() == 0 and sample_points(points, 100, method="bernoulli").where(F.col("tid") >= 0).count() == 4000
