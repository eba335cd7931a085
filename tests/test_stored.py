"""Training points stored by cell: joins against brute force, plans without a shuffle of theirs, versions."""

import random

import pytest

from quadrille.operators.partition import Grid, Tree
from quadrille.operators.tree_build import build_tree
from quadrille.plans.joins import stored_knn_join
from quadrille.sources.stored import current_version, drop_versions, open_training, store_training
from test_catalog import DATA
from test_plans_at_scale import brute
from test_whole_queries import same

SCHEMA = "{} long, x double, y double"


def made(spark, nq=60, nt=500, seed=1, ids=None):
    rng = random.Random(seed)
    near = lambda: 0.25 + rng.random() / 64 if rng.random() < 0.4 else rng.random()
    q = [(k, near(), near()) for k in range(nq)]
    t = [(k % ids if ids else k, near(), near()) for k in range(nt)]
    return q, t, spark.createDataFrame(q, SCHEMA.format("qid")), spark.createDataFrame(t, SCHEMA.format("tid"))


def lists(df):
    return sorted((r.qid, r.tid, round(r.dist, 8)) for r in df.collect())


@pytest.mark.parametrize("method", ["bf", "ps"])
@pytest.mark.parametrize("kind", ["grid", "tree", "parts", "repeated", "self"])
def test_same_as_brute_force(spark, tmp_path, kind, method):
    q, t, qs, ts = made(spark, ids=90 if kind == "repeated" else None)
    cells = Tree(build_tree(ts, 20)) if kind == "tree" else Grid(8)
    options = {"part_rows": 16} if kind == "parts" else {}
    stored = store_training(ts, str(tmp_path), cells, unique_ids=kind != "repeated", buckets=3, **options)
    assert stored.keys == (["cell", "part"] if kind == "parts" else ["cell"]) and stored.points.count() == len(t)
    assert lists(stored_knn_join(qs, stored, 4, method, exclude_self=kind == "self")) == brute(q, t, 4, kind == "self")


@pytest.mark.parametrize("part_rows", [16, 1 << 18])
def test_points_are_not_shuffled(spark, tmp_path, part_rows):
    _, _, qs, ts = made(spark)
    stored = store_training(ts, str(tmp_path), Grid(8), buckets=3, part_rows=part_rows)
    before = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for c, v in zip(before, ("-1", "false"), strict=True):
        spark.conf.set(c, v)
    try:
        plan = stored_knn_join(qs, stored, 4)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    scans = [k for k, line in enumerate(plan) if "FileScan" in line and "Bucketed: true" in line]
    assert scans
    for k in scans:
        at, above = depth(plan[k]), []
        for line in reversed(plan[:k]):
            if depth(line) < at:
                at = depth(line)
                above.append(line)
                if "Join" in line:
                    break
        assert "Join" in above[-1] and not any("Exchange" in x for x in above)


def test_hot_cells_are_dealt(spark, tmp_path, monkeypatch):
    from quadrille.sources import stored as module

    q, t, qs, ts = made(spark, 200, 400)
    plain = module.hot_by_counts
    monkeypatch.setattr(module, "hot_by_counts", lambda nq, nt: plain(nq, nt, pairs=256, rows=64))
    stored = store_training(ts, str(tmp_path), Grid(4), buckets=2, part_rows=50)
    from quadrille.operators.partition import with_cell

    pairings = stored.pairings(with_cell(qs, Grid(4)))
    assert len(pairings) == 2
    met = [both[0].join(both[1].withColumnRenamed("x", "_x").withColumnRenamed("y", "_y"), both[2]).select("qid", "tid").collect() for both in pairings]
    every = [tuple(r) for rows in met for r in rows]
    cell = lambda p: (int(p[1] * 4), int(p[2] * 4))
    assert len(met[1]) and sorted(every) == sorted((a[0], b[0]) for a in q for b in t if cell(a) == cell(b))
    assert lists(stored_knn_join(qs, stored, 4)) == brute(q, t, 4)


def test_stale_versions_are_refused(spark, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(ValueError, match="no training points"):
        open_training(spark, path)
    q, t, qs, ts = made(spark, 10, 60)
    first = store_training(ts, path, Grid(4))
    second = store_training(ts.where("tid < 30"), path, Grid(2))
    assert (first.version, second.version, current_version(spark, path)) == (1, 2, 2)
    with pytest.raises(ValueError, match="stale"):
        stored_knn_join(qs, first, 3)
    with pytest.raises(ValueError, match="stale"):
        open_training(spark, path, 1)
    drop_versions(spark, path, 2)
    assert not (tmp_path / "store" / "version-1").exists()
    spark.sql("drop table if exists " + [r.tableName for r in spark.sql("show tables").collect() if r.tableName.endswith("_2") and "points" in r.tableName][-1])
    assert lists(stored_knn_join(qs, open_training(spark, path, 2), 3)) == brute(q, t[:30], 3)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_points(spark, tmp_path, n):
    q, t, qs, ts = made(spark, 10, 60)
    stored = store_training(ts.where(f"tid < {n}"), str(tmp_path), Grid(4))
    assert lists(stored_knn_join(qs, stored, 5)) == brute(q, t[:n], 5)


@pytest.mark.parametrize("name", ["knn_join_stored_grid", "knn_join_stored_tree", "knn_join_stored_dup_ids"])
def test_registered(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from quadrille import catalog

    con = duckdb.connect()
    for table in ("orders", "customer", "events", "embeddings", "lineitem"):
        con.execute(f"create view {table} as select * from read_parquet('{DATA}/{table}.parquet')")
    same(catalog.queries()[name](spark, DATA).toPandas(), con.execute(catalog.oracle_sql()[name]).df())
