"""Registered queries that look at every row, against their SQL and plain Python."""

import random

import pytest

from quadrille import catalog
from quadrille.operators import knn, partition
from quadrille.operators.partition import Tree
from quadrille.operators.tree_build import build_tree
from quadrille.plans.fixtures import queries2d, training2d
from test_catalog import DATA, rows
from test_joins import brute, frames, got


def told_by_sql(name):
    con = pytest.importorskip("duckdb").connect()
    for table in ("orders", "customer"):
        con.execute(f"create view {table} as select * from read_parquet('{DATA}/{table}.parquet')")
    return con.execute(catalog.oracle_sql()[name]).df()


def same(found, told):
    columns = sorted(found.columns)
    assert columns == sorted(told.columns) and len(found) and rows(found.astype(str), columns) == rows(told.astype(str), columns)


def points(df, key):
    return {r[key]: (r.x, r.y) for r in df.collect()}


def test_merge_looks_at_every_training_row(spark):
    qs, ts = points(queries2d(spark, DATA), "qid"), points(training2d(spark, DATA), "tid")
    ids = sorted(ts)
    want = brute(list(qs.values()), [ts[k] for k in ids], catalog.K)
    found = catalog.queries()["merge_every"](spark, DATA)
    assert got(found) == {q: [ids[k] for k in want[n]] for n, q in enumerate(qs)}
    same(found.toPandas(), told_by_sql("merge_every"))


@pytest.mark.parametrize("name", ["overlap_grid_every", "overlap_point_counts_every", "overlap_tree_every"])
def test_overlaps_of_starved_queries(spark, name):
    found = catalog.queries()[name](spark, DATA).toPandas()
    same(found, told_by_sql(name))
    before = catalog.queries()[name.removesuffix("_every")](spark, DATA).toPandas()
    assert set(before["qid"]) <= set(found["qid"]) and (name == "overlap_tree_every" or found["qid"].nunique() > 140)


def test_overlaps_hold_the_nearest(spark):
    qs, ts = points(queries2d(spark, DATA), "qid"), points(training2d(spark, DATA), "tid")
    cell = lambda p: int(p[0] * catalog.N2) + int(p[1] * catalog.N2) * catalog.N2
    places, found = list(ts.values()), {(r.qid, r.cell) for r in catalog.queries()["overlap_grid_every"](spark, DATA).collect()}
    near = brute(list(qs.values()), places, catalog.K)
    want = {(q, cell(places[k])) for n, q in enumerate(qs) for k in near[n] if cell(places[k]) != cell(qs[q])}
    assert want <= found


def test_starved_queries_in_a_tree(spark):
    rng = random.Random(1)
    qs, ts = ([(rng.random() ** p, rng.random() ** p) for _ in range(n)] for n, p in ((40, 1), (300, 3)))
    q, t = frames(spark, qs, ts)
    tree = Tree(build_tree(t, 5, depth=6).persist())
    q, t = partition.with_cell(q, tree), partition.with_cell(t, tree)
    cells = {name: dict(df.select(name, "cell").collect()) for name, df in (("qid", q), ("tid", t))}
    found = {(r.qid, r.cell) for r in catalog._overlaps(q, t, tree).collect()}
    want = {(k, cells["tid"][j]) for k, near in brute(qs, ts, catalog.K).items() for j in near if cells["tid"][j] != cells["qid"][k]}
    assert len({k for k, _ in want}) > 30 and want <= found


@pytest.mark.parametrize("name", ["broadcast_knn", "local_knn_ps", "knn_join_sweep"])
def test_larger_tables(spark, name, monkeypatch):
    monkeypatch.setattr(catalog, "BROADCAST_ROWS", 100)
    monkeypatch.setattr(knn.known_hot, "__defaults__", ("cell", 900, 70))
    monkeypatch.setattr(catalog.knn, "broadcast_knn", None)
    same(catalog.queries()[name](spark, DATA).toPandas(), told_by_sql(name))


@pytest.mark.parametrize("name", ["tree_avg_width", "tree_avg_width_every"])
def test_leaves_narrower_than_the_sql_splits_for_width(spark, name, tmp_path):
    orders = spark.range(160_000).selectExpr("id as o_orderkey", "pmod(xxhash64(id, 1), 65536) as o_custkey", "cast(pmod(xxhash64(id, 2), 524288) as double) as o_totalprice")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    con = pytest.importorskip("duckdb").connect()
    con.execute(f"create view orders as select * from read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    told = con.execute(catalog.oracle_sql()[name]).df()
    found = catalog.queries()[name](spark, str(tmp_path)).toPandas()
    same(found, told)
    whole = catalog.queries()["tree_avg_width_every"](spark, str(tmp_path)).count()
    assert (len(found) < whole) == (name == "tree_avg_width")
