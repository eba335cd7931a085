"""Some registered queries against their SQL, on the smallest tables."""

import os

import pytest

from quadrille import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = ["grid_cell_3d", "tree_capacity_2d", "tree_avg_width", "tree_bitstring", "local_knn_bf", "overlap_grid", "range_query_tree", "knn_join_grid_2d", "format_neighbors"]


def rows(df, columns):
    return sorted(map(str, df[columns].itertuples(index=False)))


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("orders", "customer", "events", "embeddings", "lineitem"):
        con.execute(f"create view {table} as select * from read_parquet('{DATA}/{table}.parquet')")
    found, told = catalog.queries()[name](spark, DATA).toPandas(), con.execute(catalog.oracle_sql()[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(told.columns) and len(found)
    assert rows(found.astype(str), columns) == rows(told.astype(str), columns)
