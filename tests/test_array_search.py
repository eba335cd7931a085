"""Lists from cell arrays, without a row for each pair of a cell."""

import numpy as np
import pytest

from quadrille import catalog
from quadrille.operators import knn, overlap, partition
from quadrille.operators.knn import CellArrays, farthest_block, range_block
from quadrille.plans import joins
from test_catalog import DATA
from test_whole_queries import same, told_by_sql

#: Queries whose SQL pairs rows of a cell or of a ball; none of them may do so by a Spark join.
NAMES = ["local_radius", "format_neighbors", "knn_metrics", "neighbors_written", "local_knn_bf", "local_knn_salted", "merge_two", "overlap_grid", "overlap_point_counts", "overlap_grid_every", "overlap_point_counts_every", "merge_many", "knn_join_dup_ids", "knn_join_stored_dup_ids", "merge_every", "range_join", "range_join_tree"]


@pytest.mark.parametrize("parts", [False, True])
@pytest.mark.parametrize("name", NAMES)
def test_no_row_for_each_pair(spark, name, parts, monkeypatch):
    monkeypatch.setattr(knn, "_paired", None)
    monkeypatch.setattr(joins, "_in_balls", None)
    if parts:
        monkeypatch.setattr(knn, "ROWS_A_SEARCH", 3)
    same(catalog.queries()[name](spark, DATA).toPandas(), told_by_sql(name))


def lists(rows, qids, points, ids, k, exclude_self, most):
    out = []
    for q, row, far in zip(qids, rows, most, strict=True):
        best = {}
        for d, i in zip(np.sqrt(sum((points[:, a] - row[a]) ** 2 for a in range(len(row)))), ids, strict=True):
            if d <= far and not (exclude_self and i == q) and d < best.get(i, np.inf):
                best[i] = d
        out.append(sorted((d, i) for i, d in best.items())[:k])
    return out


@pytest.mark.parametrize("seed", range(24))
def test_search_against_all_pairs(seed):
    rng = np.random.default_rng(seed)
    dims, n, k = 2 + seed % 2, int(rng.integers(1, 300)), int(rng.integers(1, 12))
    points, rows = rng.random((n, dims)), rng.random((40, dims))
    if seed % 3 == 0:  # ties
        points, rows = np.floor(points * 6) / 8, np.floor(rows * 8) / 8
    if seed % 4 == 0:  # queries far from all points
        points[:, -1] *= 0.1
    ids, qids = rng.integers(0, n // 2 + 1, n) if seed % 5 < 2 else np.arange(n), rng.integers(0, n, 40)
    most = rng.random(40) * 0.5 if seed % 2 else None
    at, tid, dist, rank = CellArrays.made(points, ids, k).nearest(rows, qids, k, seed % 7 < 3, most)
    found = [[(dist[x], tid[x]) for x in np.flatnonzero(at == q)[np.argsort(rank[at == q])]] for q in range(40)]
    assert found == lists(rows, qids, points, ids, k, seed % 7 < 3, np.full(40, np.inf) if most is None else most)


@pytest.mark.parametrize("seed", range(6))
def test_blocks_against_all_pairs(seed):
    rng = np.random.default_rng(seed)
    points, rows, radius = rng.random((int(rng.integers(1, 500)), 2)), rng.random((90, 2)), rng.random(90) * 0.4
    if seed % 2:
        points, rows = np.floor(points * 8) / 8, np.floor(rows * 8) / 8
    ids = rng.permutation(len(points))
    dist = np.sqrt((points[None, :, 0] - rows[:, None, 0]) ** 2 + (points[None, :, 1] - rows[:, None, 1]) ** 2)
    at, tid, far = farthest_block(rows, np.arange(90), points, ids, 7)
    want = {(q, i, d) for q in range(90) for d, i in sorted(((d, i) for d, i in zip(dist[q], ids, strict=True)), key=lambda x: (-x[0], x[1]))[:7]}
    assert set(zip(at, tid, far, strict=True)) == want and len(at) == len(want)
    at, tid, near = range_block(rows, np.arange(90), points, ids, radius)
    assert sorted(zip(at, tid, near, strict=True)) == sorted((q, ids[j], dist[q, j]) for q, j in zip(*np.nonzero(dist <= radius[:, None]), strict=True))


@pytest.mark.parametrize("few", [True, False])
def test_balls_are_not_broadcast(spark, few, monkeypatch):
    monkeypatch.setattr(partition, "BROADCAST_ROWS", 200_000 if few else 3)
    monkeypatch.setattr(overlap, "BROADCAST_ROWS", 200_000 if few else 3)
    balls = catalog._balls(spark, DATA)
    for partitioning in (catalog._tree(spark, DATA), partition.Grid(16)):
        cells = overlap.cells_in_reach(balls, spark.createDataFrame([], f"cell {'string' if isinstance(partitioning, partition.Tree) else 'long'}"), partitioning)
        plan = cells._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan or "BuildRight" in plan
        assert "BuildLeft" not in plan and (few or "SortMergeJoin" in plan)
    same(catalog.queries()["range_query_tree"](spark, DATA).toPandas(), told_by_sql("range_query_tree"))
