"""Sent tables searched by cells at quantiles, against the sweep and brute force; swept cells without training points."""

import random

import numpy as np
import pytest

from quadrille.operators import knn
from quadrille.operators.knn import CellArrays, broadcast_knn, local_knn, sweep_block
from quadrille.operators.partition import Tree, with_cell
from quadrille.operators.tree_build import build_tree
from test_plans_at_scale import brute
from test_stored import SCHEMA, lists, made


def in_order(found):
    order = np.lexsort((found[3], found[0]))
    return [x[order] for x in found]


@pytest.mark.parametrize("candidates", [64, 1 << 20])
@pytest.mark.parametrize("kind", ["even", "equal", "lattice", "cluster", "outside", "diagonal"])
def test_same_as_sweep(monkeypatch, kind, candidates):
    monkeypatch.setattr(knn, "CANDIDATES", candidates)
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 50, 400):
        for k, dims, self_left_out, ids in ((1, 2, False, None), (3, 3, True, None), (10, 2, True, 7), (10, 3, False, 100)):
            points, rows = rng.random((n, dims)), rng.random((60, dims))
            if kind == "equal":
                points[: n // 2] = 0.5
            elif kind == "lattice":
                points, rows = np.round(points * 8) / 8, np.round(rows * 8) / 8
            elif kind == "cluster":
                points[n // 4 :] = points[n // 4 :] / 1000 + 0.3
            elif kind == "outside":
                rows = rows * 3 - 1
            elif kind == "diagonal":
                points = points[:, :1] + points / 1000
            tids = np.arange(n) if ids is None else rng.integers(0, ids, n)
            order = np.lexsort((tids, points[:, 0]))
            points, tids = points[order], tids[order]
            swept = in_order(sweep_block(rows, np.arange(60), points, tids, k, self_left_out))
            found = in_order(CellArrays.made(points, tids, k).nearest(rows, np.arange(60), k, self_left_out))
            assert all(len(a) == len(b) and (a == b).all() for a, b in zip(swept, found, strict=True))


def test_few_points_are_compared():
    """A query meets points near it only, in a cluster too."""
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.random((2_000, 2)), 0.3 + rng.random((18_000, 2)) / 1000])
    cells = CellArrays.made(points, np.arange(len(points)), 10)
    rows = points[rng.integers(0, len(points), 500)]
    own = cells._index(rows, cells.edges)
    _, _, length = cells._runs(np.maximum(own - 1, 0), np.minimum(own + 1, cells.last))
    assert length.sum() / 500 < 200
    at, tid, dist, rank = cells.nearest(rows, np.full(500, -1), 10)
    far = np.sort(np.sqrt(((points[None] - rows[:, None]) ** 2).sum(axis=2)), axis=1)[:, :10]
    got = in_order((at, tid, dist, rank))
    assert (got[0] == np.repeat(np.arange(500), 10)).all() and np.allclose(got[2].reshape(500, 10), far, rtol=1e-12, atol=0)


@pytest.mark.parametrize("method", ["cells", "ps", "bf"])
def test_sent_whole(spark, method):
    q, t, qs, ts = made(spark)
    assert lists(broadcast_knn(qs, ts, 4, method=method)) == brute(q, t, 4)
    assert lists(broadcast_knn(qs, ts, 4, method=method, exclude_self=True)) == brute(q, t, 4, True)
    assert broadcast_knn(qs, ts.limit(0), 4, method=method).count() == 0
    with pytest.raises(ValueError, match="more than 499"):
        broadcast_knn(qs, ts, 4, method=method, limit=499)


def test_swept_leaf_without_training_points(spark):
    rng = random.Random(5)
    every = spark.createDataFrame([(k, rng.random(), rng.random()) for k in range(200)], SCHEMA.format("tid"))
    tree = Tree(build_tree(every, 10))
    ts, qs = with_cell(every.where("x < 0.5"), tree), with_cell(every.withColumnRenamed("tid", "qid"), tree)
    swept, all_pairs = (sorted((r.cell, r.qid, r.tid) for r in local_knn(qs, ts, 3, method=m).collect()) for m in ("ps", "bf"))
    assert swept == all_pairs and len({r.cell for r in qs.select("cell").collect()}) > len({r[0] for r in swept})
