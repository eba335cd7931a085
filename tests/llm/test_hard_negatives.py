"""Hard negatives against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import hard_negatives as hn


def brute(rows, is_anchor, n_positives=5, n_negatives=10, low=30, high=90):
    """rows: (id, vector, label) that take part."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for i, v, label in rows:
        if not is_anchor(i):
            continue
        others = [(dot(v, w), j, m) for j, w, m in rows if j != i and len(w) == len(v)]
        for p, pid, _ in sorted((x for x in others if x[2] == label), key=lambda x: (-x[0], x[1]))[:n_positives]:
            near = sorted((x for x in others if x[2] != label and low * p <= 100 * x[0] <= high * p), key=lambda x: (-x[0], x[1]))
            out += [(i, pid, k, j, p, s) for k, (s, j, _) in enumerate(near[:n_negatives], 1)]
    return sorted(out)


def found(df, is_anchor, **options):
    return sorted(tuple(r) for r in hn.mine(df, is_anchor, vec_col="v", **options).collect())


@pytest.mark.parametrize("labels", [[0, 1, 2], ["a", "b", "ä"]])
def test_random(spark, labels):
    """Clusters, ties, repeated rows and ids, a label with a third of all rows, vectors of another length, values that take no part."""
    rng = random.Random(1)
    centers = [[rng.randrange(-9, 10) for _ in range(6)] for _ in range(9)]
    rows = [(k, [x + rng.randrange(-2, 3) for x in centers[rng.randrange(9)]], labels[max(0, rng.randrange(-1, 3))]) for k in range(300)]
    rows += [rows[40], rows[41], (50, rows[7][1], labels[1]), (300, [0] * 6, labels[0]), (301, [1, 2], labels[0]), (302, [2, 2], labels[1]), (303, [1, 1], labels[0]), (-10, rows[3][1], labels[2])]
    bad = [(20, None, labels[0]), (30, [1, None, 2, 3, 4, 5], labels[0]), (60, rows[60][1], None), (None, rows[5][1], labels[0])]
    kind = "string" if isinstance(labels[0], str) else "int"
    df = spark.createDataFrame([(*r, 1, 2) for r in rows + bad], f"vec_id long, v array<long>, label {kind}, tile int, row int").repartition(3)
    want = brute(rows, lambda i: i % 10 == 0)
    assert len(want) > 500
    for tile, block in ((2048, 512), (16, 7)):
        assert found(df, F.col("id") % 10 == 0, tile=tile, anchors_a_tile=block) == want
    assert found(df.limit(0), F.col("id") % 10 == 0) == [] == found(df, F.col("id") == -1)
    narrow = brute(rows, lambda i: i % 50 == 0, 2, 3, 50, 70)
    assert narrow and found(df, F.col("id") % 50 == 0, n_positives=2, n_negatives=3, low=50, high=70) == narrow


def test_large_components(spark):
    """Products above 2^53, which doubles would round."""
    rng = random.Random(2)
    rows = [(k, [rng.randrange(1 << 29, 1 << 30) for _ in range(4)], k % 2) for k in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>, label int")
    want = brute(rows, lambda i: i % 4 == 0)
    assert len(want) > 20 and found(df, F.col("id") % 4 == 0, tile=16) == want


def test_nodes_are_skipped(monkeypatch):
    """Bounds hold for every node, and tight clusters leave most leaves unread."""
    monkeypatch.setattr(hn, "LEAF", 32)
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(20, 8)) * 100).astype(np.int64).repeat(40, axis=0) + rng.integers(-2, 3, size=(800, 8))
    row = {"tile": 0, "d": 8, "labels": [0], "ends": [800]}
    tree = hn.CoverTree(x.astype(np.float64))
    own = x[tree.order]
    row |= {"vectors": own.tobytes(), "ids": np.arange(800).tobytes(), "rows": np.arange(800).tobytes(), "centers": x[tree.center].tobytes()}
    row |= {"nodes": np.concatenate([tree.stretch, tree.child], axis=1).tobytes(), "radii": np.concatenate([[tree.most], tree.radius, tree.plain]).tobytes()}
    tile = hn._Tile(row)
    lower, upper = tile.bounds(own[:5].astype(np.float64))
    for k, (lo, hi) in enumerate(tile.stretch):
        products = own[:5] @ own[lo:hi].T
        assert (lower[:, k] <= products.min(axis=1)).all() and (upper[:, k] >= products.max(axis=1)).all()
    assert sorted(tree.order) == list(range(800)) and len(tile.child) >= 10
    read, plain = [], hn._Tile.products
    tile.products = lambda lo, hi, *q: read.append(hi - lo) or plain(tile, lo, hi, *q)
    anchors = hn._Tile({**row, "vectors": own[:1].tobytes(), "ids": b"\xff" * 8, "rows": b"\xff" * 8, "labels": [1], "ends": [1], "nodes": None})
    best = [x[3] for x in hn.best_products(anchors, [tile], [[(-hn.ANY, hn.ANY)]], 10, same=False)]
    assert best == sorted(range(800), key=lambda k: (-int(own[0] @ own[k]), k))[:10] and sum(read) < 400
