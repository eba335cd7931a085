"""Runs of words against brute force, and the query against a plain version of its contract."""

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from quadrille.llm import periodic_runs, queries


def brute(words, least=24):
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 3 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def odd_words(rng):
    k = rng.choice([1, 2, 2, 3, 5, 30])
    words = [rng.randrange(k) for _ in range(rng.choice([0, 5, 30, 100, 200]))]
    for _ in range(rng.randrange(4)):
        unit = [rng.randrange(k) for _ in range(rng.randrange(1, 30))]
        if rng.random() < 0.4:
            unit += unit[:1] * rng.choice([3, 26])
        at = rng.randrange(len(words) + 1)
        words[at:at] = (unit * rng.randrange(1, 9))[: rng.randrange(1, 200)]
        if rng.random() < 0.3:
            words = words * rng.randrange(1, 5)
    return words[:900]


def test_arrays_against_brute_force(monkeypatch):
    rng = random.Random(5)
    for trial in range(150):
        monkeypatch.setattr(periodic_runs, "CANDIDATES", 7 if trial % 3 == 0 else 1 << 20)
        docs, least = [odd_words(rng) for _ in range(rng.randrange(1, 5))], rng.choice([24, 24, 10, 3, 40])
        begin = np.cumsum([0] + [len(d) for d in docs])
        found = periodic_runs.runs_of(np.array(sum(docs, []), dtype=np.int64), begin, least)
        want = [(s + b, s + b + n, q) for b, d in zip(begin[:-1], docs, strict=True) for s, n, q in brute(d, least)]
        assert [tuple(r) for r in found.T.tolist()] == want


def test_rows(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "GROUP_WORDS", 300)
    rng = random.Random(6)
    texts = [" ".join(f"w{w}" for w in odd_words(rng)) for _ in range(25)]
    texts += [None, "", " \n\t ", "ha " * 24, "ha\x0bha\x0cha\r\n" * 8, "ha " * 30, "a\x1cb " * 24, texts[0], "no runs here", "x " * 70_000 + "y z " * 12]
    rows = [(k, t, 0, 0, 0) for k, t in enumerate(texts)] + [(0, texts[0], 0, 0, 0), (None, "b " * 25, 0, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int, id int, collapsed int").repartition(2)
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.find_runs(df).collect()), key=str)
    want = []
    for k, t, *_ in rows:
        words = [w.decode() for w in (t or "").encode().split()]
        runs = brute(words) if len(words) < 2000 else [(0, 70_000, 1), (70_000, 24, 2)]
        want.append((k, len(words), runs, " ".join(collapsed(words, runs))))
    assert got == sorted(want, key=str)
    assert periodic_runs.find_runs(df.limit(0)).count() == 0


def test_best_run(spark):
    lists = [[], [(0, 30, 10), (5, 24, 8), (9, 24, 8)], [(0, 31, 10), (40, 30, 9)], [(3, 1 << 30, 3), (4, (1 << 30) + 1, 3)]]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "k int, runs array<struct<start: long, length: long, period: long>>")
    out = [r.b and tuple(r.b) for r in df.select("k", periodic_runs.longest_by_periods(F.col("runs")).alias("b")).orderBy("k").collect()]
    assert out == [None, (0, 30, 10), (40, 30, 9), (4, (1 << 30) + 1, 3)]


def test_query(spark, tmp_path):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["one", "two", "three", "Four"]) for _ in range(rng.randrange(90))) for _ in range(160)] + [None, "", "  "] * 12 + ["so " * 60]
    ids = [*range(-3, len(texts) - 5), None, 10**15]
    spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want, planted = [], 0
    for k, t in zip(ids, texts, strict=True):
        words = [w.decode() for w in (t or "").encode().split()]
        h, n = zlib.crc32(str(k).encode()) if k is not None else 1, len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p, planted = 1 + (n - a) // (3 + g % 8), planted + 1
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = brute(words)
        best = max(runs, key=lambda r: ((r[1] << 64) // r[2], -r[0], -r[2]), default=(None,) * 3)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        told = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        want.append((k, len(runs), *best, best[1] and best[1] * 1000 // best[2], digest(told), digest(" ".join(collapsed(words, runs)))))
    assert planted > 4
    got = [tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
