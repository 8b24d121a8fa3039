"""Exact top-k against all inner products."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from docfields.llm import vector_search


def brute(rows, k, step):
    valid = [(i, [math.floor(Fraction(x) * 256) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in valid if i % step == 0}):
        query = min(v for i, v in valid if i == q)
        scores = [(-sum(a * b for a, b in zip(v, query)), i) for i, v in valid if i != q and len(v) == len(query)]
        out += [(q, r + 1, i, max(-2**63, min(2**63 - 1, -s))) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("kind", ["normal", "ties", "clusters"])
def test_best_partners_match_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    x = {"normal": rng.normal(size=(900, 24)) / 5, "ties": rng.integers(-1, 2, (900, 4)) / 256,
         "clusters": rng.normal(size=(9, 24))[rng.integers(0, 9, 900)] + rng.normal(size=(900, 24)) / 20}[kind]
    rows = [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]
    rows += [(10, rows[5][1]), (7, rows[7][1]), (20, [0.5, -0.5]), (21, [0.25, 0.1]), (1000, []), (1020, []), (30, None),
             (31, [None] * 4), (32, [float("nan")] + [0.0] * 23), (40, [float("inf")] * 24), (None, rows[1][1]), (50, [0.0] * 24)]
    df = spark.createDataFrame([(k, "z", v) for k, v in rows], "key bigint, score string, vector array<float>").repartition(5)
    for block in (4096, 17):
        got = vector_search.nearest_vectors(df, F.col("key") % 10 == 0, block=block)
        assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5, 10)
    assert vector_search.nearest_vectors(df.limit(0), F.col("key") % 10 == 0).count() == 0


def test_lists_give_the_best_of_each_query():
    rng = np.random.default_rng(1)
    for size in (20, 1 << 14):
        x = rng.integers(-size, size, (3000, 8))
        x[:10] += 10 * size
        lists = vector_search.SortedLists(np.arange(3000), x)
        queries = np.concatenate(([np.full(8, 3), np.zeros(8, int)], rng.integers(-9, 9, (5, 8)), x[5:7]))
        own = np.array([-1] * 7 + [5, 6])
        for query, o, (keys, scores) in zip(queries, own, lists.top(queries, own, 5, [None] * 9)):
            full = np.where(np.arange(3000) == o, np.iinfo(int).min, x @ query)
            best = np.sort(full)[-5:]
            assert sorted(scores) == best.tolist() and full[keys].tolist() == scores
            want = sorted(np.arange(3000).tolist(), key=lambda i: (-int(full[i]), i))[:5]
            assert sorted(keys.tolist()) == sorted(want)


def test_components_of_any_size(spark):
    rng = np.random.default_rng(5)
    sizes = [1.0, 3e4, 4e4, 1e6, 3e6, 1e9, 1e15, 1e17, 1e30, 1e300, 1.7e308]
    rows = [(1, [1.0, 2.0]), (2, [40000.0, 1.0]), (3, [1.0, 1.0])]
    rows += [(i, [float(rng.normal() * sizes[rng.integers(len(sizes))]) for _ in range(3)]) for i in range(10, 150)]
    rows += [(i, [float(sizes[i % 11]) * s for s in (1, -1, 1)]) for i in range(200, 240)] + [(300, [-1e30] * 3), (301, [1e30] * 3), (302, [1e6, 1e6, -1e6])]
    df = spark.createDataFrame(rows, "key bigint, vector array<double>").repartition(3)
    for step in (1, 7):
        got = vector_search.nearest_vectors(df, F.col("key") % step == 0, block=60)
        assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5, step)
    assert brute(rows[:3], 5, 1)[:2] == [(1, 1, 2, 256 * 40000 * 256 + 512 * 256), (1, 2, 3, 256 * 256 + 512 * 256)]


def test_lists_are_read_only_as_far_as_needed(monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 50, (4000, 6)).astype(float)
    x[[7, 70, 700]] = 1000
    read = []
    best = vector_search.SortedLists._best
    monkeypatch.setattr(vector_search.SortedLists, "_best", lambda self, left, scores, k: read.append(len(left)) or best(self, left, scores, k))
    lists = vector_search.SortedLists(np.arange(4000), x)
    (keys, scores), = lists.top(np.ones((1, 6)), np.array([7]), 2, [None])
    assert sorted(keys.tolist()) == [70, 700] and scores == [6000, 6000] and read == [2]
