"""Top-k search against brute force, and what pruning leaves to do."""

import numpy as np
import pytest

from tablescout.llm import topk


def brute(rows, every, k):
    fine = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    asked = {}
    for i, v in fine:
        if i % every == 0:
            asked.setdefault(i, v)
    out = []
    for q, v in asked.items():
        best = sorted((-dot(v, w), i) for i, w in fine if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def found(spark, rows, **how):
    table = spark.createDataFrame([(i, v, "s", 1, 2) for i, v in rows], "vec_id long, embedding array<double>, score string, cell int, part int")
    return sorted(tuple(r) for r in topk.top_k(table, **how).collect())


def listed(x, first=0):
    return [(first + i, [float(v) for v in row]) for i, row in enumerate(x)]


def test_top_k_against_brute_force(spark):
    r = np.random.default_rng(0)
    x = np.vstack([r.normal(size=(150, 8)) * 0.3, r.normal(size=(250, 8)) * 0.01 + r.normal(size=8)])
    x[7] = x[8]
    x[200:260] = x[200]  # a hot vector
    rows = listed(x) + [(1000, None), (1100, [1.0, None]), (1200, [float("nan")] * 8), (1300, [float("inf")] * 8), (None, [1.0] * 8), (1400, []), (1401, [0.5])]
    want = brute(rows, 10, 10)
    for how in ({"block": 100, "query_block": 16}, {"block": 7, "query_block": 3, "cells": 5}, {}):
        assert found(spark, rows, every=10, **how) == want
    assert found(spark, rows + [(10, rows[10][1]), (11, rows[11][1])], every=10) == brute(rows + [(10, rows[10][1]), (11, rows[11][1])], 10, 10)


def test_few_rows(spark):
    assert found(spark, listed(np.ones((4, 3))), every=2) == brute(listed(np.ones((4, 3))), 2, 10)
    assert found(spark, [(0, [1.0])]) == [] == found(spark, []) == found(spark, [(1, [1.0]), (2, [1.0])], every=7)


def test_large_products_are_exact(spark):
    rows = [(i, [1e5 + i / 1024, -3.0 + i, 7e4]) for i in range(30)]
    assert found(spark, rows, every=5) == brute(rows, 5, 10)
    with pytest.raises(ValueError, match="long"):
        found(spark, [(0, [1e9]), (1, [1e9])])


def sent(spark, monkeypatch, x, every=50):
    """Rows of candidates that reach tasks, and products that are computed."""
    counts, search = [], topk._search
    monkeypatch.setattr(topk, "_search", lambda plan, candidates, *z: counts.append(candidates.join(plan, ["cell", "part"]).count()) or search(plan, candidates, *z))
    got = found(spark, listed(x), every=every, k=5, block=200, query_block=8)
    monkeypatch.undo()
    assert got == brute(listed(x), every, 5)
    return sum(counts)


def test_cells_are_pruned_before_the_shuffle(spark, monkeypatch):
    r = np.random.default_rng(1)
    clustered = lambda n: np.vstack([c + r.normal(size=(100, 6)) * 0.01 for c in r.normal(size=(n, 6)) / 3])
    a, b = (sent(spark, monkeypatch, clustered(n)) for n in (10, 40))
    # all pairs of rows and blocks of queries would be 3,000 and 40,000
    assert a <= 0.5 * 1000 * 3 and b <= 0.5 * 4000 * 10


def test_trees_prune():
    r = np.random.default_rng(1)
    centers = r.normal(size=(30, 16)) * 100
    x = np.vstack([c + r.normal(size=(100, 16)) for c in centers])
    search = topk.DualSearch(x[::50].copy(), np.arange(0, 3000, 50), 5)
    search.add(x, np.arange(3000))
    assert search.products < 0.5 * 60 * 3000
    again = topk.DualSearch(x[::50].copy(), np.arange(0, 3000, 50), 5, floor=np.sort((x[::50] @ x.T).astype(np.int64), axis=1)[:, -6])
    again.add(x, np.arange(3000))
    assert again.products <= search.products
