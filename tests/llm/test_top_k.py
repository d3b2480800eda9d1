"""Dual-tree search against scoring everything."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from tidewatch.llm import top_k as T


def vectors(kind: str, n: int, size: int, seed: int) -> np.ndarray:
    r = np.random.default_rng(seed)
    if kind == "directions":
        x = r.normal(size=(n, size))
        return np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True))
    if kind == "clusters":
        return np.floor(r.normal(size=(9, size))[r.integers(9, size=n)] * 300 + r.normal(size=(n, size)) * 3)
    if kind == "equal":
        return np.repeat(np.floor(r.normal(size=(1, size)) * 256), n, 0)
    return r.integers(-2, 3, size=(n, size)).astype(float)  # ties


def brute(points, ids, k):
    score = points @ points.T
    out = []
    for q in range(len(points)):
        order = [c for c in np.lexsort((ids, -score[q])) if c != q][:k]
        out.append([(score[q, c], ids[c]) for c in order])
    return out


@pytest.mark.parametrize("kind", ["directions", "clusters", "equal", "ties"])
def test_dual_tree(kind):
    """Trees cover their points, and bounds never lose a candidate."""
    for seed, n in enumerate((1, 2, 7, 70, 900)):
        p = vectors(kind, n, 8, seed)
        ids = np.random.default_rng(seed).permutation(n) // 2
        tree = T.CoverTree(p)
        assert sorted(tree.order) == list(range(n))
        for node in range(len(tree.lo)):
            own = p[tree.order[tree.lo[node] : tree.hi[node]]]
            assert np.linalg.norm(own - tree.at[node], axis=1).max() <= tree.radius[node] + 1e-9
            kids = tree.children[node]
            assert not kids or sum(tree.hi[c] - tree.lo[c] for c in kids) == tree.hi[node] - tree.lo[node]
        best = T.dual_tree(p, np.arange(n), np.full(n, -np.inf), p, np.arange(n), ids, 5)
        got = [[(s, ids[r]) for s, r in zip(best.score[q], best.row[q], strict=True)] for q in range(n)]
        assert got == brute(p, ids, 5)


def test_clusters_are_pruned(monkeypatch):
    """Far fewer scores than pairs where there is structure."""
    p, seen = vectors("clusters", 4000, 16, 1), []
    score = T._score
    monkeypatch.setattr(T, "_score", lambda *a: (seen.append(len(a[3]) * len(a[6])), score(*a)))
    T.dual_tree(p, np.arange(4000), np.full(4000, -np.inf), p, np.arange(4000), np.arange(4000), 5)
    assert sum(seen) < 0.25 * 4000 * 4000


def rows_of(spark, table, parts=4):
    return spark.createDataFrame(
        [(i, v, 1, "x") for i, v in table], "vec_id long, embedding array<float>, score int, cell string"
    ).repartition(parts)


def expected(table, modulus=50, k=5):
    ok = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v])
        for i, v in table if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, (i, v) in enumerate(ok):
        if math.fmod(i, modulus):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for c, (j, w) in enumerate(ok) if c != q)  # noqa: B905
        out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_tables(spark, monkeypatch, small):
    """Hot vectors, nulls, NaN, ragged ones, repeated ids, many cells and blocks."""
    if small:
        for name, value in (("ROWS", 40), ("QUERIES", 7), ("SAMPLE", 60)):
            monkeypatch.setattr(T, name, value)
    r = random.Random(5)
    table = [(i, [r.uniform(-1, 1) for _ in range(6)]) for i in range(300)]
    table += [(1000 + i, [0.5] * 6) for i in range(150)]  # a third of all rows
    table += [(2000, None), (2050, [None, 1.0]), (2100, [float("nan")] * 6), (2150, [float("inf")] + [0.0] * 5)]
    table += [(None, [1.0] * 6), (50, [0.9] * 6), (-50, [0.25] * 9), (2200, []), (2250, [0.1])]
    df = rows_of(spark, table)
    got = sorted(tuple(x) for x in T.integer_top_k(df).collect())
    assert got == expected(table)
    assert sorted(tuple(x) for x in T.integer_top_k(df, 7, 3).collect()) == expected(table, 7, 3)


def test_few_and_none(spark):
    assert T.integer_top_k(rows_of(spark, [])).collect() == []
    assert T.integer_top_k(rows_of(spark, [(0, [1.0])])).collect() == []
    assert T.integer_top_k(rows_of(spark, [(1, [1.0]), (2, [2.0])])).collect() == []
    two = [(0, [1.0, -1.0]), (3, [2.0, 0.5])]
    assert sorted(tuple(x) for x in T.integer_top_k(rows_of(spark, two)).collect()) == expected(two)
