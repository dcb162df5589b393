"""Exact search against brute force; the trees' invariants."""

from __future__ import annotations

import random

import numpy as np
import pytest

from millrace.llm import topk
from millrace.llm.queries import op7_topk


def brute(rows, k=10):
    ok = [(i, [int(np.floor(1024.0 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, q in {(i, tuple(v)) for i, v in ok if i % 100 == 0}:
        scores = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in ok if j != i and len(v) == len(q))
        out |= {(i, r, j, -s) for r, (s, j) in enumerate(scores[:k], 1)}
    return out


def _run(spark, at, rows):
    spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, q string").repartition(3).write.parquet(str(at / "embeddings.parquet"))
    return op7_topk(spark, str(at)).collect()


@pytest.mark.parametrize(("n", "d", "kind"), [(1500, 8, "normal"), (900, 3, "clusters"), (700, 4, "ties")])
def test_query(spark, tmp_path, n, d, kind):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, d)).astype(np.float32)
    if kind == "clusters":
        x = (x * 0.01 + rng.normal(size=(12, d))[rng.integers(0, 12, n)]).astype(np.float32)
    if kind == "ties":
        x = rng.integers(-1, 2, (n, d)).astype(np.float32)
        x[: n // 3] = x[0]
    rows = [(int(i), [float(v) for v in r]) for i, r in zip(rng.permutation(n), x, strict=True)]
    got = _run(spark, tmp_path, rows)
    assert {tuple(r) for r in got} == brute(rows) and len(got) == len(brute(rows))


def test_what_takes_no_part(spark, tmp_path):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [0.5, -0.25]), (None, [9.0, 9.0]), (-100, [1.0, 1.0]), (7, [1.0]), (200, [3.0]), (300, [])]
    assert {tuple(r) for r in _run(spark, tmp_path, rows)} == brute(rows)


def test_large_components_stay_exact(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(i, [float(rnd.randint(-(2**20), 2**20)) for _ in range(5)]) for i in range(150)]
    assert {tuple(r) for r in _run(spark, tmp_path, rows)} == brute(rows)


def test_empty_table(spark, tmp_path):
    assert _run(spark, tmp_path, []) == []


def test_blocks_of_queries(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=4)]) for i in range(1200)]
    assert {tuple(r) for r in _run(spark, tmp_path, rows)} == brute(rows)


def test_tree_covers_and_separates():
    x = np.random.default_rng(7).normal(size=(800, 5))
    t = topk.CoverTree.build(x)

    def below(n):
        return np.concatenate([t.points[n], *[below(int(c)) for c in t.children[n]]]).astype(int)

    assert sorted(below(0)) == list(range(800))
    for n in range(len(t.radius)):
        assert np.linalg.norm(x[below(n)] - t.centre[n], axis=1).max() <= t.radius[n] + 1e-6
        kids = t.children[n]
        if kids.size:
            apart = np.linalg.norm(t.centre[kids][:, None] - t.centre[kids][None], axis=2) + np.eye(len(kids)) * 1e9
            assert apart.min() > t.radius[n] / topk.BASE - 1e-6
            assert (t.radius[kids] <= t.radius[n] / topk.BASE + 1e-6).all()


def test_bounds_prune():
    """On clustered data most leaves are never compared."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 6)) * 1000
    x = np.floor(centres[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 6)) * 10)
    ids = np.arange(4000)
    tree = topk.CoverTree.build(x[::100], topk.QUERY_LEAF)
    s = topk.Search(tree, ids[::100], 10)
    seen = []
    compare = s._compare
    s._compare = lambda rows, points, *a: (seen.append(len(rows) * len(points)), compare(rows, points, *a))
    s.see(x.astype(np.int64), ids)
    assert sum(seen) < 0.5 * 40 * 4000


def test_scores_beyond_64_bits(spark, tmp_path):
    """Products that would wrap are exact, and count as the nearest score that fits."""
    rows = [(100, [2.0**40, 1.0]), (1, [2.0**40, 0.0]), (2, [2.0**20, 3.0]), (3, [-(2.0**40), 5.0]), (4, [0.0, 2.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = [(r.vec_id, r.score) for r in sorted(op7_topk(spark, str(tmp_path)).collect(), key=lambda r: r["rank"])]
    top = 2**63 - 1
    want = [(1, top), (2, top), (4, 2 << 20), (3, -top)]
    assert got == want
