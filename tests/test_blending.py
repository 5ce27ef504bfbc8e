"""The blend search against a plain scan of the same grids."""

import random

import numpy as np
import pytest
from test_evaluation import _brute_auc, _brute_threshold_search, _table

from churnscope.operators import blending as B


def _scores(y, probs, grid):
    rate = np.mean(y)
    for a, b, c in grid:
        p = probs[0] * a + probs[1] * b + probs[2] * c
        m = _table(y, p, [_brute_threshold_search(y, p).t])[0]
        t = np.asarray(p) >= m.t
        tp, pp, pos, n = (t & (y == 1)).sum(), t.sum(), (y == 1).sum(), len(y)
        precision, acc = tp / pp if pp else 0.0, (n - pp - pos + 2 * tp) / n
        penalty = 0.05 * max(a - 0.35, 0) + 0.04 * max(c - 0.20, 0) + 0.04 * max(0.45 - b, 0)
        yield 0.30 * _brute_auc(y, p) + 0.38 * m.f1 + 0.20 * m.recall + 0.07 * acc + 0.05 * precision - 0.07 * abs(pp / n - rate) - penalty


def test_grids():
    whole = B.weight_grid(0.05)
    assert len(whole) == len(set(whole)) and all(abs(sum(t) - 1) < 1e-9 and max(t) >= 0.35 for t in whole)
    assert len(B.weight_grid(0.02, (0.5, 0.3))) <= 25


def test_blend_grid_equals_plain_scan(spark, monkeypatch):
    monkeypatch.setattr(B, "STEPS", (0.25, 0.1))
    rnd = random.Random(3)
    y = np.array([int(rnd.random() < 0.3) for _ in range(250)])
    probs = [np.array([round(min(1, max(0, rnd.gauss(0.5 + d * (v - 0.5), 0.2))), 2) for v in y]) for d in (0.5, 0.2, 0.0)]
    df = spark.createDataFrame([(int(v), *map(float, p)) for v, *p in zip(y, *probs)], "y int, p_a double, p_b double, p_c double")
    got = B.blend_grid(df).first()
    grid = B.weight_grid(0.25)
    first = list(_scores(y, probs, grid))
    near = B.weight_grid(0.1, grid[int(np.argmax(first))][:2])
    every, grid = first + list(_scores(y, probs, near)), grid + near
    best = int(np.argmax(every))
    assert got.score == pytest.approx(every[best], abs=1e-9)
    assert (got.w_a, got.w_b, got.w_c) == pytest.approx(grid[best])


@pytest.mark.parametrize("ranges, batch", [(4, 1), (64, 3)])
def test_blend_grid_with_wide_ranges_and_small_batches(spark, monkeypatch, ranges, batch):
    """Bounds and batches leave out no weight, whatever their width."""
    monkeypatch.setattr(B, "STEPS", (0.25, 0.1))
    rnd = random.Random(11)
    rows = [(int(rnd.random() < 0.3), *(round(rnd.random() ** 2, 2) for _ in range(3))) for _ in range(200)]
    df = spark.createDataFrame(rows * 2, "y int, p_a double, p_b double, p_c double")
    want = B.blend_grid(df).first()
    monkeypatch.setattr(B, "RANGES", ranges)
    monkeypatch.setattr(B, "BATCH", batch)
    assert B.blend_grid(df).first() == want


def test_blend_grid_without_both_classes(spark):
    schema = "y int, p_a double, p_b double, p_c double"
    assert B.blend_grid(spark.createDataFrame([(1, 0.2, 0.4, 0.9)], schema)).collect() == []
    assert B.blend_grid(spark.createDataFrame([], schema)).collect() == []
