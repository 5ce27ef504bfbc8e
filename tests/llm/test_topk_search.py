"""Exact top-k against brute force, over several blocks and both waves."""

import math

import numpy as np
from pyspark.sql import functions as F

from churnscope.llm import topk_search as T

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank int, q int"


def brute(rows, k):
    ints = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, a in ints.items():
        if i % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), j) for j, b in ints.items() if j != i)
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, k=5):
    df = T.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, k)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 100)
    monkeypatch.setattr(T, "QUERIES", 5)
    monkeypatch.setattr(T, "CHUNK", 32)
    rng = np.random.default_rng(0)
    scale = rng.lognormal(0, 1, 700)
    rows = [(i, (scale[i] * rng.normal(size=24) * np.linspace(2, 0.1, 24)).tolist(), 1, None, 2, 3) for i in range(700)]
    rows += [(1000 + i, rows[0][1], 1, None, 2, 3) for i in range(120)]  # ties and copies
    rows += [(2000, None, 1, "", 0, 0), (2050, [1.0, None], 1, "", 0, 0), (2100, [float("nan")], 1, "", 0, 0), (2150, [float("inf"), 1.0], 0, "", 0, 0)]
    rows += [(2200, [], 1, "", 0, 0), (2250, [0.5], 1, "", 0, 0), (None, [1.0] * 24, 1, "", 0, 0), (2300, [3e4] * 24, 1, "", 0, 0)]
    assert run(spark, rows) == brute(rows, 5)


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 0.0], 1, "", 0, 0), (1, [0.5, 0.5], 1, "", 0, 0)]
    assert run(spark, rows) == [(0, 1, 1, 32768)]
    assert run(spark, []) == []


def test_bounds_prune():
    """Short candidates are never multiplied out once the threshold is set."""
    rng = np.random.default_rng(1)
    c = np.floor(rng.normal(size=(4000, 16)) * np.exp(-np.arange(4000) / 400)[:, None] * 1000)
    c = c[np.argsort(-(c**2).sum(1))]
    q = np.floor(rng.normal(size=(8, 16)) * 1000)
    seen = []
    plain = T.exact_products
    T.exact_products = lambda a, b: seen.append(len(a) * len(b)) or plain(a, b)
    try:
        got = T.search_block(np.arange(8), q, q, np.full(8, -np.inf), np.arange(100, 4100), c, c, 5)
    finally:
        T.exact_products = plain
    assert len(got) == 40 and sum(seen) < 8 * 4000 / 2
