"""Exact quantiles against NumPy: many groups, ties, nulls, one group with most distinct values, extreme ranges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnscope.operators import quantiles as Q

FRACTIONS = [0.0, 0.1, 0.25, 0.5, 0.65, 0.75, 0.999, 1.0]


def check(spark, rows, columns=("x", "y"), **kw):
    """rows: (group, x, y)."""
    df = spark.createDataFrame(rows, "grp string, x double, y double")
    got = {r.grp: r for r in Q.exact_quantiles(df, {c: FRACTIONS for c in columns}, ["grp"]).collect()}
    want = {}
    for k, name in enumerate(columns, 1):
        for g in {r[0] for r in rows}:
            values = [r[k] for r in rows if r[0] == g and r[k] is not None and r[k] == r[k]]
            if values:
                want.setdefault(g, {})[name] = np.quantile(values, FRACTIONS)
    assert set(got) == set(want)
    for g, own in want.items():
        for name in columns:
            if name in own:
                assert np.allclose(got[g][name], own[name], rtol=1e-12, atol=1e-12), (g, name)
            else:
                assert got[g][name] is None


def test_groups_ties_and_nulls(spark):
    rng = np.random.default_rng(1)
    rows = [(f"g{i % 7}", float(rng.integers(0, 5)), float(rng.normal() * 10.0 ** rng.integers(-3, 4))) for i in range(3000)]
    rows += [(None, 1.0, None), (None, 2.5, float("nan")), ("none", None, None), ("one", -4.0, 0.0)]
    check(spark, rows)


def test_one_group_holds_most_distinct_values(spark, monkeypatch):
    monkeypatch.setattr(Q, "EXACT", 20)
    monkeypatch.setattr(Q, "STEPS", 8)
    passes = []
    cut = Q.cut_lineage
    monkeypatch.setattr(Q, "cut_lineage", lambda df: passes.append(1) or cut(df))
    rng = np.random.default_rng(2)
    values = 1e6 + rng.random(5400)  # all in one first range
    rows = [("hot", float(v), float(-v)) for v in values] + [(f"g{i % 6}", float(i), float(i % 3)) for i in range(600)]
    check(spark, rows)
    assert len(passes) >= 3


def test_extreme_values(spark, monkeypatch):
    monkeypatch.setattr(Q, "EXACT", 3)
    values = [-1.7e308, -1e-300, -0.0, 0.0, 5e-324, 1e-300, 1.0, 1.0000000000000002, 1e308, 1.7e308]
    rows = [("a", v, v / 7) for v in values] * 2
    df = spark.createDataFrame(rows, "grp string, x double, y double")
    got = Q.exact_quantiles(df, {"x": [i / 19 for i in range(20)]}).first().x
    assert got == sorted(values * 2)


def test_without_groups_and_empty(spark):
    df = spark.createDataFrame([(3,), (1,), (None,), (10,)], "v int")
    assert Q.exact_quantiles(df, {"v": [0.5, 0.75]}).collect()[0].v == [3.0, 6.5]
    assert Q.exact_quantiles(df.limit(0), {"v": [0.5]}).collect()[0].v is None
    assert Q.exact_quantiles(df.withColumn("k", df.v % 2), {"v": [0.5]}, ["k"]).where("k = 1").first().v == [2.0]


@pytest.mark.parametrize("by", [[], ["x y"]])
def test_odd_names_and_expressions(spark, by):
    df = spark.createDataFrame([(i, "a") for i in range(5)], "`a.b` int, `x y` string").withColumn("c", F.lit("clash")).withColumn("g", F.lit(1))
    row = Q.exact_quantiles(df, {"a.b": [0.5], "twice": (F.col("`a.b`") * 2, [0.25])}, by).first()
    assert row["a.b"] == [2.0] and row["twice"] == [2.0]


def test_lazy_group_quantile(spark):
    rng = np.random.default_rng(6)
    rows = [("hot", float(v)) for v in rng.normal(size=3000)] + [(f"g{i % 5}", float(i % 7)) for i in range(200)] + [(None, 2.0), (None, 5.0), ("n", None), ("m", float("nan")), ("m", -1.0)]
    df = spark.createDataFrame(rows, "grp string, x double").withColumn("__own", F.lit(1))
    for f in (0.0, 0.3, 0.5, 1.0):
        got = {r.grp: r.q for r in Q.group_quantile(df, "x", "grp", f, "q").collect()}
        want = {}
        for g, v in rows:
            if v is not None and v == v:
                want.setdefault(g, []).append(v)
        assert set(got) == set(want) and all(abs(got[g] - np.quantile(want[g], f)) < 1e-12 for g in want)
    # a plan that doesn't read the quantile doesn't compute it
    joined = df.join(Q.group_quantile(df, "x", "grp", 0.5, "q"), "grp", "left").select("grp", "x")
    assert "Join" not in joined._jdf.queryExecution().optimizedPlan().toString()
