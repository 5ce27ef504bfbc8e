"""Attributions of boosted trees: sums equal the model's margin, values equal Shapley values by definition."""

from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from churnscope.operators import attributions as A
from churnscope.operators import learners as L


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        x, z, k, g = float(rng.normal()), float(rng.integers(0, 5)), ["a", "b", "c"][int(rng.integers(0, 3))], ["u", "v"][int(rng.integers(0, 2))]
        p = 1 / (1 + np.exp(-(1.5 * x - z + 2 * (k == "b") + (g == "u") * x)))
        rows.append((i, int(rng.random() < p), x, z, k, g))
    df = spark.createDataFrame(rows, f"EmployeeNumber long, {L.LABEL} int, x double, z double, kind string, grp string")
    tr, te, _ = L.encoded(df, df, ["x", "z"], ["kind", "grp"])
    model = L.boosted(maxIter=12, maxDepth=4, minInstancesPerNode=5, stepSize=0.2).fit(tr)
    return model, te, L.encoded_feature_names(te)


def test_contributions_sum_to_the_margin(spark, fitted):
    model, te, names = fitted
    got = {r.EmployeeNumber: r for r in A.tree_contributions(te, model, names, "EmployeeNumber").collect()}
    raw = {r.EmployeeNumber: r.m for r in model.transform(te).select("EmployeeNumber", vector_to_array("gbt_raw")[1].alias("m")).collect()}
    assert set(got) == set(raw) and len(got) == 400
    for i, r in got.items():
        assert abs(r.margin - raw[i]) < 1e-9
        assert abs(sum(c.value for c in r.contributions) + r.expected_margin - raw[i]) < 1e-9
        assert [c.feature for c in r.contributions] == names


def test_values_are_shapley_values(spark, fitted):
    model, te, names = fitted
    nodes = A.tree_nodes(spark, model).toPandas()
    x = np.array(te.select(vector_to_array("features").alias("f")).limit(6).toPandas()["f"].tolist())
    got = A.explain(A.attribution_tables(A.leaf_paths(A.tree_nodes(spark, model), list(model.treeWeights))), x)

    def value(tree, row, known):
        """The tree's value when only the features ``known`` are: the others' splits are taken by cover."""
        own = nodes[nodes["tree"] == tree].set_index("id")

        def walk(i):
            n = own.loc[i]
            if n.left < 0:
                return n.value
            if n.feature in known:
                return walk(int(n.left if row[int(n.feature)] <= n.threshold else n.right))
            return sum(walk(int(c)) * own.loc[int(c)].cover for c in (n.left, n.right)) / n.cover

        return walk(0)

    m = x.shape[1]
    for r, row in enumerate(x[:3]):
        want = np.zeros(m)
        for tree, weight in enumerate(model.treeWeights):
            used = sorted(set(nodes[(nodes["tree"] == tree) & (nodes["left"] >= 0)]["feature"]))
            for i in used:
                rest = [j for j in used if j != i]
                for size in range(len(used)):
                    w = factorial(size) * factorial(len(used) - size - 1) / factorial(len(used))
                    for s in combinations(rest, size):
                        want[i] += weight * w * (value(tree, row, {*s, i}) - value(tree, row, set(s)))
        assert np.allclose(got[r], want, atol=1e-9)


def test_importance_of_slots(spark, fitted):
    model, _, names = fitted
    rows = A.gain_importance(spark, model, names).collect()
    assert [r.feature for r in sorted(rows, key=lambda r: names.index(r.feature))] == names
    assert abs(sum(r.importance for r in rows) - 1) < 1e-9 and all(r.importance >= 0 for r in rows)
    assert max(rows, key=lambda r: r.importance).feature in ("x", "z")


def test_tree_without_splits():
    t = A.attribution_tables(pd.DataFrame([("0.0", -1, -np.inf, np.inf, 1.0, 0.25)], columns=["leaf", "feature", "lo", "hi", "share", "value"]))
    assert t["expected"] == 0.25 and A.explain(t, np.ones((3, 2))).tolist() == [[0, 0]] * 3


def test_top3_from_contributions(spark, fitted):
    from churnscope.operators import ranking as R

    model, te, names = fitted
    rows = R.top3_drivers(A.tree_contributions(te, model, names, "EmployeeNumber")).where(F.col("EmployeeNumber") < 5).collect()
    assert len(rows) == 5 and all(r.top3_drivers.count("(") == 3 for r in rows)
