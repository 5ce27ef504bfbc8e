"""Co-moment correlations against pandas on columns with missing, constant and far-off values."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from churnscope.operators import correlation as C

NAMES = ["a", "b", "c", "d", "e"]
SCHEMA = "Attrition string, " + ", ".join(f"{c} double" for c in NAMES)


def _rows(n=400):
    rnd = random.Random(5)
    out = []
    for _ in range(n):
        a = rnd.gauss(0, 1)
        b = 1e9 + a + rnd.gauss(0, 1)  # far from zero: plain sums of squares would lose it
        row = [a, b, 0.1, a * a, float(rnd.randrange(3))]
        out.append(("Yes" if a > 0.5 else "No", *[None if rnd.random() < 0.2 else v for v in row]))
    return out


def test_matrix_equals_pandas(spark):
    rows = _rows()
    got = {(r.row_feature, r.col_feature): r.value for r in C.corr_matrix(spark.createDataFrame(rows, SCHEMA), NAMES).collect()}
    frame = pd.DataFrame([r[1:] for r in rows], columns=NAMES, dtype=float)
    for a in NAMES:
        for b in NAMES:
            both = frame[[a, b]].dropna() if a != b else frame[[a]].dropna()
            x, y = both[a].to_numpy(), both[b].to_numpy()
            want = 0.0 if "c" in (a, b) else np.corrcoef(x - x.mean(), y - y.mean())[0, 1]
            assert got[a, b] == pytest.approx(want, abs=5.1e-4)


def test_coefficients_are_exact_to_many_digits(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA)
    found = C.comoments(df, [F.col(c) for c in NAMES], [(0, 1), (1, 3), (2, 4)]).collect()
    frame = pd.DataFrame([r[1:] for r in rows], columns=NAMES, dtype=float)
    by = {(r.i, r.j): r for r in found}
    assert by[2, 4].r is None
    for i, j in ((0, 1), (1, 3)):
        both = frame[[NAMES[i], NAMES[j]]].dropna()
        x, y = both.to_numpy().T
        assert by[i, j].n == len(both)
        assert by[i, j].r == pytest.approx(np.corrcoef(x - x.mean(), y - y.mean())[0, 1], abs=1e-9)


def test_pairs_that_never_meet_and_empty_tables(spark):
    rows = [("Yes", 1.0, None, None, None, None), ("No", 2.0, None, None, None, None), ("No", None, 3.0, None, None, None)]
    m = {(r.row_feature, r.col_feature): r.value for r in C.corr_matrix(spark.createDataFrame(rows, SCHEMA), NAMES).collect()}
    assert m["a", "a"] == 1.0 and m["a", "b"] == 0.0 and m["b", "b"] == 0.0 and len(m) == 25
    empty = spark.createDataFrame([], SCHEMA)
    assert {r.value for r in C.corr_matrix(empty, NAMES).collect()} == {0.0}
    assert C.corr_with_target(empty, NAMES).collect() == [] and C.pearson_rank(empty, 10, ["missing"]).collect() == []


def test_target_rows(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA)
    got = C.pearson_rank(df, 10, NAMES).collect()
    assert {r.feature for r in got} == {"a", "b", "d", "e"}  # the constant one is left out
    flag = np.array([r[0] == "Yes" for r in rows], float)
    a = np.array([np.nan if r[1] is None else r[1] for r in rows])
    held = ~np.isnan(a)
    row = next(r for r in got if r.feature == "a")
    assert row.rows_used == held.sum() and row.pearson_r == pytest.approx(np.corrcoef(a[held], flag[held])[0, 1], abs=1e-6)
    assert [r.feature for r in C.corr_with_target(df, NAMES, 2).collect()] == [r.feature for r in got[:2]]
