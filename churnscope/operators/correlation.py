"""Guarded Pearson correlation, correlation matrix, feature-impact proxy.

Spark's ``corr`` throws on a constant column under ANSI mode (trap T2), so the
coefficient is ``covar_pop / (stddev_pop * stddev_pop)`` over pairwise
not-null rows, NULL when a side is constant.  G1-G3 take all their pairs from one
co-moment matrix (``comoments``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import params as P
from ..functions.numeric import with_scalars


def _num(c: str) -> Column:
    x = F.col(c).try_cast("double")
    return F.when(F.isnan(x), None).otherwise(x)


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: Pearson r over rows where both sides are present; NULL if a side is constant."""
    both = x.isNotNull() & y.isNotNull()
    xx, yy = F.when(both, x), F.when(both, y)
    den = F.stddev_pop(xx) * F.stddev_pop(yy)
    return F.covar_pop(xx, yy) / F.nullif(den, F.lit(0.0))


def _flag() -> Column:
    return F.when(F.col("Attrition") == "Yes", 1.0).otherwise(0.0)


def comoments(df: DataFrame, columns: Sequence[Column], pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """(i, j, n, r): rows with both values and Pearson r (NULL if a side is constant) for the given pairs of columns.

    One masked co-moment matrix: rows are grouped by which columns they hold, and a group keeps plain sums of x, x squared
    and xy, shifted by the columns' means; a pair adds up the groups that hold both.  The groups are the table's
    patterns of missing values.  A pair without any common row has no result row.
    """
    used = sorted({i for pair in pairs for i in pair})
    x = df.select(*[columns[i].cast("double").alias(f"x{i}") for i in used])
    means = x.selectExpr(*[f"coalesce(avg(x{i}), 0.0D) AS m{i}" for i in used])
    every = lambda form: "array(" + ", ".join(form.format(i=i) for i in used) + ")"
    z = with_scalars(x, means).selectExpr(every("x{i} IS NOT NULL") + " AS held", *[f"x{i}" for i in used],
                                          *[f"x{i} - m{i} AS z{i}" for i in used])
    products = ", ".join(f"sum(z{i} * z{j})" for i, j in pairs)
    groups = z.groupBy("held").agg(
        F.expr("count(1) AS n"), F.expr(every("sum(z{i})") + " AS s"), F.expr(every("sum(z{i} * z{i})") + " AS q"),
        F.expr(every("min(x{i})") + " AS lo"), F.expr(every("max(x{i})") + " AS hi"), F.expr(f"array({products}) AS p"))
    # a and b: where the pair's columns stand among those used
    a, b = (", ".join(str(used.index(pair[side])) for pair in pairs) for side in (0, 1))
    rows = groups.selectExpr("*", "posexplode(p) AS (at, xy)").selectExpr("*", f"array({a})[at] AS a", f"array({b})[at] AS b")
    rows = rows.where("held[a] AND held[b]")
    sums = rows.groupBy("a", "b").agg(F.expr("sum(n) AS n"), F.expr("sum(xy) AS xy"), *[
        F.expr(f"{f}({v}[{c}]) AS {v}_{c}") for c in "ab" for f, v in (("sum", "s"), ("sum", "q"), ("min", "lo"), ("max", "hi"))])
    spread = lambda c: f"sqrt(greatest(q_{c} - s_{c} * s_{c} / n, 0.0D))"
    r = f"CASE WHEN lo_a < hi_a AND lo_b < hi_b THEN (xy - s_a * s_b / n) / nullif({spread('a')} * {spread('b')}, 0.0D) END"
    names = "array(" + ", ".join(map(str, used)) + ")"
    return sums.selectExpr(f"{names}[a] AS i", f"{names}[b] AS j", "n", f"{r} AS r")


def _with_target(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, n, r) of each present feature that varies against the attrition flag (E24: NULL and NaN left out)."""
    feats = [c for c in features if c in df.columns]
    if not feats:
        return df.sparkSession.createDataFrame([], "feature string, n long, r double")
    found = comoments(df, [*[_num(c) for c in feats], _flag()], [(i, len(feats)) for i in range(len(feats))])
    names = F.array(*[F.lit(c) for c in feats])
    return found.where(F.col("r").isNotNull() & ~F.isnan("r")).select(F.get(names, F.col("i")).alias("feature"), "n", "r")


def corr_with_target(df: DataFrame, features: Sequence[str] = P.CORR_FEATURES, top_n: int = 10) -> DataFrame:
    """G1: Pearson of each feature with the attrition flag, top-n by |r|, 3 dp.

    NaN coefficients are dropped (R4).
    """
    return (_with_target(df, features).orderBy(F.desc(F.abs("r")), F.asc("feature")).limit(top_n)
            .select("feature", F.round("r", 3).alias("pearson_r")))


def pearson_rank(df: DataFrame, top_n: int = 10, features: Sequence[str] = P.CORR_FEATURES) -> DataFrame:
    """Guarded Pearson rows with direction and strength; top_n clamped to 1..50."""
    top_n = max(1, min(50, int(top_n)))
    rows = _with_target(df, features).where(F.col("n") >= 3)
    a = F.abs("r")
    strength = F.when(a < 0.10, "Very Weak").when(a < 0.30, "Weak").when(a < 0.50, "Moderate").otherwise("Strong")
    direction = F.when(F.col("r") > 0, "Positive").when(F.col("r") < 0, "Negative").otherwise("Neutral")
    out = rows.select("feature", F.round("r", 6).alias("pearson_r"), direction.alias("direction"),
                      strength.alias("strength"), F.col("n").alias("rows_used"))
    return out.orderBy(F.desc(F.abs("pearson_r")), F.asc("feature")).limit(top_n)


def corr_matrix(df: DataFrame, columns: Sequence[str] = P.MATRIX_COLUMNS) -> DataFrame:
    """Pairwise-complete correlation matrix, NaN -> 0, 3 dp, with intensity.

    The upper triangle is one co-moment matrix; the lower triangle mirrors it and the
    diagonal is 1 for a non-constant column (pandas gives NaN -> 0 otherwise).
    """
    cols = [c for c in columns if c in df.columns]
    k = len(cols)
    if not k:
        return df.sparkSession.createDataFrame([], "row_feature string, col_feature string, row_ord int, col_ord int, value double, intensity double")
    found = comoments(df, [_num(c) for c in cols], [(i, j) for i in range(k) for j in range(i, k)])
    # a row for each pair of columns: one map holds them
    at = found.where("r IS NOT NULL AND NOT isnan(r)").selectExpr(f"map_from_entries(collect_list(struct(i * {k} + j, r))) AS at")
    cells = at.selectExpr("at", f"explode(sequence(0, {k * k - 1})) AS c").selectExpr("at", f"CAST(c DIV {k} AS INT) AS i", f"c % {k} AS j")
    cells = cells.selectExpr("i", "j", f"coalesce(try_element_at(at, least(i, j) * {k} + greatest(i, j)), 0.0D) AS v")
    names = F.array(*[F.lit(c) for c in cols])
    return cells.select(F.get(names, F.col("i")).alias("row_feature"), F.get(names, F.col("j")).alias("col_feature"),
                        F.col("i").alias("row_ord"), F.col("j").alias("col_ord"), F.round("v", 3).alias("value"),
                        (F.lit(0.12) + F.lit(0.88) * F.least(F.abs("v"), F.lit(1.0))).alias("intensity"))


def impact_feature_columns(df: DataFrame) -> dict[str, Column]:
    """G4 feature series: one-hot pseudo features plus present numeric columns."""
    feats: dict[str, Column] = {}
    for name in P.IMPACT_FEATURES:
        if name == "OverTime_No":
            if "OverTime" in df.columns:
                feats[name] = F.when(F.col("OverTime").cast("string") == "No", 1.0).otherwise(0.0)
        elif name.startswith("JobRole_"):
            if "JobRole" in df.columns:
                feats[name] = F.when(F.col("JobRole").cast("string") == name[len("JobRole_"):], 1.0).otherwise(0.0)
        elif name in df.columns:
            feats[name] = _num(name)
    return feats


def _impact_long(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per-feature statistics (one aggregate) and the long (row, feature, value) table."""
    feats = impact_feature_columns(df)
    t = F.coalesce(_num("AttritionProb"), F.lit(0.0))
    names = list(feats)
    if not names:
        empty = df.sparkSession.createDataFrame([], "feature string, ord int")
        return empty, empty
    long = df.select(F.col("EmployeeNumber").alias("id"), t.alias("t"), F.inline(F.array(*[
        F.struct(F.lit(n).alias("feature"), F.lit(i).alias("ord"), feats[n].alias("x")) for i, n in enumerate(names)])))
    long = long.where(F.col("x").isNotNull())
    stats = long.groupBy("feature", "ord").agg(
        F.count(F.lit(1)).alias("n"), pearson(F.col("x"), F.col("t")).alias("corr"),
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"),
        F.min("x").alias("xmin"), F.max("x").alias("xmax"))
    stats = stats.where(F.col("n") >= P.IMPACT_MIN_ROWS)
    return stats, long


def feature_impact(df: DataFrame) -> DataFrame:
    """Per-row impact z * corr * 2.6 clipped to +-4.5 and min-max normalised value.

    The per-feature statistics have one row per feature (at most 20: bounded),
    so they are broadcast onto the long table.
    """
    stats, long = _impact_long(df)
    corr = F.coalesce(F.col("corr"), F.lit(0.0))
    z = F.when(F.col("std") > 1e-12, (F.col("x") - F.col("mean")) / F.col("std")).otherwise(F.col("x") * 0.0)
    impact = F.least(F.greatest(z * corr * P.IMPACT_SCALE, F.lit(-P.IMPACT_CLIP)), F.lit(P.IMPACT_CLIP))
    norm = F.when(F.col("xmax") > F.col("xmin"),
                  (F.col("x") - F.col("xmin")) / (F.col("xmax") - F.col("xmin"))).otherwise(0.5)
    return long.join(F.broadcast(stats), ["feature", "ord"]).select(
        "id", "feature", "ord", impact.alias("impact"), norm.alias("norm_value"))


def impact_range(impact: DataFrame) -> DataFrame:
    """G6 over the plotted (sampled) impact points."""
    m = impact.agg(F.max(F.abs("impact")).alias("m"))
    return m.select(F.when(F.col("m").isNull(), 3.0)
                    .otherwise(F.least(F.lit(6.0), F.greatest(F.lit(2.6), F.round(F.col("m") + 0.5, 1))))
                    .alias("x_limit"))
