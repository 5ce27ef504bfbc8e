"""Sorting, top-k, reasons, radar, samples, ranks.

Top-k over the whole table is ``orderBy(...).limit(k)``: Spark plans it as
TakeOrderedAndProject, where every task keeps only its k best rows.
Top-k per group is ``row_number() <= k`` over a window: Spark inserts a
partial WindowGroupLimit before the shuffle, so at most k rows per group and
task are exchanged and no task ever holds a whole (possibly huge) group.
Global 1..N numbering is in ``numbering``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import params as P
from .numbering import global_row_number


def top_at_risk(df: DataFrame, k: int = 50, prob: str = "AttritionProb", key: str = "EmployeeNumber") -> DataFrame:
    """H1: k highest probabilities (ties: lower id first, trap T15)."""
    return df.orderBy(F.desc_nulls_last(prob), F.asc(key)).limit(k)


def warning_reasons(df: DataFrame) -> Column:
    """H2 reasons: first three of five rules, default 'Review recommended'."""
    def num(c, d):
        return F.coalesce(F.col(c).try_cast("double"), F.lit(d)) if c in df.columns else F.lit(d)
    ot = F.col("OverTime").cast("string") == "Yes" if "OverTime" in df.columns else F.lit(False)
    rules = [ot, num("JobSatisfaction", 4.0) <= 2, num("WorkLifeBalance", 4.0) <= 2,
             num("YearsSinceLastPromotion", 0.0) >= 3, num("IncomeCompa", 1.0) < 1.0]
    arr = F.array_compact(F.array(*[F.when(r, F.lit(t)) for r, t in zip(rules, P.WARNING_REASONS)]))
    return F.when(F.size(arr) == 0, F.lit(P.WARNING_DEFAULT)).otherwise(F.array_join(F.slice(arr, 1, 3), ", "))


def early_warning(df: DataFrame, k: int = 3) -> DataFrame:
    """H2: top-k employees with their reasons."""
    top = top_at_risk(df, k)
    return top.select("EmployeeNumber", "Department", "AttritionProb", warning_reasons(top).alias("reasons"))


def filter_workforce(df: DataFrame, dept: str = "All", role: str = "All", risk: str = "All") -> DataFrame:
    """Conjunctive optional equality filters ('All' = no filter); pushed to the scan."""
    if dept != "All":
        df = df.where(F.col("Department") == dept)
    if role != "All":
        df = df.where(F.col("JobRole") == role)
    if risk != "All":
        df = df.where(F.col("RiskLevel") == risk)
    return df


def keyword_search(df: DataFrame, keyword: str, literal: bool = False) -> DataFrame:
    """Case-sensitive regex (or literal) search over id, department and role."""
    keyword = keyword.strip()
    if not keyword:
        return df
    def hit(c):
        s = F.col(c).cast("string")
        return F.coalesce(F.contains(s, F.lit(keyword)) if literal else s.rlike(keyword), F.lit(False))
    return df.where(hit("EmployeeNumber") | hit("Department") | hit("JobRole"))


def employee_list(df: DataFrame, k: int = 200) -> DataFrame:
    """H3: filtered list, k rows by probability, with the filtered total."""
    total = df.select(F.count(F.lit(1))).scalar()
    return top_at_risk(df, k).withColumn("total", total)


def employee_detail(df: DataFrame, filtered: DataFrame, emp: str | None = None) -> DataFrame:
    """Point lookup by id (string compare, as the reference), else the top row of the filter."""
    if emp:
        return df.where(F.col("EmployeeNumber").cast("string") == emp).orderBy("EmployeeNumber").limit(1)
    return top_at_risk(filtered, 1)


def radar_values(df: DataFrame) -> DataFrame:
    """H4: per-row 7-axis radar (single-row rule: one-sided clips, R5), x100, 1 dp."""
    def num(c, d):
        return F.coalesce(F.col(c).try_cast("double"), F.lit(d)) if c in df.columns else F.lit(d)
    sat = F.greatest(F.lit(0.0), (4.0 - num("JobSatisfaction", 3.0)) / 4.0)
    wlb = F.greatest(F.lit(0.0), (4.0 - num("WorkLifeBalance", 3.0)) / 4.0)
    promo = F.least(num("YearsSinceLastPromotion", 0.0) / 6.0, F.lit(1.0))
    pay = F.least(F.greatest(1.0 - num("IncomeCompa", 1.0), F.lit(0.0)), F.lit(1.0))
    dist = F.least(num("DistanceFromHome", 0.0) / 30.0, F.lit(1.0))
    ot = F.when(F.col("OverTime").cast("string") == "Yes", 1.0).otherwise(0.2)
    vals = [num("AttritionProb", 0.0), ot, sat, wlb, promo, pay, dist]
    cells = F.array(*[F.struct(F.lit(i).alias("axis_ord"), F.lit(a).alias("axis"),
                               F.round(v * 100.0, 1).alias("value")) for i, (a, v) in enumerate(zip(P.RADAR_AXES, vals))])
    return df.select("EmployeeNumber", F.inline(cells))


def seeded_order(seed: int, key: str) -> Column:
    """Reproducible pseudo-random order (trap T18): md5 of 'seed:id'."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def stratified_sample(df: DataFrame, by: str, k: int, key: str = "EmployeeNumber", seed: int = 7) -> DataFrame:
    """H5/H6: at most k rows per class, picked by the seeded hash order."""
    w = Window.partitionBy(by).orderBy(seeded_order(seed, key), F.col(key))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def risk_rank(df: DataFrame, prob: str = "probability", key: str = "EmployeeNumber") -> DataFrame:
    """H7: rank 1..N by probability (desc, ties by id), rows without a probability dropped."""
    p = F.col(prob).try_cast("double")
    base = df.where(p.isNotNull() & ~F.isnan(p)).withColumn(prob, p)
    return global_row_number(base, [(prob, True), (key, False)], "risk_rank")


def high_risk_list(df: DataFrame, predicted: str = "predicted", prob: str = "probability",
                   key: str = "EmployeeNumber", fallback_k: int = 30) -> DataFrame:
    """H8: predicted positives, or the top ``fallback_k`` by probability when there are none.

    The branch flag is a scalar subquery (one count), so both branches stay lazy
    and only one produces rows.
    """
    npos = df.select(F.count_if(F.col(predicted) == 1)).scalar()
    pos = df.where(F.col(predicted) == 1)
    fallback = df.orderBy(F.desc(prob), F.asc(key)).limit(fallback_k).where(npos == 0)
    return pos.unionByName(fallback)


def top3_drivers(df: DataFrame, contrib: str = "contributions", key: str = "EmployeeNumber", k: int = 3) -> DataFrame:
    """K largest |contribution| per row formatted 'name(0.000)' joined by '; ' (keyed by id, R1).

    ``contrib`` is an array<struct<feature:string, value:double>> column.
    """
    ranked = F.array_sort(F.col(contrib), lambda a, b: F.when(F.abs(a["value"]) > F.abs(b["value"]), -1)
                          .when(F.abs(a["value"]) < F.abs(b["value"]), 1)
                          .when(a["feature"] < b["feature"], -1).when(a["feature"] > b["feature"], 1).otherwise(0))
    top = F.slice(ranked, 1, k)
    txt = F.array_join(F.transform(top, lambda s: F.format_string("%s(%.3f)", s["feature"], s["value"])), "; ")
    return df.select(key, txt.alias("top3_drivers"))


def cumulative_feature_select(importance: DataFrame, threshold: float = 0.92, min_keep_ratio: float = 0.65,
                              min_keep_floor: int = 12) -> DataFrame:
    """Features kept by cumulative importance share (<= threshold, plus the next one),
    at least max(12, ceil(65 % of all features)).

    ``importance`` has one row per encoded feature (raw_feature, importance); the
    table is as large as the feature count, so the running-sum window is small.
    """
    ranked = importance.groupBy("raw_feature").agg(F.sum("importance").alias("importance"))
    n_all = ranked.select(F.count(F.lit(1))).scalar()
    npos = ranked.select(F.count_if(F.col("importance") > 0)).scalar()
    pool = ranked.where((F.col("importance") > 0) | (npos == 0))
    w = Window.orderBy(F.desc("importance"), F.asc("raw_feature"))
    wcum = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.greatest(F.sum("importance").over(Window.partitionBy(F.lit(1))), F.lit(1e-8))
    pool = (pool.withColumn("pos", F.row_number().over(w))
            .withColumn("cum_ratio", F.sum("importance").over(wcum) / total))
    n_within = pool.select(F.count_if(F.col("cum_ratio") <= threshold)).scalar()
    min_keep = F.least(F.greatest(F.lit(min_keep_floor), F.ceil(n_all * min_keep_ratio)), n_all)
    keep_n = F.greatest(n_within + 1, min_keep)
    return pool.where(F.col("pos") <= keep_n).select("raw_feature", "importance", "pos", "cum_ratio")
