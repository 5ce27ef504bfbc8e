"""Binning and histograms with the reference's exact edge rules.

* ``pd.cut`` bins are right-closed; the tenure edges therefore put exactly 1
  year into "<1y" (R13).  Spark's ``Bucketizer`` is left-closed, so buckets are
  ``when`` chains instead.
* ``np.histogram`` uses ``linspace`` edges (0.30000000000000004 ...) and a
  closed last bin (trap T4); the edges are computed in Python exactly like
  NumPy does and compared as double literals.
* Data-driven edges (equal width, quantiles) are computed by one aggregate
  and inlined as a scalar subquery array, then each row looks up its bin with
  array functions: no join and no window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import params as P
from ..functions.numeric import with_scalars
from .quantiles import exact_quantiles


def linspace(lo: float, hi: float, n: int) -> list[float]:
    """NumPy ``linspace(lo, hi, n)`` edge values (step multiplication, exact last edge)."""
    if n == 1:
        return [float(lo)]
    div = n - 1
    step = (hi - lo) / div
    out = [lo + i * step for i in range(n)]
    out[-1] = float(hi)
    return [float(x) for x in out]


def right_closed_bucket(x, edges: Sequence[float], labels: Sequence[str], include_lowest: bool = False) -> Column:
    """Label of the right-closed interval (e[i], e[i+1]] holding x; NULL outside."""
    x = F.col(x) if isinstance(x, str) else x
    expr = None
    for i, lab in enumerate(labels):
        lo, hi = float(edges[i]), float(edges[i + 1])
        cond = ((x >= lo) if (include_lowest and i == 0) else (x > lo)) & (x <= hi)
        expr = F.when(cond, lab) if expr is None else expr.when(cond, lab)
    return expr


def tenure_bucket(c: str = "YearsAtCompany") -> Column:
    """F1 edge rule."""
    return right_closed_bucket(c, P.TENURE_EDGES, P.TENURE_LABELS)


def tenure_buckets(df: DataFrame, col: str = "YearsAtCompany") -> DataFrame:
    """headcount per tenure bucket on the fixed domain, zeros kept, out-of-range dropped."""
    counts = (df.select(tenure_bucket(col).alias("tenure_bucket")).where(F.col("tenure_bucket").isNotNull())
              .groupBy("tenure_bucket").agg(F.count(F.lit(1)).alias("headcount")))
    dom = df.sparkSession.createDataFrame([(lab, i) for i, lab in enumerate(P.TENURE_LABELS)],
                                          "tenure_bucket string, ord int")
    return dom.join(counts, "tenure_bucket", "left").select(
        "tenure_bucket", "ord", F.coalesce("headcount", F.lit(0)).cast("bigint").alias("headcount"))


def _hist_from_edges(df: DataFrame, col: str, edges: Column, nbins: int) -> DataFrame:
    """np.histogram semantics for an edge array column.

    bin = #(edges <= x) - 1, the last edge closed; values outside are dropped.
    ``edges`` is a literal array or a column attached by ``with_scalars``.
    """
    x = F.col(col).cast("double")
    idx = F.size(F.filter(edges, lambda e: e <= x)) - 1
    b = F.when(x.isNull() | F.isnan(x), None).when(x == F.element_at(edges, nbins + 1), nbins - 1) \
        .when((idx >= 0) & (idx < nbins), idx)
    counts = (df.select(b.alias("bin")).where(F.col("bin").isNotNull()).groupBy("bin")
              .agg(F.count(F.lit(1)).alias("n")))
    dom = df.sparkSession.range(nbins).select(F.col("id").cast("int").alias("bin"))
    return dom.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def prob_histogram(df: DataFrame, col: str = "AttritionProb", bins: int = 10) -> DataFrame:
    """fixed [0, 1] histogram with NumPy's edge values (trap T4)."""
    edges = F.array(*[F.lit(e) for e in linspace(0.0, 1.0, bins + 1)])
    out = _hist_from_edges(df, col, edges, bins)
    out = out.withColumn("lower", F.element_at(edges, F.col("bin") + 1)) \
        .withColumn("upper", F.element_at(edges, F.col("bin") + 2))
    return out.withColumn("label", F.format_string("%.1f-%.1f", F.col("lower"), F.col("upper")))


def equal_width_edges(x: Column, bins: int) -> Column:
    """Aggregate: NumPy equal-width edges over [min, max]; a zero range widens to +-0.5."""
    lo0, hi0 = F.min(x), F.max(x)
    lo = F.when(lo0 == hi0, lo0 - 0.5).otherwise(lo0)
    hi = F.when(lo0 == hi0, hi0 + 0.5).otherwise(hi0)
    step = (hi - lo) / bins
    return F.transform(F.sequence(F.lit(0), F.lit(bins)),
                       lambda i: F.when(i == bins, hi).otherwise(lo + i.cast("double") * step))


def prob_histogram_auto(df: DataFrame, col: str = "AttritionProb", bins: int = 30) -> DataFrame:
    """equal-width bins over the data range (np.histogram(x, bins=n)).

    The edges are one aggregate (a scalar subquery array).
    """
    x = F.col(col).cast("double")
    stats = df.where(x.isNotNull() & ~F.isnan(x)).select(equal_width_edges(x, bins).alias("_edges"))
    base = with_scalars(df.select(col), stats)
    out = _hist_from_edges(base, col, F.col("_edges"), bins)
    return with_scalars(out, stats).select(
        "bin", "n", F.element_at("_edges", F.col("bin") + 1).alias("lower"),
        F.element_at("_edges", F.col("bin") + 2).alias("upper"))


def quantile_edges(df: DataFrame, col: str, q: int) -> DataFrame:
    """One row ``_qe``: q+1 exact quantile edges (linear interpolation, trap T6)."""
    return exact_quantiles(df.select(col), {"_qe": (F.col(col), linspace(0.0, 1.0, q + 1))})


def cut_edges(x: Column, q: int) -> Column:
    """Aggregate: ``pd.cut(bins=q)`` edges; the lowest edge is widened by 0.1 % of the range
    (trap T8), a constant column by 0.1 % of its value (0.001 at zero)."""
    lo, hi = F.min(x), F.max(x)
    rng = hi - lo
    const = rng == 0
    cadj = F.when(lo == 0, F.lit(0.001)).otherwise(F.abs(lo) * 0.001)
    clo, chi = lo - cadj, hi + cadj
    plain = F.transform(F.sequence(F.lit(0), F.lit(q)),
                        lambda i: F.when(i == 0, lo - rng * 0.001).when(i == q, hi)
                        .otherwise(lo + i.cast("double") * (rng / q)))
    widened = F.transform(F.sequence(F.lit(0), F.lit(q)),
                          lambda i: F.when(i == q, chi).otherwise(clo + i.cast("double") * ((chi - clo) / q)))
    return F.when(const, widened).otherwise(plain)


def qcut_or_cut(df: DataFrame, col: str, q: int = 10, labels: Sequence[str] | None = None,
                out: str = "bin_label") -> DataFrame:
    """``pd.qcut(q, duplicates='drop')`` with fixed labels, else ``pd.cut(bins=q)``.

    With fixed labels qcut raises as soon as edges collapse (trap T7), so the
    fallback runs exactly when the q+1 quantile edges are not all distinct.
    Both edge sets are one row attached to all; each row then counts the edges below it, so no window is needed.
    """
    labels = list(labels or [f"Q{i}" for i in range(1, q + 1)])
    x = F.col(col).cast("double")
    stats = with_scalars(df.select(cut_edges(x, q).alias("_ce")), quantile_edges(df, col, q))
    df = with_scalars(df, stats.withColumn("_ok", F.size(F.array_distinct("_qe")) == q + 1))
    qidx = F.size(F.filter("_qe", lambda e: e < x))
    qbin = F.when(x == F.element_at("_qe", 1), 1).when((qidx >= 1) & (qidx <= q), qidx)
    cidx = F.size(F.filter("_ce", lambda e: e < x))
    cbin = F.when((cidx >= 1) & (cidx <= q), cidx)
    binno = F.when(x.isNull(), None).when(F.col("_ok"), qbin).otherwise(cbin)
    lab = F.element_at(F.array(*[F.lit(s) for s in labels]), binno)
    return df.withColumn(out, lab).withColumn(f"{out}_ord", binno).drop("_qe", "_ce", "_ok")


def income_decile_trend(df: DataFrame, income: str = "MonthlyIncome", prob: str = "AttritionProb") -> DataFrame:
    """Mean probability per income decile (qcut, equal-width fallback); empty bins kept as NULL."""
    binned = qcut_or_cut(df.select(income, prob), income, 10, out="decile")
    means = (binned.where(F.col("decile").isNotNull()).groupBy("decile", "decile_ord")
             .agg(F.avg(prob).alias("mean_prob")))
    dom = df.sparkSession.createDataFrame([(f"Q{i}", i) for i in range(1, 11)], "decile string, decile_ord int")
    return dom.join(means.drop("decile_ord"), "decile", "left").select("decile", "decile_ord", "mean_prob")


def feature_bands(df: DataFrame) -> DataFrame:
    """TenureBand, CommuteBand, PromotionWaitBand (NULL -> 'Missing')."""
    inf = float("inf")

    def band(c, edges, labels):
        x = F.col(c).cast("double")
        return F.coalesce(right_closed_bucket(x, [-inf, *edges, inf], labels), F.lit("Missing"))
    out = {}
    if "YearsAtCompany" in df.columns:
        out["TenureBand"] = band("YearsAtCompany", [2, 5, 10], ["0-2年", "3-5年", "6-10年", "10年以上"])
    if "DistanceFromHome" in df.columns:
        out["CommuteBand"] = band("DistanceFromHome", [5, 15], ["近距离", "中距离", "远距离"])
    if "YearsSinceLastPromotion" in df.columns:
        out["PromotionWaitBand"] = band("YearsSinceLastPromotion", [1, 3], ["近期晋升", "观察期", "长期未晋升"])
    return df.withColumns(out)
