"""Search for blend weights (L13): every weight triple scored by AUC and its own best threshold.

Equal predictions are summed up once, and that table is read a few times.  A pass blends each of its rows with all weights (231
triples, then 25 at most) and counts by weight and range of the blended value, with partial sums, so that what is written is
bounded by the weights and ranges, not by the predictions.  The ranges are cut at the fixed thresholds, so their counts give the
coarse sweep; a second pass counts the fine thresholds of each weight.  Values are ranked in two cases only: in the ranges that hold a
weight's prevalence quantile, and for weights whose score can still be the best.  For that, the ranges bound each weight's AUC from
both sides (pairs inside a range count as none or all), and weights are ranked in batches, highest bound first, until no bound
reaches the best score.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .evaluation import COARSE_GRID, FIXED_EXTRA, TIE, metrics_from_counts, np_arange

# FIXED VALUES: grid steps, the least dominant weight, the score's weights and penalties, the target rate's rule
STEPS = (0.05, 0.02)
LEAST_DOMINANT = 0.35
SCORE = {"auc": 0.30, "f1": 0.38, "recall": 0.20, "acc": 0.07, "precision": 0.05}
RATE_GAP = 0.07
PENALTIES = ((0.05, 0.35), (0.04, 0.45), (0.04, 0.20))  # first weight above, second below, third above
RANGES, BATCH = 1024, 16


def weight_grid(step: float, centre: tuple[float, float] | None = None) -> list[tuple[float, float, float]]:
    """Weight triples that sum to 1, in order: the whole grid, or that around ``centre``."""
    if centre is None:
        first = second = np_arange(0.0, 1.0001, step)
    else:
        first, second = (np_arange(max(0.0, c - step * 2), min(1.0, c + step * 2) + 0.0001, step) for c in centre)
    triples = [(a, b, round(1.0 - a - b, 10)) for a in first for b in second]
    return [t for t in triples if 0 <= t[2] <= 1 and max(t) >= LEAST_DOMINANT]


def _collapsed(df: DataFrame, y: str, probs: Sequence[str]) -> DataFrame:
    """(p0, p1, p2, pos, neg, n): the distinct predictions with their classes."""
    hit = F.col(y) == 1
    keys = [F.col(c).cast("double").alias(f"p{i}") for i, c in enumerate(probs)]
    return cut_lineage(df.groupBy(*keys).agg(F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg"), F.count(F.lit(1)).alias("n")))


def _blends(rows: DataFrame, grid: Sequence[tuple[float, float, float]], only: Sequence[int] | None = None) -> DataFrame:
    """(w, b, pos, neg, r, step): each row with all weights (or those of the numbers ``only``), its range and the number of fixed thresholds reached."""
    numbers = range(len(grid)) if only is None else only
    every = F.array(*[F.struct(F.lit(i).alias("w"), *[F.lit(x).alias(f"g{k}") for k, x in enumerate(grid[i])]) for i in numbers])  # one literal
    b = F.col("p0") * F.col("g0") + F.col("p1") * F.col("g1") + F.col("p2") * F.col("g2")
    g = rows.select("p0", "p1", "p2", "pos", "neg", F.inline(every)).select("w", b.alias("b"), "pos", "neg").where("b is not null")
    return g.withColumns({"r": F.floor(F.col("b") * RANGES), "step": _reached([F.lit(t) for t in _fixed()])})


def _fixed() -> list[float]:
    return sorted([*np_arange(*COARSE_GRID), *FIXED_EXTRA])


def _reached(thresholds: Sequence[Column]) -> Column:
    """How many of the ascending thresholds ``b`` reaches; null ones are never reached."""
    return reduce(add, [F.when(F.col("b") >= t, 1).otherwise(0) for t in thresholds])


def _values(blends: DataFrame, cells: DataFrame) -> DataFrame:
    """(w, b, pos, neg, above, over): the distinct values in ``cells`` (few: they are broadcast), the positives above each and all above."""
    g = blends.join(F.broadcast(cells.select("w", "r", "step", "up", "un")), ["w", "r", "step"])
    g = g.groupBy("w", "r", "step", "b").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.first("up").alias("up"), F.first("un").alias("un"))
    inner = Window.partitionBy("w", "r", "step").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    at = lambda c, u: F.col(u) + F.coalesce(F.sum(c).over(inner), F.lit(0))
    return g.select("w", "b", "pos", "neg", at("pos", "up").alias("above"), (at("pos", "up") + at("neg", "un")).alias("over"))


def _sweep(counts: DataFrame, thresholds: Sequence[Column]) -> DataFrame:
    """(w, t, tp, pp): counts at each weight's ascending thresholds, from rows (w, step, pos, neg) by number of thresholds reached."""
    at = lambda c, k: F.sum(F.when(F.col("step") > k, c).otherwise(0))
    rows = counts.groupBy("w").agg(*[a for k, t in enumerate(thresholds) for a in (
        at(F.col("pos"), k).alias(f"tp{k}"), at(F.col("pos") + F.col("neg"), k).alias(f"pp{k}"), F.first(t).alias(f"t{k}"))])
    each = F.array(*[F.struct(F.col(f"t{k}").alias("t"), F.col(f"tp{k}").alias("tp"), F.col(f"pp{k}").alias("pp")) for k in range(len(thresholds))])
    return rows.select("w", F.inline(each))


def _rated(c: DataFrame, whole: dict, stage: int) -> DataFrame:
    """The metrics and the threshold's score of rows (w, t, tp, pp); null thresholds are left out."""
    c = c.where("t is not null").withColumns(metrics_from_counts(F.col("tp"), F.col("pp"), F.lit(whole["P"]), F.lit(whole["n"])))
    return c.withColumns({"stage": F.lit(stage), "s": 0.56 * F.col("f1") + 0.22 * F.col("recall") + 0.12 * F.col("acc") + 0.10 * F.col("precision")
                          - 0.10 * F.abs(F.col("pred_positive_rate") - whole["target"]) - 0.04 * F.greatest(F.col("t") - 0.62, F.lit(0.0))})


def _best_threshold(c: DataFrame) -> DataFrame:
    """Each weight's threshold: highest score, highest recall (both within TIE), nearest to .55, earliest."""
    own = Window.partitionBy("w")
    c = c.withColumn("top", F.max("s").over(own)).where(F.col("s") >= F.col("top") - TIE)
    c = c.withColumn("top", F.max("recall").over(own)).where(F.col("recall") >= F.col("top") - TIE)
    first = Window.partitionBy("w").orderBy(F.abs(F.col("t") - 0.55), "stage", "t")
    return c.withColumn("top", F.row_number().over(first)).where("top = 1").drop("top")


def _score(auc: Column, whole: dict) -> Column:
    """The composite score of a weight with the given AUC; it never falls when the AUC rises."""
    (ca, la), (cb, lb), (cc, lc) = PENALTIES
    zero = F.lit(0.0)
    penalty = ca * F.greatest(F.col("w_a") - la, zero) + cc * F.greatest(F.col("w_c") - lc, zero) + cb * F.greatest(lb - F.col("w_b"), zero)
    parts = (auc if k == "auc" else F.col(k) for k in SCORE)
    return sum((part * v for part, v in zip(parts, SCORE.values())), zero) - RATE_GAP * F.abs(F.col("pred_positive_rate") - F.lit(whole["P"]) / F.lit(whole["n"])) - penalty


def _quantile(blends: DataFrame, cells: DataFrame, whole: dict) -> DataFrame:
    """(w, t, tp, pp): each weight's quantile at 1 - target, between two ranks, and the counts at it."""
    h = (1.0 - whole["target"]) * (whole["n"] - 1)
    first, second = F.floor(F.lit(h)), F.ceil(F.lit(h))

    def holds(i: Column, above: str) -> Column:
        below = F.lit(whole["n"]) - F.col(above) - F.col("pos") - F.col("neg")
        return (below <= i) & (i < below + F.col("pos") + F.col("neg"))

    marked = cells.withColumn("over", F.col("up") + F.col("un")).where(holds(first, "over") | holds(second, "over"))  # two a weight at most
    at = lambda i, c: F.max(F.when(holds(i, "over"), c))
    tp, pp = F.col("above") + F.col("pos"), F.col("over") + F.col("pos") + F.col("neg")
    per = _values(blends, marked).groupBy("w").agg(*[at(i, c).alias(f"{name}{k}") for k, i in enumerate((first, second)) for name, c in (("x", F.col("b")), ("tp", tp), ("pp", pp))])
    per = per.withColumn("t", F.col("x0") + (F.lit(h) - first) * (F.col("x1") - F.col("x0")))
    # no value lies between the two ranks
    return per.select("w", "t", *[F.when(F.col("t") <= F.col("x0"), F.col(f"{c}0")).otherwise(F.col(f"{c}1")).alias(c) for c in ("tp", "pp")])


def _scored(rows: DataFrame, whole: dict, grid: Sequence[tuple[float, float, float]], stage: int, best: float = -math.inf) -> DataFrame:
    """One row for each weight that can be the first or within TIE of it, ``best`` being a score reached before: its threshold, metrics and score."""
    blends = _blends(rows, grid)
    up = Window.partitionBy("w").orderBy(F.desc("r"), F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    cells = blends.groupBy("w", "r", "step").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    cells = cut_lineage(cells.withColumns({"up": F.coalesce(F.sum("pos").over(up), F.lit(0)), "un": F.coalesce(F.sum("neg").over(up), F.lit(0))}))
    coarse = _sweep(cells, [F.lit(t) for t in _fixed()]).unionByName(_quantile(blends, cells, whole))
    one = cut_lineage(_best_threshold(_rated(coarse, whole, 0)))
    start, stop = F.greatest(F.col("t") - 0.05, F.lit(0.10)), F.least(F.col("t") + 0.05, F.lit(0.75)) + 0.0001
    near = one.select("w", start.alias("fs"), F.ceil((stop - start) / 0.005).alias("steps"))
    fine = [F.when(F.lit(i) < F.col("steps"), F.col("fs") + i * ((F.col("fs") + 0.005) - F.col("fs"))) for i in range(21)]
    counts = blends.drop("step").join(F.broadcast(near), "w").groupBy("w", "fs", "steps", _reached(fine).alias("step")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    two = _rated(_sweep(counts, fine), whole, 1)
    pairs = F.lit(float(whole["P"])) * F.lit(whole["n"] - whole["P"])
    auc = lambda u: u / pairs
    bounds = cells.groupBy("w").agg(F.sum(F.col("neg") * F.col("up").cast("double")).alias("least"), F.sum(F.col("neg") * (F.col("up") + F.col("pos")).cast("double")).alias("most"))
    spark = rows.sparkSession
    names = spark.createDataFrame([(i, *t, stage * 1000 + i) for i, t in enumerate(grid)], "w int, w_a double, w_b double, w_c double, ord int")
    # a row for each weight
    each = cut_lineage(_best_threshold(one.unionByName(two)).join(F.broadcast(bounds), "w").join(F.broadcast(names), "w"))
    left = [(r.most, r.least, r.w) for r in each.select("w", _score(auc(F.col("least")), whole).alias("least"), _score(auc(F.col("most")), whole).alias("most")).collect()]
    left.sort(reverse=True)
    best = max([best, *(least for _, least, _ in left)])
    exact = []
    while left and left[0][0] >= best - TIE:
        batch, left = [w for most, _, w in left[:BATCH] if most >= best - TIE], left[BATCH:]
        ranked = _values(_blends(rows, grid, batch), cells.where(F.col("w").isin(batch)))
        u = ranked.groupBy("w").agg(F.sum(F.col("neg") * (F.col("above") + 0.5 * F.col("pos"))).alias("u"))
        got = each.join(F.broadcast(u.select("w", auc(F.col("u")).alias("auc"))), "w").withColumn("score", _score(F.col("auc"), whole)).select("w", "auc", "score").collect()
        exact += [(r.w, r.auc) for r in got]
        best = max([best, *(r.score for r in got)])
    known = spark.createDataFrame(exact, "w int, auc double")
    return each.join(F.broadcast(known), "w").withColumn("score", _score(F.col("auc"), whole)).select("ord", "w_a", "w_b", "w_c", F.col("t").alias("threshold"), "auc", "acc", "precision", "recall", "f1", "pred_positive_rate", "score")


def _first_best(c: DataFrame) -> DataFrame:
    top = c.withColumn("top", F.max("score").over(Window.partitionBy(F.lit(0)))).where(F.col("score") >= F.col("top") - TIE)
    return top.orderBy("ord").limit(1).drop("top")


def blend_grid(df: DataFrame, y: str = "y", probs: Sequence[str] = ("p_a", "p_b", "p_c")) -> DataFrame:
    """The best weights, their threshold, metrics and score: one row.

    The whole grid in steps of STEPS[0], then the neighbourhood of its best weights in steps of STEPS[1].  The first
    stage's one row comes to the driver to set the second grid.  Without both classes there is no row; a null prediction
    counts in the totals only.
    """
    rows = _collapsed(df, y, probs)
    totals = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("pos"), F.lit(0)).alias("P"))
    whole = totals.withColumn("target", F.least(F.greatest(F.col("P") / F.nullif("n", F.lit(0)) * 1.10, F.lit(0.12)), F.lit(0.30))).first().asDict()
    if not 0 < whole["P"] < whole["n"]:
        return df.sparkSession.createDataFrame([], ", ".join(f"{c} double" for c in ("w_a", "w_b", "w_c", "threshold", "auc", "acc", "precision", "recall", "f1", "pred_positive_rate", "score")))
    first = cut_lineage(_first_best(_scored(rows, whole, weight_grid(STEPS[0]), 0)))
    row = first.first()
    if row is None:
        return first.drop("ord")
    second = _scored(rows, whole, weight_grid(STEPS[1], (row["w_a"], row["w_b"])), 1, row["score"])
    return _first_best(first.unionByName(second)).drop("ord")
