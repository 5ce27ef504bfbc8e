"""Model evaluation as relational work.

Everything here takes given label / probability columns, so it is exact and
checkable against SQL.  Design for scale:

* A threshold sweep is ONE conditional aggregate over the predictions
  (``count_if(p >= t_i)`` for every candidate ``t_i``), with map-side partial
  aggregation; the candidate list is a bounded parameter table, never a join.
* The search step that depends on the first sweep (fine grid around the best
  coarse threshold) is a second aggregate whose candidates are columns of a
  one-row table attached by a broadcast constant-key join.
* AUC and stratified ranks use a two-level prefix sum: per-bucket totals (a
  bounded table, 4096 buckets) give each bucket's offset; the rank inside a
  bucket is a window PARTITIONED by bucket.  No un-partitioned window touches
  the data, and a class holding most rows is spread over many buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import with_scalars
from .quantiles import exact_quantiles

N_BUCKETS = 4096


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _div0(num: Column, den: Column) -> Column:
    """Zero division -> 0 (the reference's ``zero_division=0``)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den)


# ------------------------------------------------------------------ L18 ----

def metrics_from_counts(tp: Column, pp: Column, pos: Column, n: Column) -> dict[str, Column]:
    """acc / precision / recall / f1 / predicted-positive rate from confusion counts."""
    fp = pp - tp
    fn = pos - tp
    tn = n - pos - fp
    prec = _div0(tp, pp)
    rec = _div0(tp, pos)
    return {
        "acc": _div0(tp + tn, n),
        "precision": prec,
        "recall": rec,
        "f1": _div0(2 * tp, 2 * tp + fp + fn),
        "pred_positive_rate": _div0(pp, n),
    }


def binary_metrics(df: DataFrame, y: str = "y", p: str = "p", threshold=0.5) -> DataFrame:
    """Metrics at a scalar threshold or a per-row threshold column (one aggregate)."""
    t = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
    pred = _c(p) >= t
    agg = df.agg(F.count_if(pred & (_c(y) == 1)).alias("tp"), F.count_if(pred).alias("pp"),
                 F.count_if(_c(y) == 1).alias("pos"), F.count(F.lit(1)).alias("n"))
    m = metrics_from_counts(F.col("tp"), F.col("pp"), F.col("pos"), F.col("n"))
    return agg.select(*[v.alias(k) for k, v in m.items()])


# ------------------------------------------------------------------ L19 ----

def _bucket_of_unit(x: Column) -> Column:
    """Monotone bucket of a value in [0, 1] (values outside are clipped)."""
    return F.least(F.greatest(F.floor(x * N_BUCKETS), F.lit(0)), F.lit(N_BUCKETS)).cast("int")


def roc_auc(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Tie-aware ROC-AUC (Mann-Whitney with half credit for ties); NULL if one class.

    Scores are grouped first, so a score shared by a third of all rows is one
    row after the map-side combine.  ``neg_below(s)`` is a two-level prefix sum.
    """
    g = df.groupBy(_c(p).alias("s")).agg(F.count_if(_c(y) == 1).alias("pos"),
                                         F.count_if(_c(y) != 1).alias("neg"))
    g = g.withColumn("b", _bucket_of_unit(F.col("s")))
    tot = g.groupBy("b").agg(F.sum("neg").alias("bneg"))  # <= N_BUCKETS + 1 rows
    wb = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select("b", F.coalesce(F.sum("bneg").over(wb), F.lit(0)).alias("off"))
    wi = Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    g = (g.join(F.broadcast(off), "b")
         .withColumn("below", F.col("off") + F.coalesce(F.sum("neg").over(wi), F.lit(0))))
    a = g.agg(F.sum(F.col("pos") * (F.col("below") + 0.5 * F.col("neg"))).alias("u"),
              F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return a.select(F.when((F.col("P") > 0) & (F.col("N") > 0),
                           F.col("u") / (F.col("P").cast("double") * F.col("N"))).alias("auc"))


# ---------------------------------------------------------------- L20/21 ---

def np_arange(start: float, stop: float, step: float) -> list[float]:
    """The exact doubles ``numpy.arange`` yields (start + i * ((start + step) - start))."""
    return [float(v) for v in np.arange(start, stop, step)]


def arange_expr(start: Column, stop: Column, step: float, max_len: int) -> list[tuple[Column, Column]]:
    """``numpy.arange`` with data-dependent bounds as ``max_len`` (value, valid) column pairs."""
    delta = (start + F.lit(step)) - start
    n = F.ceil((stop - start) / F.lit(step))
    return [(start + F.lit(i) * delta, F.lit(i) < n) for i in range(max_len)]


COARSE_GRID = (0.25, 0.701, 0.02)
FIXED_EXTRA = (0.50, 0.55, 0.60)


def _sweep(df: DataFrame, y: str, p: str, cands: Sequence[tuple[Column, Column]], stage: int) -> DataFrame:
    """Counts for every candidate threshold in one aggregate, returned as one row per candidate."""
    aggs = [F.count_if(_c(y) == 1).alias("pos"), F.count(F.lit(1)).alias("n")]
    for i, (t, v) in enumerate(cands):
        # candidates may be columns of an attached one-row table: constant per row, carried by first()
        aggs += [F.count_if((_c(p) >= t) & (_c(y) == 1)).alias(f"tp{i}"), F.count_if(_c(p) >= t).alias(f"pp{i}"),
                 F.first(t).alias(f"t{i}"), F.first(v).alias(f"v{i}")]
    row = df.agg(*aggs)
    structs = F.array(*[F.struct(F.col(f"t{i}").alias("t"), F.col(f"v{i}").alias("valid"), F.col(f"tp{i}").alias("tp"),
                                 F.col(f"pp{i}").alias("pp")) for i in range(len(cands))])
    return (row.select("pos", "n", F.inline(structs)).where("valid").drop("valid")
            .withColumn("stage", F.lit(stage)))


def _score_thresholds(c: DataFrame, target_rate: Column) -> DataFrame:
    m = metrics_from_counts(F.col("tp"), F.col("pp"), F.col("pos"), F.col("n"))
    c = c.withColumns(m)
    score = (0.56 * F.col("f1") + 0.22 * F.col("recall") + 0.12 * F.col("acc") + 0.10 * F.col("precision")
             - 0.10 * F.abs(F.col("pred_positive_rate") - target_rate)
             - 0.04 * F.greatest(F.col("t") - 0.62, F.lit(0.0)))
    return c.withColumn("score", score)


TIE = 1e-12  # FIXED VALUE: scores and recalls this close count as equal


def _best(c: DataFrame) -> DataFrame:
    """The candidate of the highest score; among equals (within TIE) of the highest recall, then the nearest to
    .55, then the first one (coarse before fine, then ascending).  ``c`` has a row for each candidate, 48 at most."""
    everything = Window.partitionBy(F.lit(0))
    c = c.withColumn("__top", F.max("score").over(everything)).where(F.col("score") >= F.col("__top") - TIE)
    c = c.withColumn("__rec", F.max("recall").over(everything)).where(F.col("recall") >= F.col("__rec") - TIE)
    return c.orderBy(F.abs(F.col("t") - 0.55).asc(), F.col("stage").asc(), F.col("t").asc()).limit(1).drop("__top", "__rec")


def threshold_search(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Coarse sweep (+ prevalence quantile, .50, .55, .60), then fine sweep around the best.

    Two aggregates over the predictions; everything else is on <= 48 rows.
    Returns one row: threshold, score, acc, precision, recall, f1, pred_positive_rate.
    """
    stats = df.agg(F.avg(_c(y).cast("double")).alias("rate"))
    stats = stats.select(F.least(F.greatest(F.col("rate") * 1.10, F.lit(0.12)), F.lit(0.30)).alias("target"))
    # prevalence threshold: quantile at the data-dependent fraction 1 - target
    stats = with_scalars(stats, _quantile_at(df, p, 1.0 - F.col("target"), stats))
    data = df.select(_c(y).alias("y"), _c(p).alias("p"))
    cands = [(F.lit(t), F.lit(True)) for t in np_arange(*COARSE_GRID)]
    cands += [(F.col("prev_t"), F.lit(True))] + [(F.lit(t), F.lit(True)) for t in FIXED_EXTRA]
    coarse = with_scalars(_sweep(with_scalars(data, stats.select("prev_t")), "y", "p", cands, 0),
                          stats.select("target"))
    best0 = _best(_score_thresholds(coarse, F.col("target")))
    bounds = best0.select(F.greatest(F.col("t") - 0.05, F.lit(0.10)).alias("fs"),
                          (F.least(F.col("t") + 0.05, F.lit(0.75)) + 0.0001).alias("fe"))
    fine_c = arange_expr(F.col("fs"), F.col("fe"), 0.005, 21)
    fine = with_scalars(_sweep(with_scalars(data, bounds), "y", "p", fine_c, 1), stats.select("target"))
    fine = _score_thresholds(fine, F.col("target"))
    best = _best(best0.unionByName(fine, allowMissingColumns=True))
    return best.select(F.col("t").alias("threshold"), "score", "acc", "precision", "recall", "f1",
                       "pred_positive_rate")


def _quantile_at(df: DataFrame, p: str, frac: Column, stats: DataFrame) -> DataFrame:
    """Linear-interpolated quantile (numpy default) at a data-dependent fraction, as one row ``prev_t``.

    Spark's ``percentile`` wants a constant fraction, so the two order
    statistics around ``frac * (n - 1)`` are fetched by rank: a two-level
    rank over buckets of the (clipped) probability, partitioned by bucket.
    """
    x = df.select(_c(p).alias("x")).where(F.col("x").isNotNull())
    cnt = x.groupBy("x").agg(F.count(F.lit(1)).alias("c"))
    cnt = cnt.withColumn("b", _bucket_of_unit(F.col("x")))
    tot = cnt.groupBy("b").agg(F.sum("c").alias("bc"))
    off = tot.select("b", F.coalesce(F.sum("bc").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)),
                                     F.lit(0)).alias("off"))
    wi = Window.partitionBy("b").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    cnt = cnt.join(F.broadcast(off), "b").withColumn("lo", F.col("off") + F.coalesce(F.sum("c").over(wi), F.lit(0)))
    # rows lo .. lo + c - 1 (0-based) hold value x
    n = x.agg(F.count(F.lit(1)).alias("nn"))
    pos = with_scalars(n, stats.select(frac.alias("frac"))).select(
        (F.col("frac") * (F.col("nn") - 1)).alias("h"))
    pos = pos.select("h", F.floor("h").cast("long").alias("i0"), F.ceil("h").cast("long").alias("i1"))
    z = with_scalars(cnt, pos)
    z = z.agg(F.max(F.when((F.col("lo") <= F.col("i0")) & (F.col("i0") < F.col("lo") + F.col("c")), F.col("x"))).alias("x0"),
              F.max(F.when((F.col("lo") <= F.col("i1")) & (F.col("i1") < F.col("lo") + F.col("c")), F.col("x"))).alias("x1"),
              F.first("h").alias("h"), F.first("i0").alias("i0"))
    return z.select((F.col("x0") + (F.col("h") - F.col("i0")) * (F.col("x1") - F.col("x0"))).alias("prev_t"))


# ------------------------------------------------------------------ L22 ----

SEGMENT_RULES = [  # FIXED VALUES: (column, comparison, cut, fill) in the reference's order
    ("OverTimeFlag", ">=", 1.0, "zero"),
    ("StressLoadScore", ">=", 2.0, "zero"),
    ("SatisfactionIndex", "<=", 2.75, "median"),
    ("PromotionWaitRatio", ">=", 0.45, "zero"),
    ("RoleStagnationRatio", ">=", 0.55, "zero"),
    ("TravelRisk", ">=", 1.5, "zero"),
    ("macro_index", "<", 60.0, "median"),
    ("policy_net_support", "<=", 0.0, "zero"),
]


def risk_segments(df: DataFrame) -> DataFrame:
    """Segment score (rules present in ``df``), high_risk / standard label.

    The score is a sum of 0/1 indicators, so ``#(score >= c)`` for any cut and any quantile are
    read from nine counts; the adaptive cut-off and the one-class fallback are
    then scalar logic on one aggregate row.
    """
    cols = set(df.columns)
    rules = [r for r in SEGMENT_RULES if r[0] in cols]
    med_cols = [c for c, _, _, fill in rules if fill == "median"]
    if med_cols:
        meds = exact_quantiles(df.select(*med_cols), {c: [0.5] for c in med_cols})
        df = with_scalars(df, meds.select(*[F.col(c)[0].alias(f"__med_{c}") for c in med_cols]))
    score = F.lit(0.0)
    for c, op, cut, fill in rules:
        x = F.col(c).cast("double")
        x = F.coalesce(x, F.col(f"__med_{c}") if fill == "median" else F.lit(0.0))
        hit = {">=": x >= cut, "<=": x <= cut, "<": x < cut}[op]
        score = score + F.when(hit, 1.0).otherwise(0.0)
    df = df.withColumn("segment_score", score).drop(*[f"__med_{c}" for c in med_cols])
    k = len(rules)
    st = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("segment_score") >= i).alias(f"ge{i}") for i in range(k + 2)])
    ge = F.array(*[F.col(f"ge{i}") for i in range(k + 2)])

    def quantile(f: float) -> Column:  # a score's rank is the number of smaller scores
        at = F.lit(f) * (F.col("n") - 1)
        low, high = (sum((F.when(F.col("n") - F.col(f"ge{i}") <= r, 1.0).otherwise(0.0) for i in range(1, k + 1)), F.lit(0.0)) for r in (F.floor(at), F.ceil(at)))
        return low + (at - F.floor(at)) * (high - low)
    st = st.withColumns({"q65": quantile(0.65), "q50": quantile(0.5)})

    def count_ge(cut: Column) -> Column:  # integer-valued score
        return F.element_at(ge, F.least(F.greatest(F.ceil(cut), F.lit(0)), F.lit(k + 1)).cast("int") + 1)
    share = F.col("ge2") / F.col("n")
    cut1 = F.when((share < 0.15) | (share > 0.60), F.greatest(F.col("q65"), F.lit(1.0))).otherwise(F.lit(2.0))
    st = st.withColumn("cut1", cut1)
    n_hi = count_ge(F.col("cut1"))
    st = st.select(F.when((n_hi == 0) | (n_hi == F.col("n")), F.col("q50")).otherwise(F.col("cut1"))
                   .alias("__cut"))
    out = with_scalars(df, st)
    return out.withColumn("segment", F.when(F.col("segment_score") >= F.col("__cut"), "high_risk")
                          .otherwise("standard")).drop("__cut")


# ------------------------------------------------------------------ L23 ----

def segment_grid(base: float) -> tuple[list[float], list[float]]:
    """Candidate high / standard thresholds around a (parameter) base threshold."""
    hi = np_arange(max(0.20, base - 0.18), min(0.75, base + 0.02) + 0.0001, 0.02)
    std = np_arange(max(0.35, base - 0.02), min(0.90, base + 0.16) + 0.0001, 0.02)
    return hi, std


def segment_thresholds(df: DataFrame, base: float, y: str = "y", p: str = "p",
                       segment: str = "segment") -> DataFrame:
    """Best (high, standard) threshold pair with guards; else the global config.

    One aggregate gives per-segment counts at every candidate; pairs are then
    combined on a <= 110-row table.  Returns one row:
    type, base_threshold, high_risk, standard, high_risk_share, acc, precision, recall, f1, pred_positive_rate.
    """
    hi, std = segment_grid(base)
    h = F.col(segment) == "high_risk"
    yy = _c(y) == 1
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(h).alias("n_hi"), F.count_if(yy).alias("pos"),
            F.count_if(h & yy).alias("pos_hi"),
            F.count_if(yy & (_c(p) >= base)).alias("tp_base"), F.count_if(_c(p) >= base).alias("pp_base")]
    for i, t in enumerate(hi):
        aggs += [F.count_if(h & yy & (_c(p) >= t)).alias(f"htp{i}"), F.count_if(h & (_c(p) >= t)).alias(f"hpp{i}")]
    for j, t in enumerate(std):
        aggs += [F.count_if(~h & yy & (_c(p) >= t)).alias(f"stp{j}"), F.count_if(~h & (_c(p) >= t)).alias(f"spp{j}")]
    row = df.agg(*aggs)
    pairs = [F.struct(F.lit(i * 1000 + j).alias("ord"), F.lit(th).alias("th"), F.lit(ts).alias("ts"),
                      (F.col(f"htp{i}") + F.col(f"stp{j}")).alias("tp"),
                      (F.col(f"hpp{i}") + F.col(f"spp{j}")).alias("pp"))
             for i, th in enumerate(hi) for j, ts in enumerate(std) if th <= ts]
    n, n_hi = F.col("n"), F.col("n_hi")
    guard_min = F.greatest(F.lit(30), F.floor(0.12 * n).cast("long"))
    ok = ((n_hi >= guard_min) & (n - n_hi >= guard_min) & (F.col("pos_hi") >= 8)
          & (F.col("pos") - F.col("pos_hi") >= 8) & F.lit(len(pairs) > 0))
    base_cols = row.select("n", "n_hi", "pos", "tp_base", "pp_base", ok.alias("ok"))
    if pairs:
        c = row.select("n", "n_hi", "pos", F.inline(F.array(*pairs)))
        c = c.withColumns(metrics_from_counts(F.col("tp"), F.col("pp"), F.col("pos"), F.col("n")))
        score = (0.64 * F.col("f1") + 0.18 * F.col("recall") + 0.10 * F.col("acc") + 0.08 * F.col("precision")
                 - 0.03 * F.abs(F.col("pred_positive_rate") - F.col("pos") / F.col("n"))
                 - 0.02 * F.greatest(F.col("ts") - F.col("th") - 0.18, F.lit(0.0)))
        c = c.withColumn("score", score).withColumn("__top", F.max("score").over(Window.partitionBy(F.lit(0))))
        best = (c.where(F.col("score") >= F.col("__top") - TIE).orderBy("ord").limit(1)
                .select("th", "ts", "acc", "precision", "recall", "f1", "pred_positive_rate"))
        base_cols = with_scalars(base_cols, best)
    gm = metrics_from_counts(F.col("tp_base"), F.col("pp_base"), F.col("pos"), F.col("n"))
    seg = F.col("ok")
    return base_cols.select(
        F.when(seg, "segment").otherwise("global").alias("type"),
        F.lit(float(base)).alias("base_threshold"),
        F.when(seg, F.col("th")).alias("high_risk"),
        F.when(seg, F.col("ts")).alias("standard"),
        F.when(seg, F.col("n_hi") / F.col("n")).alias("high_risk_share"),
        *[F.when(seg, F.col(k)).otherwise(v).alias(k) for k, v in gm.items()])


# ------------------------------------------------------------------ L24 ----

def apply_thresholds(df: DataFrame, config: DataFrame, segment: str = "segment") -> DataFrame:
    """Per-row threshold from a one-row config (segment or global)."""
    cfg = config.select(F.col("type").alias("__type"), F.col("base_threshold").alias("__base"),
                        F.col("high_risk").alias("__hi"), F.col("standard").alias("__std"))
    out = with_scalars(df, cfg)
    t = (F.when(F.col("__type") == "segment",
                F.when(F.col(segment) == "high_risk", F.col("__hi")).otherwise(F.col("__std")))
         .otherwise(F.col("__base")))
    return out.withColumn("threshold", t).drop("__type", "__base", "__hi", "__std")


# ------------------------------------------------------------------ L14 ----

DEFAULT_WEIGHTS = (0.5, 0.3, 0.2)  # FIXED VALUES: initial blend weights (lgb, lr, et)


def meta_features(df: DataFrame, probs: Sequence[str] = ("p_a", "p_b", "p_c"),
                  weights: Sequence[float] = DEFAULT_WEIGHTS) -> DataFrame:
    """Three probabilities, weighted blend, mean, population std, range."""
    ps = [F.col(c).cast("double") for c in probs]
    blend = ps[0] * weights[0] + ps[1] * weights[1] + ps[2] * weights[2]
    mean = (ps[0] + ps[1] + ps[2]) / 3.0
    var = ((ps[0] - mean) ** 2 + (ps[1] - mean) ** 2 + (ps[2] - mean) ** 2) / 3.0
    return df.withColumns({"blend_prob": blend, "mean_prob": mean, "std_prob": F.sqrt(var),
                           "disagreement": F.greatest(*ps) - F.least(*ps)})


# ------------------------------------------------------------------ L17 ----

def platt_apply(df: DataFrame, p: str, coef: float | None, intercept: float | None,
                out: str = "calibrated") -> DataFrame:
    """L17 apply: sigmoid(coef * logit(clip(p, 1e-6, 1 - 1e-6)) + intercept); None = identity."""
    if coef is None or intercept is None:
        return df.withColumn(out, F.col(p).cast("double"))
    x = F.least(F.greatest(F.col(p).cast("double"), F.lit(1e-6)), F.lit(1 - 1e-6))
    z = F.lit(float(coef)) * F.log(x / (1.0 - x)) + F.lit(float(intercept))
    return df.withColumn(out, 1.0 / (1.0 + F.exp(-z)))


def platt_fit(df: DataFrame, y: str, p: str, max_iter: int = 100) -> tuple[float, float]:
    """L17 fit: one-feature logistic regression on the clipped logit (C=1 -> regParam = 1/n)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    x = F.least(F.greatest(F.col(p).cast("double"), F.lit(1e-6)), F.lit(1 - 1e-6))
    d = df.select(F.log(x / (1.0 - x)).alias("logit"), F.col(y).cast("double").alias("label"))
    n = d.count()
    d = VectorAssembler(inputCols=["logit"], outputCol="features").transform(d)
    m = LogisticRegression(regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False,
                           maxIter=max_iter).fit(d)
    return float(m.coefficients[0]), float(m.intercept)


# -------------------------------------------------------------- L5-L7 ------

def class_weights(df: DataFrame, y: str = "y") -> DataFrame:
    """scale_pos_weight = max(neg,1)/max(pos,1); balanced weights n / (2 max(n_c,1))."""
    a = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(_c(y) == 1).alias("pos"), F.count_if(_c(y) == 0).alias("neg"))
    return a.select("n", "pos", "neg",
                    (F.greatest("neg", F.lit(1)) / F.greatest("pos", F.lit(1))).alias("scale_pos_weight"),
                    (F.col("n") / (2.0 * F.greatest("neg", F.lit(1)))).alias("weight_neg"),
                    (F.col("n") / (2.0 * F.greatest("pos", F.lit(1)))).alias("weight_pos"))


def _order_key(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def class_rank(df: DataFrame, y: str, key: str, seed: int) -> DataFrame:
    """1-based rank of each row inside its class by md5(seed:key) (+ class size ``n_class``).

    Two-level: (class, 3-hex-digit prefix) bucket counts -> offsets (<= 2 x 4096
    rows) -> row_number within each (class, bucket).  A class with most rows is
    spread over 4096 tasks' worth of buckets instead of one window partition.
    """
    d = df.withColumn("__h", _order_key(key, seed)).withColumn("__b", F.substring("__h", 1, 3))
    tot = d.groupBy(y, "__b").agg(F.count(F.lit(1)).alias("__bc"))
    w = Window.partitionBy(y).orderBy("__b")
    off = tot.select(y, "__b",
                     F.coalesce(F.sum("__bc").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"),
                     F.sum("__bc").over(Window.partitionBy(y)).alias("n_class"))
    d = d.join(F.broadcast(off), [y, "__b"])
    wi = Window.partitionBy(y, "__b").orderBy("__h", key)
    return d.withColumn("class_rank", F.col("__off") + F.row_number().over(wi)).drop("__h", "__b", "__off")


def stratified_split(df: DataFrame, y: str, key: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """``is_test`` = class rank <= round(test_size * class size)."""
    r = class_rank(df, y, key, seed)
    return r.withColumn("is_test", F.col("class_rank") <= F.round(F.col("n_class") * test_size)).drop("n_class")


def stratified_folds(df: DataFrame, y: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """fold = (class rank - 1) mod k: every fold gets each class evenly."""
    r = class_rank(df, y, key, seed)
    return r.withColumn("fold", ((F.col("class_rank") - 1) % k).cast("int")).drop("n_class")


# ------------------------------------------------------------------ L2 -----

def standardize(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """L2: median impute then (x - mean) / population std; constant column -> 0."""
    st = exact_quantiles(df.select(*cols), {c: [0.5] for c in cols})
    d = with_scalars(df, st.select(*[F.col(c)[0].alias(f"__med_{c}") for c in cols]))
    d = d.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"__med_{c}")) for c in cols})
    st2 = d.agg(*[F.avg(c).alias(f"__mu_{c}") for c in cols], *[F.stddev_pop(c).alias(f"__sd_{c}") for c in cols])
    d = with_scalars(d, st2)
    d = d.withColumns({c: F.when(F.col(f"__sd_{c}") > 0, (F.col(c) - F.col(f"__mu_{c}")) / F.col(f"__sd_{c}"))
                       .otherwise(F.lit(0.0)) for c in cols})
    return d.drop(*[f"__{p}_{c}" for p in ("med", "mu", "sd") for c in cols])
