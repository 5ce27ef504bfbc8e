"""Driver queries for model evaluation over given probability columns (SURVEY §2.L:
L2, L5-L7, L14, L17-L24), each with its DuckDB twin.

Input is the ``model_scores`` fixture (id, y, p_a, p_b, p_c) derived from the
whole ``workforce`` view, and the employee feature table for risk segments.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as AG
from ..operators import blending as BL
from ..operators import evaluation as EV
from ..operators import features as FE
from ..operators import learners as LN
from ..sources import fixtures as FX
from .common import dashboard

SPARK: dict = {}
SQL: dict[str, str] = {}


def q(name: str, sql: str | None = None):
    def deco(fn):
        SPARK[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def D(x) -> str:
    return f"CAST({x!r} AS DOUBLE)"


WF = f"workforce AS ({FX.WORKFORCE_SQL})"
MS = f"{WF}, model_scores AS ({FX.MODEL_SCORES_SQL})"


def scores(spark, sf):
    return FX.model_scores(FX.workforce(spark, sf))


def seg_features(spark, sf):
    return FE.add_interaction_features(dashboard(spark, sf))


SEGMENT_BASE = 0.5  # parameter of the segment search driver query (the reference passes its global best)


def _metrics_sql(tp: str, pp: str, pos: str, n: str) -> str:
    z = D(0.0)
    return f"""CASE WHEN {n} = 0 THEN {z} ELSE CAST(({tp}) + ({n}) - ({pos}) - (({pp}) - ({tp})) AS DOUBLE) / ({n}) END AS acc,
       CASE WHEN {pp} = 0 THEN {z} ELSE CAST({tp} AS DOUBLE) / ({pp}) END AS precision,
       CASE WHEN {pos} = 0 THEN {z} ELSE CAST({tp} AS DOUBLE) / ({pos}) END AS recall,
       CASE WHEN 2 * ({tp}) + (({pp}) - ({tp})) + (({pos}) - ({tp})) = 0 THEN {z}
            ELSE CAST(2 * ({tp}) AS DOUBLE) / (2 * ({tp}) + (({pp}) - ({tp})) + (({pos}) - ({tp}))) END AS f1,
       CASE WHEN {n} = 0 THEN {z} ELSE CAST({pp} AS DOUBLE) / ({n}) END AS pred_positive_rate"""


# ------------------------------------------------------------------ L18 ----

@q("metrics_at_threshold", f"""WITH {MS},
c AS (SELECT COUNT(*) FILTER (WHERE p_b >= 0.5 AND y = 1) AS tp, COUNT(*) FILTER (WHERE p_b >= 0.5) AS pp,
             COUNT(*) FILTER (WHERE y = 1) AS pos, COUNT(*) AS n FROM model_scores)
SELECT {_metrics_sql('tp', 'pp', 'pos', 'n')} FROM c""")
def metrics_at_threshold(spark, sf):
    return EV.binary_metrics(scores(spark, sf), "y", "p_b", 0.5)


# ------------------------------------------------------------------ L19 ----

def _auc_sql(p: str) -> str:
    return f"""(SELECT CASE WHEN SUM(pos) > 0 AND SUM(neg) > 0 THEN
                 SUM(pos * (below + 0.5 * neg)) / (CAST(SUM(pos) AS DOUBLE) * SUM(neg)) END
          FROM (SELECT pos, neg, COALESCE(SUM(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
                FROM (SELECT {p} AS s, COUNT(*) FILTER (WHERE y = 1) AS pos, COUNT(*) FILTER (WHERE y <> 1) AS neg
                      FROM model_scores GROUP BY {p})))"""


@q("roc_auc", f"""WITH {MS}
SELECT {_auc_sql('p_a')} AS auc_a, {_auc_sql('p_b')} AS auc_b, {_auc_sql('p_c')} AS auc_c""")
def roc_auc(spark, sf):
    s = scores(spark, sf)
    a, b, c = (EV.roc_auc(s, "y", p).withColumnRenamed("auc", f"auc_{p[-1]}") for p in ("p_a", "p_b", "p_c"))
    return a.crossJoin(b).crossJoin(c)  # three one-row results side by side


# ---------------------------------------------------------------- L20/21 ---

def _threshold_search_sql(src: str, p: str) -> str:
    coarse = ", ".join(f"({D(t)})" for t in EV.np_arange(*EV.COARSE_GRID))
    extra = ", ".join(f"({D(t)}, 0)" for t in EV.FIXED_EXTRA)
    return f"""
st AS (SELECT LEAST(GREATEST(AVG(CAST(y AS DOUBLE)) * 1.10, 0.12), 0.30) AS target, COUNT(*) AS n,
              COUNT(*) FILTER (WHERE y = 1) AS pos FROM {src}),
ordp AS (SELECT {p} AS x, ROW_NUMBER() OVER (ORDER BY {p}) - 1 AS i FROM {src} WHERE {p} IS NOT NULL),
hq AS (SELECT (1.0 - (SELECT target FROM st)) * (COUNT(*) - 1) AS h FROM ordp),
pv AS (SELECT MAX(CASE WHEN i = FLOOR(h) THEN x END)
              + (MAX(h) - FLOOR(MAX(h))) * (MAX(CASE WHEN i = CEIL(h) THEN x END) - MAX(CASE WHEN i = FLOOR(h) THEN x END)) AS prev_t
       FROM ordp, hq),
cand0 AS (SELECT col0 AS t, 0 AS stage FROM (VALUES {coarse})
          UNION ALL SELECT prev_t, 0 FROM pv
          UNION ALL SELECT * FROM (VALUES {extra})),
cnt0 AS (SELECT c.t, c.stage, COUNT(s.y) FILTER (WHERE s.y = 1) AS tp, COUNT(s.y) AS pp
         FROM cand0 c LEFT JOIN {src} s ON s.{p} >= c.t GROUP BY c.t, c.stage),
m0 AS (SELECT t, stage, {_metrics_sql('tp', 'pp', 'pos', 'n')} FROM cnt0, st),
s0 AS (SELECT m0.*, 0.56 * f1 + 0.22 * recall + 0.12 * acc + 0.10 * precision
              - 0.10 * ABS(pred_positive_rate - (SELECT target FROM st)) - 0.04 * GREATEST(t - 0.62, 0.0) AS score FROM m0),
e0 AS (SELECT * FROM s0 WHERE score >= (SELECT MAX(score) FROM s0) - 1e-12),
b0 AS (SELECT * FROM e0 WHERE recall >= (SELECT MAX(recall) FROM e0) - 1e-12 ORDER BY ABS(t - 0.55), stage, t LIMIT 1),
bd AS (SELECT GREATEST(t - 0.05, 0.10) AS fs, LEAST(t + 0.05, 0.75) + 0.0001 AS fe FROM b0),
cand1 AS (SELECT fs + i * ((fs + 0.005) - fs) AS t, 1 AS stage
          FROM bd, range(0, 21) r(i) WHERE i < CEIL((fe - fs) / 0.005)),
cnt1 AS (SELECT c.t, c.stage, COUNT(s.y) FILTER (WHERE s.y = 1) AS tp, COUNT(s.y) AS pp
         FROM cand1 c LEFT JOIN {src} s ON s.{p} >= c.t GROUP BY c.t, c.stage),
m1 AS (SELECT t, stage, {_metrics_sql('tp', 'pp', 'pos', 'n')} FROM cnt1, st),
s1 AS (SELECT m1.*, 0.56 * f1 + 0.22 * recall + 0.12 * acc + 0.10 * precision
              - 0.10 * ABS(pred_positive_rate - (SELECT target FROM st)) - 0.04 * GREATEST(t - 0.62, 0.0) AS score FROM m1),
both_stages AS (SELECT * FROM b0 UNION ALL SELECT * FROM s1),
e1 AS (SELECT * FROM both_stages WHERE score >= (SELECT MAX(score) FROM both_stages) - 1e-12),
best AS (SELECT * FROM e1 WHERE recall >= (SELECT MAX(recall) FROM e1) - 1e-12 ORDER BY ABS(t - 0.55), stage, t LIMIT 1)"""


@q("threshold_search", f"""WITH {MS}, {_threshold_search_sql('model_scores', 'p_b')}
SELECT t AS threshold, score, acc, precision, recall, f1, pred_positive_rate FROM best""")
def threshold_search(spark, sf):
    return EV.threshold_search(scores(spark, sf), "y", "p_b")


# ------------------------------------------------------------------ L13 ----

def _blend_stage_sql(k: int, weights: str) -> str:
    """CTEs that score the weights of ``weights`` (ord, wa, wb, wc): k names the stage."""
    coarse = ", ".join(f"({D(t)})" for t in [*EV.np_arange(*EV.COARSE_GRID), *EV.FIXED_EXTRA])
    base = (f"0.56 * f1 + 0.22 * recall + 0.12 * acc + 0.10 * precision - 0.10 * ABS(pred_positive_rate - target) "
            f"- 0.04 * GREATEST(t - 0.62, 0.0)")

    def pick(src: str, out: str) -> str:
        return f"""{out}a AS (SELECT * FROM (SELECT *, MAX(s) OVER (PARTITION BY ord) AS m FROM {src}) WHERE s >= m - 1e-12),
{out} AS (SELECT * EXCLUDE (m, m2, rn) FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY ord ORDER BY ABS(t - 0.55), stage, t) AS rn
  FROM (SELECT *, MAX(recall) OVER (PARTITION BY ord) AS m2 FROM {out}a) WHERE recall >= m2 - 1e-12) WHERE rn = 1)"""

    def metrics(src: str, cand: str, out: str, stage: int) -> str:
        return f"""{out}c AS (SELECT c.ord, c.t, COUNT(*) FILTER (WHERE b >= c.t AND y = 1) AS tp, COUNT(*) FILTER (WHERE b >= c.t) AS pp
  FROM {cand} c JOIN {src} x ON x.ord = c.ord GROUP BY c.ord, c.t),
{out}m AS (SELECT ord, t, target, pos, n, {_metrics_sql('tp', 'pp', 'pos', 'n')} FROM {out}c, tot),
{out} AS (SELECT *, {base} AS s, {stage} AS stage FROM {out}m)"""
    return f"""x{k} AS (SELECT w.ord, y, p_a * wa + p_b * wb + p_c * wc AS b FROM model_scores, {weights} w),
rk{k} AS (SELECT ord, b, ROW_NUMBER() OVER (PARTITION BY ord ORDER BY b) - 1 AS i FROM x{k}),
pv{k} AS (SELECT ord, MAX(CASE WHEN i = FLOOR(h) THEN b END) + (MAX(h) - FLOOR(MAX(h)))
                 * (MAX(CASE WHEN i = CEIL(h) THEN b END) - MAX(CASE WHEN i = FLOOR(h) THEN b END)) AS t
          FROM rk{k}, (SELECT (1.0 - target) * (n - 1) AS h FROM tot) GROUP BY ord),
cn{k} AS (SELECT ord, t FROM (SELECT ord FROM {weights}), (SELECT col0 AS t FROM (VALUES {coarse})) UNION ALL SELECT ord, t FROM pv{k}),
{metrics(f'x{k}', f'cn{k}', f'sa{k}', 0)},
{pick(f'sa{k}', f'ba{k}')},
fn{k} AS (SELECT ord, fs + i * ((fs + 0.005) - fs) AS t
          FROM (SELECT ord, GREATEST(t - 0.05, 0.10) AS fs, LEAST(t + 0.05, 0.75) + 0.0001 AS fe FROM ba{k}), range(0, 21) r(i)
          WHERE i < CEIL((fe - fs) / 0.005)),
{metrics(f'x{k}', f'fn{k}', f'sb{k}', 1)},
un{k} AS (SELECT * FROM ba{k} UNION ALL SELECT * FROM sb{k}),
{pick(f'un{k}', f'bb{k}')},
au{k} AS (SELECT ord, SUM(neg * (above + 0.5 * pos)) / (CAST(SUM(pos) AS DOUBLE) * SUM(neg)) AS auc
          FROM (SELECT *, COALESCE(SUM(pos) OVER (PARTITION BY ord ORDER BY b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above
                FROM (SELECT ord, b, COUNT(*) FILTER (WHERE y = 1) AS pos, COUNT(*) FILTER (WHERE y <> 1) AS neg FROM x{k} GROUP BY ord, b))
          GROUP BY ord),
fin{k} AS (SELECT {k} AS stage_no, w.*, t AS threshold, auc, acc, precision, recall, f1, pred_positive_rate,
                  0.30 * auc + 0.38 * f1 + 0.20 * recall + 0.07 * acc + 0.05 * precision
                  - 0.07 * ABS(pred_positive_rate - CAST(pos AS DOUBLE) / n)
                  - (0.05 * GREATEST(wa - 0.35, 0.0) + 0.04 * GREATEST(wc - 0.20, 0.0) + 0.04 * GREATEST(0.45 - wb, 0.0)) AS score
           FROM bb{k} JOIN au{k} USING (ord) JOIN {weights} w USING (ord)),
top{k} AS (SELECT * FROM fin{k} WHERE score >= (SELECT MAX(score) FROM fin{k}) - 1e-12 ORDER BY ord LIMIT 1)"""


def _blend_sql() -> str:
    grid = ", ".join(f"({i}, {D(a)}, {D(b)}, {D(c)})" for i, (a, b, c) in enumerate(BL.weight_grid(BL.STEPS[0])))
    axis = "GREATEST(0.0, {0} - 0.04) + i * ((GREATEST(0.0, {0} - 0.04) + 0.02) - GREATEST(0.0, {0} - 0.04))"
    size = "i < CEIL((LEAST(1.0, {0} + 0.04) + 0.0001 - GREATEST(0.0, {0} - 0.04)) / 0.02)"
    return f"""WITH {MS},
tot AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE y = 1) AS pos,
               LEAST(GREATEST(AVG(CAST(y AS DOUBLE)) * 1.10, 0.12), 0.30) AS target FROM model_scores),
w0 AS (SELECT col0 AS ord, col1 AS wa, col2 AS wb, col3 AS wc FROM (VALUES {grid})),
{_blend_stage_sql(0, 'w0')},
ga AS (SELECT i, {axis.format('wa')} AS wa FROM top0, range(0, 6) r(i) WHERE {size.format('wa')}),
gb AS (SELECT i, {axis.format('wb')} AS wb FROM top0, range(0, 6) r(i) WHERE {size.format('wb')}),
w1 AS (SELECT 1000 + ga.i * 10 + gb.i AS ord, wa, wb, ROUND(1.0 - wa - wb, 10) AS wc FROM ga, gb
       WHERE ROUND(1.0 - wa - wb, 10) BETWEEN 0 AND 1 AND GREATEST(wa, wb, ROUND(1.0 - wa - wb, 10)) >= 0.35),
{_blend_stage_sql(1, 'w1')},
alls AS (SELECT * FROM top0 UNION ALL SELECT * FROM fin1)
SELECT wa AS w_a, wb AS w_b, wc AS w_c, threshold, auc, acc, precision, recall, f1, pred_positive_rate, score
FROM alls WHERE score >= (SELECT MAX(score) FROM alls) - 1e-12 ORDER BY ord LIMIT 1"""


@q("blend_grid", _blend_sql())
def blend_grid(spark, sf):
    return BL.blend_grid(scores(spark, sf))


# ------------------------------------------------------------------ L22 ----

SEG_FEATURES_SQL = """
feat AS (
  SELECT EmployeeNumber, CASE WHEN Attrition = 'Yes' THEN 1 ELSE 0 END AS y, AttritionProb AS p,
         CASE WHEN OverTime = 'Yes' THEN 1.0 ELSE 0.0 END AS OverTimeFlag,
         CASE WHEN WorkLifeBalance <= 2 THEN 1.0 ELSE 0.0 END + CASE WHEN JobSatisfaction <= 2 THEN 1.0 ELSE 0.0 END
           + CASE WHEN EnvironmentSatisfaction <= 2 THEN 1.0 ELSE 0.0 END
           + CASE WHEN OverTime = 'Yes' THEN 1.0 ELSE 0.0 END AS StressLoadScore,
         (JobSatisfaction + EnvironmentSatisfaction + RelationshipSatisfaction + WorkLifeBalance) / 4.0 AS SatisfactionIndex,
         YearsSinceLastPromotion / (YearsAtCompany + 1) AS PromotionWaitRatio,
         YearsInCurrentRole / (YearsAtCompany + 1) AS RoleStagnationRatio,
         CASE BusinessTravel WHEN 'Non-Travel' THEN 0.0 WHEN 'Travel_Rarely' THEN 1.0
              WHEN 'Travel_Frequently' THEN 2.0 ELSE 0.0 END AS TravelRisk
  FROM workforce),
sc AS (
  SELECT *, CASE WHEN OverTimeFlag >= 1 THEN 1.0 ELSE 0.0 END + CASE WHEN StressLoadScore >= 2 THEN 1.0 ELSE 0.0 END
          + CASE WHEN COALESCE(SatisfactionIndex, (SELECT median(SatisfactionIndex) FROM feat)) <= 2.75 THEN 1.0 ELSE 0.0 END
          + CASE WHEN PromotionWaitRatio >= 0.45 THEN 1.0 ELSE 0.0 END
          + CASE WHEN RoleStagnationRatio >= 0.55 THEN 1.0 ELSE 0.0 END
          + CASE WHEN TravelRisk >= 1.5 THEN 1.0 ELSE 0.0 END AS segment_score
  FROM feat),
sst AS (SELECT COUNT(*) AS n, quantile_cont(segment_score, 0.65) AS q65, quantile_cont(segment_score, 0.5) AS q50,
               AVG(CASE WHEN segment_score >= 2 THEN 1.0 ELSE 0.0 END) AS share FROM sc),
c1 AS (SELECT *, CASE WHEN share < 0.15 OR share > 0.60 THEN GREATEST(q65, 1.0) ELSE 2.0 END AS cut1 FROM sst),
c2 AS (SELECT CASE WHEN (SELECT COUNT(*) FROM sc WHERE segment_score >= c1.cut1) IN (0, c1.n) THEN q50 ELSE cut1 END AS cut
       FROM c1),
seg AS (SELECT sc.*, CASE WHEN segment_score >= (SELECT cut FROM c2) THEN 'high_risk' ELSE 'standard' END AS segment
        FROM sc)"""


@q("risk_segments", f"""WITH {WF}, {SEG_FEATURES_SQL}
SELECT EmployeeNumber, segment_score, segment FROM seg""")
def risk_segments(spark, sf):
    return EV.risk_segments(seg_features(spark, sf)).select("EmployeeNumber", "segment_score", "segment")


# ------------------------------------------------------------------ L23 ----

def _segment_thresholds_sql(base: float) -> str:
    hi, std = EV.segment_grid(base)
    pairs = ", ".join(f"({i * 1000 + j}, {D(th)}, {D(ts)})" for i, th in enumerate(hi)
                      for j, ts in enumerate(std) if th <= ts)
    return f"""
g AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE segment = 'high_risk') AS n_hi,
             COUNT(*) FILTER (WHERE y = 1) AS pos, COUNT(*) FILTER (WHERE y = 1 AND segment = 'high_risk') AS pos_hi,
             COUNT(*) FILTER (WHERE y = 1 AND p >= {D(base)}) AS tp_base, COUNT(*) FILTER (WHERE p >= {D(base)}) AS pp_base
      FROM seg),
pr AS (SELECT col0 AS ord, col1 AS th, col2 AS ts FROM (VALUES {pairs})),
pc AS (SELECT pr.ord, pr.th, pr.ts,
              COUNT(s.y) FILTER (WHERE s.y = 1 AND s.p >= CASE WHEN s.segment = 'high_risk' THEN pr.th ELSE pr.ts END) AS tp,
              COUNT(s.y) FILTER (WHERE s.p >= CASE WHEN s.segment = 'high_risk' THEN pr.th ELSE pr.ts END) AS pp
       FROM pr, seg s GROUP BY pr.ord, pr.th, pr.ts),
pm AS (SELECT ord, th, ts, {_metrics_sql('tp', 'pp', 'pos', 'n')}, pos, n FROM pc, g),
ps AS (SELECT *, 0.64 * f1 + 0.18 * recall + 0.10 * acc + 0.08 * precision
               - 0.03 * ABS(pred_positive_rate - CAST(pos AS DOUBLE) / n) - 0.02 * GREATEST(ts - th - 0.18, 0.0) AS score
       FROM pm),
pb AS (SELECT * FROM ps WHERE score >= (SELECT MAX(score) FROM ps) - 1e-12 ORDER BY ord LIMIT 1),
gm AS (SELECT *, n_hi >= GREATEST(30, CAST(FLOOR(0.12 * n) AS BIGINT)) AND n - n_hi >= GREATEST(30, CAST(FLOOR(0.12 * n) AS BIGINT))
                 AND pos_hi >= 8 AND pos - pos_hi >= 8 AS ok,
              {_metrics_sql('tp_base', 'pp_base', 'pos', 'n')} FROM g),
cfg AS (
  SELECT CASE WHEN ok THEN 'segment' ELSE 'global' END AS type, {D(base)} AS base_threshold,
         CASE WHEN ok THEN pb.th END AS high_risk, CASE WHEN ok THEN pb.ts END AS standard,
         CASE WHEN ok THEN CAST(gm.n_hi AS DOUBLE) / gm.n END AS high_risk_share,
         CASE WHEN ok THEN pb.acc ELSE gm.acc END AS acc, CASE WHEN ok THEN pb.precision ELSE gm.precision END AS precision,
         CASE WHEN ok THEN pb.recall ELSE gm.recall END AS recall, CASE WHEN ok THEN pb.f1 ELSE gm.f1 END AS f1,
         CASE WHEN ok THEN pb.pred_positive_rate ELSE gm.pred_positive_rate END AS pred_positive_rate
  FROM gm, pb)"""


def _segmented(spark, sf):
    f = seg_features(spark, sf).withColumns({"y": F.when(F.col("Attrition") == "Yes", 1).otherwise(0),
                                             "p": F.col("AttritionProb")})
    return EV.risk_segments(f)


@q("segment_thresholds", f"""WITH {WF}, {SEG_FEATURES_SQL}, {_segment_thresholds_sql(SEGMENT_BASE)}
SELECT * FROM cfg""")
def segment_thresholds(spark, sf):
    return EV.segment_thresholds(_segmented(spark, sf), SEGMENT_BASE, "y", "p")


# ------------------------------------------------------------------ L24 ----

@q("apply_thresholds", f"""WITH {WF}, {SEG_FEATURES_SQL}, {_segment_thresholds_sql(SEGMENT_BASE)}
SELECT s.EmployeeNumber, s.segment,
       CASE WHEN c.type = 'segment' THEN CASE WHEN s.segment = 'high_risk' THEN c.high_risk ELSE c.standard END
            ELSE c.base_threshold END AS threshold,
       CASE WHEN s.p >= CASE WHEN c.type = 'segment' THEN CASE WHEN s.segment = 'high_risk' THEN c.high_risk ELSE c.standard END
            ELSE c.base_threshold END THEN 1 ELSE 0 END AS predicted
FROM seg s, cfg c""")
def apply_thresholds(spark, sf):
    seg = _segmented(spark, sf).persist()  # feeds the config and the per-row threshold
    cfg = EV.segment_thresholds(seg, SEGMENT_BASE, "y", "p")
    out = EV.apply_thresholds(seg, cfg)
    return out.select("EmployeeNumber", "segment", "threshold",
                      F.when(F.col("p") >= F.col("threshold"), 1).otherwise(0).alias("predicted"))


# ------------------------------------------------------------------ L14 ----

@q("meta_features", f"""WITH {MS}
SELECT id, p_a, p_b, p_c, 0.5 * p_a + 0.3 * p_b + 0.2 * p_c AS blend_prob,
       (p_a + p_b + p_c) / 3.0 AS mean_prob,
       SQRT((POWER(p_a - (p_a + p_b + p_c) / 3.0, 2) + POWER(p_b - (p_a + p_b + p_c) / 3.0, 2)
             + POWER(p_c - (p_a + p_b + p_c) / 3.0, 2)) / 3.0) AS std_prob,
       GREATEST(p_a, p_b, p_c) - LEAST(p_a, p_b, p_c) AS disagreement
FROM model_scores""")
def meta_features(spark, sf):
    return EV.meta_features(scores(spark, sf)).select("id", "p_a", "p_b", "p_c", "blend_prob", "mean_prob",
                                                      "std_prob", "disagreement")


# ------------------------------------------------------------------ L17 ----

PLATT = (1.7, -0.4)  # given calibration coefficients for the driver query (apply only)


@q("platt_apply", f"""WITH {MS}
SELECT id, 1.0 / (1.0 + EXP(-({D(PLATT[0])} * LN(LEAST(GREATEST(p_c, 1e-6), 1 - 1e-6)
                                           / (1.0 - LEAST(GREATEST(p_c, 1e-6), 1 - 1e-6))) + {D(PLATT[1])}))) AS calibrated
FROM model_scores""")
def platt_apply(spark, sf):
    return EV.platt_apply(scores(spark, sf), "p_c", *PLATT).select("id", "calibrated")


# ------------------------------------------------------------- L15/L16 -----

@q("meta_oof")
def meta_oof(spark, sf):
    """L15 on the given base probabilities; a learner's output, hence without SQL."""
    return LN.meta_oof(scores(spark, sf)).select("id", "fold", "meta_prob")


BLEND = (2.0, 1.5, 0.5)  # weights before normalisation

_BLEND_SQL = " + ".join(f"{p} * {D(w / sum(BLEND))}" for p, w in zip(("p_a", "p_b", "p_c"), BLEND))


@q("score_blend", f"""WITH {MS}, b AS (SELECT id, LEAST(GREATEST({_BLEND_SQL}, 1e-6), 1 - 1e-6) AS x FROM model_scores)
SELECT id, 1.0 / (1.0 + EXP(-({D(PLATT[0])} * LN(x / (1.0 - x)) + {D(PLATT[1])}))) AS score FROM b""")
def score_blend(spark, sf):
    return LN.score_blend(scores(spark, sf), BLEND, calibrator=PLATT).select("id", "score")


# -------------------------------------------------------------- L5-L7 ------

@q("class_weights", f"""WITH {MS}
SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE y = 1) AS pos, COUNT(*) FILTER (WHERE y = 0) AS neg,
       CAST(GREATEST(COUNT(*) FILTER (WHERE y = 0), 1) AS DOUBLE) / GREATEST(COUNT(*) FILTER (WHERE y = 1), 1) AS scale_pos_weight,
       COUNT(*) / (2.0 * GREATEST(COUNT(*) FILTER (WHERE y = 0), 1)) AS weight_neg,
       COUNT(*) / (2.0 * GREATEST(COUNT(*) FILTER (WHERE y = 1), 1)) AS weight_pos
FROM model_scores""")
def class_weights(spark, sf):
    return EV.class_weights(scores(spark, sf))


_RANK_SQL = """r AS (SELECT id, y, ROW_NUMBER() OVER (PARTITION BY y ORDER BY md5(CONCAT('42:', CAST(id AS VARCHAR))), id) AS class_rank,
              COUNT(*) OVER (PARTITION BY y) AS n_class FROM model_scores)"""


@q("stratified_split", f"""WITH {MS}, {_RANK_SQL}
SELECT id, y, class_rank, class_rank <= ROUND(n_class * 0.2) AS is_test FROM r""")
def stratified_split(spark, sf):
    return EV.stratified_split(scores(spark, sf), "y", "id", 0.2, 42).select("id", "y", "class_rank", "is_test")


@q("stratified_folds", f"""WITH {MS}, {_RANK_SQL}
SELECT id, y, class_rank, CAST((class_rank - 1) % 5 AS INTEGER) AS fold FROM r""")
def stratified_folds(spark, sf):
    return EV.stratified_folds(scores(spark, sf), "y", "id", 5, 42).select("id", "y", "class_rank", "fold")


# ------------------------------------------------------------------ L2 -----

STD_COLS = ["MonthlyIncome", "Age", "YearsAtCompany", "DistanceFromHome", "JobSatisfaction"]


def _std_sql() -> str:
    sel = []
    for c in STD_COLS:
        sel.append(f"CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - AVG({c}) OVER ()) / stddev_pop({c}) OVER () "
                   f"ELSE {D(0.0)} END AS {c}")
    imp = ", ".join(f"COALESCE(CAST({c} AS DOUBLE), (SELECT median(CAST({c} AS DOUBLE)) FROM workforce)) AS {c}"
                    for c in STD_COLS)
    return f"""WITH {WF}, i AS (SELECT EmployeeNumber, {imp} FROM workforce)
SELECT EmployeeNumber, {', '.join(sel)} FROM i"""


@q("standardize", _std_sql())
def standardize(spark, sf):
    wf = FX.workforce(spark, sf).select("EmployeeNumber", *STD_COLS)
    return EV.standardize(wf, STD_COLS)


# -------------------------------------------------------------- E20/E21 ----

_APPLIED_SQL = f"""{WF}, {SEG_FEATURES_SQL}, {_segment_thresholds_sql(SEGMENT_BASE)},
applied AS (
  SELECT s.EmployeeNumber, s.p, c.type,
         CASE WHEN s.p >= CASE WHEN c.type = 'segment' THEN CASE WHEN s.segment = 'high_risk' THEN c.high_risk ELSE c.standard END
              ELSE c.base_threshold END THEN 1 ELSE 0 END AS predicted
  FROM seg s, cfg c)"""


def _applied(spark, sf):
    seg = _segmented(spark, sf).persist()
    cfg = EV.segment_thresholds(seg, SEGMENT_BASE, "y", "p")
    out = EV.apply_thresholds(seg, cfg)
    out = out.withColumn("predicted", F.when(F.col("p") >= F.col("threshold"), 1).otherwise(0))
    return out, cfg


@q("result_summary", f"""WITH {_APPLIED_SQL}
SELECT 'sample_count' AS metric, CAST(COUNT(*) AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS text FROM applied
UNION ALL SELECT 'predicted_high_risk', CAST(SUM(predicted) AS DOUBLE), NULL FROM applied
UNION ALL SELECT 'predicted_high_risk_share', AVG(CAST(predicted AS DOUBLE)), NULL FROM applied
UNION ALL SELECT 'mean_probability', AVG(p), NULL FROM applied
UNION ALL SELECT 'threshold_strategy', NULL, (SELECT type FROM cfg)""")
def result_summary(spark, sf):
    """Run summary in long form (metric, value, text); one aggregate + the config row."""
    out, cfg = _applied(spark, sf)
    return AG.result_summary(out, cfg)


@q("decision_share", f"""WITH {_APPLIED_SQL}
SELECT COUNT(*) - SUM(predicted) AS stay_count, SUM(predicted) AS leave_count,
       CAST(COUNT(*) - SUM(predicted) AS DOUBLE) / COUNT(*) AS stay_share,
       CAST(SUM(predicted) AS DOUBLE) / COUNT(*) AS leave_share
FROM applied""")
def decision_share(spark, sf):
    """Predicted stay / leave counts and shares (one aggregate)."""
    out, _ = _applied(spark, sf)
    return AG.decision_share(out)


# ------------------------------------------------------------------ L26 ----

@q("prediction_detail", f"""WITH {_APPLIED_SQL},
thr AS (
  SELECT s.EmployeeNumber, s.y, s.segment,
         CASE WHEN c.type = 'segment' THEN CASE WHEN s.segment = 'high_risk' THEN c.high_risk ELSE c.standard END
              ELSE c.base_threshold END AS threshold
  FROM seg s, cfg c)
SELECT a.EmployeeNumber, ROUND(a.p, 3) AS probability, a.predicted, t.y AS actual, t.threshold, t.segment
FROM applied a JOIN thr t ON a.EmployeeNumber = t.EmployeeNumber""")
def prediction_detail(spark, sf):
    """Per-employee probability (3 dp), predicted / actual label, threshold and segment,
    ordered by probability descending (the written sheet's order)."""
    out, _ = _applied(spark, sf)
    return (out.select("EmployeeNumber", F.round("p", 3).alias("probability"), "predicted", F.col("y").alias("actual"),
                       "threshold", "segment")
            .orderBy(F.desc("probability"), F.asc("EmployeeNumber")))


# --------------------------------------------------------------- I3/I4 -----

_SPLIT_SQL = f"""{MS}, {_RANK_SQL},
sp AS (SELECT m.*, CASE WHEN r.class_rank <= ROUND(r.n_class * 0.2) THEN 'test' ELSE 'train' END AS split
       FROM model_scores m JOIN r ON m.id = r.id)"""


def _split_metrics_sql(split: str) -> str:
    auc = f"""(SELECT CASE WHEN SUM(pos) > 0 AND SUM(neg) > 0 THEN
                SUM(pos * (below + 0.5 * neg)) / (CAST(SUM(pos) AS DOUBLE) * SUM(neg)) END
         FROM (SELECT pos, neg, COALESCE(SUM(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
               FROM (SELECT p_b AS s, COUNT(*) FILTER (WHERE y = 1) AS pos, COUNT(*) FILTER (WHERE y <> 1) AS neg
                     FROM sp WHERE split = '{split}' GROUP BY p_b)))"""
    return f"""(SELECT '{split}' AS split, {auc} AS auc, m.* FROM (
  SELECT {_metrics_sql('tp', 'pp', 'pos', 'n')}
  FROM (SELECT COUNT(*) FILTER (WHERE p_b >= 0.5 AND y = 1) AS tp, COUNT(*) FILTER (WHERE p_b >= 0.5) AS pp,
               COUNT(*) FILTER (WHERE y = 1) AS pos, COUNT(*) AS n FROM sp WHERE split = '{split}')) m)"""


@q("metrics_long", f"""WITH {_SPLIT_SQL},
w AS ({_split_metrics_sql('train')} UNION ALL {_split_metrics_sql('test')})
SELECT split, metric, value FROM (
  SELECT split, 'auc' AS metric, auc AS value FROM w UNION ALL SELECT split, 'acc', acc FROM w
  UNION ALL SELECT split, 'precision', precision FROM w UNION ALL SELECT split, 'recall', recall FROM w
  UNION ALL SELECT split, 'f1', f1 FROM w)""")
def metrics_long(spark, sf):
    """Long form (split, metric, value) of auc / acc / precision / recall / f1 at 0.5
    for the stratified train and test splits (one metric row set per split)."""
    s = EV.stratified_split(scores(spark, sf), "y", "id", 0.2, 42)
    s = s.withColumn("split", F.when(F.col("is_test"), "test").otherwise("train")).persist()
    parts = []
    for name in ("train", "test"):
        part = s.where(F.col("split") == name)
        m = EV.with_scalars(EV.binary_metrics(part, "y", "p_b", 0.5), EV.roc_auc(part, "y", "p_b"))
        parts.append(m.select(F.lit(name).alias("split"), F.inline(F.array(*[
            F.struct(F.lit(k).alias("metric"), F.col(k).alias("value"))
            for k in ("auc", "acc", "precision", "recall", "f1")]))))
    return parts[0].unionByName(parts[1])
