"""The training pipeline (L25, L28): employee and policy tables in, the run's result tables and 33 metrics out.

Steps: read, engineer features, prepare the policies, add the match features and the macro index, set the test rows aside, tune
the boosting on the pool, out-of-fold base probabilities, blend weights,
meta learner, threshold and segment thresholds on its out-of-fold probabilities, final fit on the whole pool, scores
of both parts, metrics, reasons of each test row, tables written as one run.  Every step is a DataFrame; only single rows (weights, thresholds, metrics)
come to the driver.  The bounded-size inputs of later steps are checkpointed, as several of them read each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import params as P
from ..operators import aggregates as AG
from ..operators import attributions as AT
from ..operators import blending as BL
from ..operators import evaluation as EV
from ..operators import features as FE
from ..operators import learners as LN
from ..operators import matching as MT
from ..operators import normalize as N
from ..operators import policy as PO
from ..operators import ranking as RK
from ..session import cut_lineage
from ..sources import tables as TB

KEY = "EmployeeNumber"
BASE = {"p_gbt": "p_a", "p_lr": "p_b", "p_rf": "p_c"}
META = ["p_a", "p_b", "p_c", "blend_prob", "mean_prob", "std_prob", "disagreement"]


def training_features(employees: DataFrame) -> DataFrame:
    """Repaired employees with engineered features and the 0/1 label."""
    d = FE.add_interaction_features(N.normalize_workforce(employees))
    return d.withColumn(LN.LABEL, F.when(F.col("Attrition") == "Yes", 1).otherwise(0))


#: Policy columns of ``read_policies`` by what they hold.
POLICY_COLUMNS = {"title": "title", "content": "content", "time": "publish_date", "role": "roles", "department": "departments", "source": "source"}


def policy_features(features: DataFrame, prepared: DataFrame, topics=P.POLICY_TOPICS, role_aliases=P.JOB_ROLE_ALIAS_GROUPS,
                    dept_aliases=P.DEPARTMENT_ALIAS_GROUPS) -> DataFrame:
    """Employees with the 15 match features (K8-K13) and the macro index of their role."""
    match = MT.policy_match_features(features, prepared, topics, role_aliases, dept_aliases, KEY)
    macro = PO.join_macro_index(features.select(KEY, "JobRole"), prepared, role_aliases).select(KEY, "macro_index")
    return features.join(match, KEY).join(macro, KEY)


def _renamed(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(BASE)


def train_and_evaluate(features: DataFrame, gbt_params: dict | None = None, num_trees: int = LN.FOREST_TREES,
                       test_size: float = 0.2, seed: int = 42, folds: int = 5, tune: dict | None = None) -> dict:
    """``metrics`` (a dict of the 33 run metrics), ``detail`` (scored test rows), ``oof`` of the pool, ``config`` (thresholds),
    ``drivers`` (each test row's attributions by learner 1), ``importance`` (its gains by encoded slot) and ``settings``.

    The boosting's settings are ``gbt_params``, or those that ``tune_gbt``, with the options ``tune``, finds best on the pool.
    """
    raw, num, cat = LN.training_columns(features)
    parts = EV.stratified_split(raw, LN.LABEL, KEY, test_size, seed).drop("class_rank")
    pool, test = (cut_lineage(parts.where(c).drop("is_test")) for c in (~F.col("is_test"), F.col("is_test")))
    if gbt_params is None and tune is not None:
        best = LN.tune_gbt(pool, LN.LABEL, KEY, seed=seed, **tune).first()  # a row for each draw
        gbt_params = LN.parse_settings(best["settings"], tune.get("space"))
    base = _renamed(LN.oof_predictions(pool, k=folds, seed=seed, gbt_params=gbt_params, num_trees=num_trees))
    base = cut_lineage(base)
    best = BL.blend_grid(base, LN.LABEL).first()
    weights = (best["w_a"], best["w_b"], best["w_c"])
    meta = cut_lineage(LN.meta_oof(base, LN.LABEL, KEY, folds, seed, weights).select(KEY, LN.LABEL, F.col("meta_prob").alias("p")))
    base_threshold = EV.threshold_search(meta, LN.LABEL, "p").first()["threshold"]
    segments = EV.risk_segments(pool).select(KEY, "segment", "segment_score")
    config = cut_lineage(EV.segment_thresholds(meta.join(segments, KEY), base_threshold, LN.LABEL, "p"))
    chosen = config.first()

    statistics = LN.fit_statistics(pool, num, cat)
    both = pool.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    coded, models = LN.fit_models(pool, both, num, cat, gbt_params=gbt_params, num_trees=num_trees, statistics=statistics)
    names = LN.encoded_feature_names(coded)
    final = _renamed(LN._scored(coded, models).select(KEY, LN.LABEL, "part", *BASE))
    fitted = EV.meta_features(base, weights=weights).select(KEY, LN.LABEL, *META)
    scored = LN.fit_predict(fitted, EV.meta_features(final, weights=weights).select(KEY, LN.LABEL, "part", *META), META, [], ("lr",))
    scored = cut_lineage(scored.select(KEY, LN.LABEL, "part", F.col("p_lr").alias("p")))

    metrics: dict = {}
    detail = {}
    for name, table in (("train", pool), ("test", test)):
        rows = scored.where(F.col("part") == name).join(EV.risk_segments(table).select(KEY, "segment"), KEY)
        rows = detail[name] = cut_lineage(EV.apply_thresholds(rows, config))
        row = EV.binary_metrics(rows, LN.LABEL, "p", "threshold").first().asDict()
        row["auc"] = EV.roc_auc(rows, LN.LABEL, "p").first()["auc"]
        row["high_risk_share"] = rows.agg(F.avg((F.col("segment") == "high_risk").cast("double"))).first()[0] or 0.0
        metrics |= {f"{name}_{k}": v for k, v in row.items()}
    metrics["valid_auc"] = EV.roc_auc(meta, LN.LABEL, "p").first()["auc"]
    metrics |= {f"valid_{k}": chosen[k] for k in ("acc", "precision", "recall", "f1", "pred_positive_rate")}
    metrics |= dict(zip(("blend_lgb_weight", "blend_lr_weight", "blend_et_weight"), weights))
    metrics |= {
        "ensemble_strategy": "oof_logistic_stack", "feature_strategy": "full_enhanced_features", "probability_calibration": "none",
        "threshold_strategy": chosen["type"], "best_threshold": base_threshold,
        "high_risk_threshold": base_threshold if chosen["high_risk"] is None else chosen["high_risk"],
        "standard_threshold": base_threshold if chosen["standard"] is None else chosen["standard"],
        "selected_num_features": len(num), "selected_cat_features": len(cat), "selected_total_features": len(num) + len(cat),
    }
    test_rows = detail["test"].withColumn("predicted", F.when(F.col("p") >= F.col("threshold"), 1).otherwise(0))
    drivers = AT.tree_contributions(coded.where("part = 'test'"), models["gbt"], names, KEY)
    importance = AT.gain_importance(pool.sparkSession, models["gbt"], names)
    return {"metrics": metrics, "detail": test_rows, "oof": meta, "config": config, "drivers": drivers, "importance": importance, "settings": gbt_params or dict(LN.GBT_DEFAULTS)}


def metric_tables(spark: SparkSession, metrics: dict) -> tuple[DataFrame, DataFrame]:
    """I4: (core, full) tables of code, label and value as text; keys that a run lacks are left out."""
    kinds = "metric string, label string, value string"
    full = [(k, P.METRIC_LABELS.get(k, k), str(v)) for k, v in metrics.items()]
    core = [(k, P.METRIC_LABELS[k], str(metrics[k])) for k in P.CORE_METRICS if k in metrics]
    return spark.createDataFrame(core, kinds), spark.createDataFrame(full, kinds)


def result_tables(spark: SparkSession, result: dict, features: DataFrame) -> dict[str, DataFrame]:
    """The run's tables: scored test rows, high risks, summary, reasons, policy gaps, metrics and the leading features."""
    core, full = metric_tables(spark, result["metrics"])
    detail = result["detail"].select(KEY, F.round("p", 3).alias("probability"), "predicted", F.col(LN.LABEL).alias("actual"), "threshold", "segment")
    detail = RK.risk_rank(detail, "probability", KEY)
    tables = {
        "prediction_detail": detail,
        "high_risk": RK.high_risk_list(detail).orderBy("risk_rank"),
        "result_summary": AG.result_summary(result["detail"], result["config"]),
        "top3_drivers": detail.join(RK.top3_drivers(result["drivers"], key=KEY), KEY).orderBy("risk_rank"),
    }
    if "macro_index" in features.columns:
        tables["policy_gap"] = PO.policy_gap(features)
    top = result["importance"].orderBy(F.desc("importance"), "feature").limit(20)  # a top-k report
    return tables | {"feature_importance_top20": top, "metrics_core": core, "metrics_full": full}


def run_pipeline(spark: SparkSession, employee_path: str, out: str, prefix: str, policy_path: str | None = None, csv: bool = False,
                 policy_options: dict | None = None, tune: dict | None = None, **options) -> dict:
    """Read ``employee_path`` and ``policy_path`` (csv, json or parquet), train, evaluate and write the result tables as one run of ``prefix``.

    policy_options: topics, word lists and alias groups, if not the built-in ones; tune: options of the random search (all
    its draws and folds by default), which ``gbt_params`` replaces.  Returns the metrics, the paths written, the tables' row counts, the
    settings used and the inputs' sizes.
    """
    features = training_features(TB.read_employees(spark, employee_path))
    n_policies = 0
    if policy_path:
        given = policy_options or {}
        policies = TB.read_policies(spark, policy_path)
        prepared = PO.prepare_policies(policies, POLICY_COLUMNS, **given)
        n_policies = prepared.count()
        features = policy_features(features, prepared, **{k: given[k] for k in ("topics", "role_aliases", "dept_aliases") if k in given})
    features = cut_lineage(features)
    result = train_and_evaluate(features, tune={} if tune is None else tune, **options)
    tables = result_tables(spark, result, features)
    paths = TB.write_results(tables, out, prefix, csv)
    counts = {name: spark.read.parquet(next(p for p in paths if p.endswith(f"/{name}.parquet"))).count() for name in tables}
    return {"metrics": result["metrics"], "files": paths, "rows": counts, "settings": result["settings"], "employee_rows": features.count(), "policy_rows": n_policies}
