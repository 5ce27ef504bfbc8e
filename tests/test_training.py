"""The training pipeline end to end, with both inputs, tuning and small learners."""

import pytest
from pyspark.sql import functions as F

from churnscope.functions import params as P
from churnscope.plans import training as T
from churnscope.sources import fixtures as FX
from churnscope.sources import tables as TB
from conftest import SF_SMALL

SMALL = {"num_trees": 5, "folds": 2}
SPACE = {"maxIter": [2, 3], "maxDepth": [2], "minInstancesPerNode": [5], "stepSize": [0.1, 0.2]}
TABLES = {"prediction_detail", "high_risk", "result_summary", "top3_drivers", "policy_gap", "feature_importance_top20", "metrics_core", "metrics_full"}


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    """Employees as csv; policies, of which some aim at roles of employees, as parquet."""
    folder = tmp_path_factory.mktemp("inputs")
    wf = FX.workforce(spark, SF_SMALL)
    wf.write.options(header=True).csv(f"{folder}/employees.csv")
    roles = sorted(r[0] for r in wf.select("JobRole").distinct().collect())
    words = [w for _, (_, ws) in P.FIXTURE_TOPICS.items() for w in ws]
    rows = [(i, f"policy {i}", f"{words[i % len(words)]} {words[(3 * i) % len(words)]}\nsecond line {i}", f"2024-0{1 + i % 9}-01", roles[i % 5] if i % 3 else "", "BUILDING" if i % 4 == 0 else "", "s") for i in range(24)]
    spark.createDataFrame(rows, "policy_id long, title string, content string, publish_date string, roles string, departments string, source string").write.parquet(f"{folder}/policies.parquet")
    kw = {"topics": P.FIXTURE_TOPICS, "positive": P.FIXTURE_POSITIVE, "negative": P.FIXTURE_NEGATIVE,
          "role_aliases": FX.fixture_role_aliases(spark, SF_SMALL), "dept_aliases": FX.fixture_department_aliases(spark, SF_SMALL)}
    return f"{folder}/employees.csv", f"{folder}/policies.parquet", kw, wf.count()


def test_run_with_both_inputs(spark, inputs, tmp_path, monkeypatch):
    monkeypatch.setattr(T.BL, "STEPS", (0.5, 0.2))
    employees, policies, kw, n = inputs
    got = T.run_pipeline(spark, employees, f"{tmp_path}/out", "run", policies, csv=True, policy_options=kw, tune={"n": 2, "folds": 2, "space": SPACE}, **SMALL)
    assert set(got["metrics"]) == set(P.METRIC_LABELS) and len(got["metrics"]) == 33
    assert all(0 <= got["metrics"][f"{a}_{b}"] <= 1 for a in ("train", "valid", "test") for b in ("auc", "acc", "f1", "precision", "recall"))
    assert set(got["rows"]) == TABLES and len(got["files"]) == 2 * len(TABLES)
    assert got["employee_rows"] == n and got["policy_rows"] == 24
    assert all(got["settings"][k] in SPACE[k] for k in SPACE)  # the draw that the search found best
    assert got["rows"]["metrics_full"] == 33 and got["rows"]["metrics_core"] == len(P.CORE_METRICS) and got["rows"]["result_summary"] == 5
    assert abs(got["rows"]["prediction_detail"] - 0.2 * n) <= 2 and got["rows"]["top3_drivers"] == got["rows"]["prediction_detail"]
    read = lambda t: spark.read.parquet(TB.latest_output(spark, [f"{tmp_path}/out"], t, "run"))
    detail = read("prediction_detail")
    assert detail.where("predicted <> CASE WHEN probability >= threshold THEN 1 ELSE 0 END AND abs(probability - threshold) > 0.001").count() == 0
    positive = detail.where("predicted = 1").count()
    assert got["rows"]["high_risk"] == (positive or min(30, detail.count()))
    # numeric inputs: the engineered ones, the 15 match features and the macro index
    assert got["metrics"]["selected_num_features"] > 15
    assert read("top3_drivers").where("top3_drivers is null or top3_drivers = ''").count() == 0
    assert read("feature_importance_top20").count() == 20
    gap = read("policy_gap").collect()
    assert all(r.macro_index < P.MACRO_GAP_LIMIT for r in gap) and gap == sorted(gap, key=lambda r: (r.macro_index, r.JobRole, r.Department))


def test_policy_features_join_every_employee(spark, inputs):
    employees, policies, kw, n = inputs
    features = T.training_features(TB.read_employees(spark, employees))
    prepared = T.PO.prepare_policies(TB.read_policies(spark, policies), T.POLICY_COLUMNS, **kw)
    both = T.policy_features(features, prepared, kw["topics"], kw["role_aliases"], kw["dept_aliases"])
    assert both.count() == n and "JobRoleKey" not in both.columns
    assert set(T.MT.FEATURES + T.MT.exposure_names(kw["topics"])) < set(both.columns) and len(T.MT.FEATURES + T.MT.exposure_names(kw["topics"])) == 15
    assert both.where(F.col("macro_index").isNull() | F.col("policy_match_mean").isNull()).count() == 0
    rules = {c for c, *_ in T.EV.SEGMENT_RULES}
    assert rules <= set(both.columns)  # all eight segment rules apply


def test_high_risk_list_falls_back_to_the_first_thirty(spark):
    rows = [(i, i / 100, 0, 0, 0.99, "standard") for i in range(60)]
    detail = spark.createDataFrame(rows, "EmployeeNumber long, p double, predicted int, AttritionFlag int, threshold double, segment string")
    config = spark.createDataFrame([("global",)], "type string")
    drivers = detail.select("EmployeeNumber", F.array(F.struct(F.lit("f").alias("feature"), F.col("p").alias("value"))).alias("contributions"))
    importance = spark.createDataFrame([("f", 1.0)], "feature string, importance double")
    tables = T.result_tables(spark, {"metrics": {}, "detail": detail, "config": config, "drivers": drivers, "importance": importance}, detail)
    assert [r.EmployeeNumber for r in tables["high_risk"].collect()] == list(range(59, 29, -1))
    assert "policy_gap" not in tables and tables["top3_drivers"].first().top3_drivers == "f(0.590)"
