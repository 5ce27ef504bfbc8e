"""Driver queries for sources, schema repair, filters, dashboard aggregates, bins,
correlations and rankings (SURVEY §2.A-2.I), each with its DuckDB twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import params as P
from ..operators import aggregates as AG
from ..operators import binning as BN
from ..operators import correlation as CR
from ..operators import features as FE
from ..operators import normalize as N
from ..operators import ranking as RK
from ..session import checkpoint_dir
from ..sources import fixtures as FX
from ..sources import tables as TB
from .common import dashboard, scored

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
    """DuckDB double literal (plain decimals would be DECIMAL, trap T12)."""
    return f"CAST({x} AS DOUBLE)"


WF = f"workforce AS ({FX.WORKFORCE_SQL})"
RAW = f"workforce_raw AS ({FX.WORKFORCE_RAW_SQL})"
DASH = f"""{WF},
med AS (SELECT JobRole, quantile_cont(MonthlyIncome, 0.5) AS IncomeMedianByRole
        FROM workforce WHERE JobRole IS NOT NULL GROUP BY JobRole),
dash AS (
  SELECT w.*,
         CASE WHEN w.AttritionProb >= {D(0.6)} THEN 'High Risk'
              WHEN w.AttritionProb >= {D(0.35)} THEN 'Medium Risk' ELSE 'Low Risk' END AS RiskLevel,
         m.IncomeMedianByRole,
         LEAST(GREATEST(COALESCE(w.MonthlyIncome / NULLIF(m.IncomeMedianByRole, 0), {D(1.0)}), {D(0.5)}), {D(1.8)}) AS IncomeCompa
  FROM workforce w LEFT JOIN med m ON w.JobRole = m.JobRole)"""
SCORED = f"""{DASH},
scored AS (SELECT *, CASE WHEN AttritionProb >= {D(0.5)} THEN 1 ELSE 0 END AS pred,
                     CASE WHEN Attrition = 'Yes' THEN 1 ELSE 0 END AS act FROM dash)"""


def R(expr: str, digits: int = 6) -> str:
    return f"ROUND({expr}, {digits})"


# ---------------------------------------------------------------- A / B ----

@q("scan_employees", f"""WITH {WF}
SELECT EmployeeNumber, Department, JobRole, Attrition, Age, MonthlyIncome, YearsAtCompany, OverTime,
       CASE WHEN Attrition = 'Yes' THEN 1 WHEN Attrition = 'No' THEN 0 END AS AttritionFlag,
       {R('ln(1 + MonthlyIncome)')} AS MonthlyIncome_log
FROM workforce""")
def scan_employees(spark, sf):
    df = FE.preprocess_employees(FX.workforce(spark, sf))
    return df.select("EmployeeNumber", "Department", "JobRole", "Attrition", "Age", "MonthlyIncome",
                     "YearsAtCompany", "OverTime", "AttritionFlag", "MonthlyIncome_log")


def _written(spark, sf, **options):
    """The employee table, written by A5 into the shared folder; its paths."""
    folder = f"{checkpoint_dir(spark)}/results-{uuid.uuid4().hex}"
    return TB.write_results({"employees": FX.workforce(spark, sf)}, folder, "run", **options), folder


_READ_COLUMNS = ", ".join(f.name for f in TB.EMPLOYEES.fields)


@q("read_employees_csv", f"""WITH {WF}
SELECT {_READ_COLUMNS} FROM workforce""")
def read_employees_csv(spark, sf):
    """A5 then A1: the employee table as csv in the shared folder, read with its explicit schema."""
    (_, path), _ = _written(spark, sf, csv=True)
    return TB.read_employees(spark, path)


@q("latest_snapshot", f"""WITH {WF}
SELECT {_READ_COLUMNS}, AttritionProb FROM workforce""")
def latest_snapshot(spark, sf):
    """A5, A4, A3: the newest written scored table."""
    _, folder = _written(spark, sf)
    return TB.read_scored(spark, TB.latest_output(spark, [folder], "employees", preferred="run"))


@q("scan_scored", f"""WITH {SCORED}
SELECT EmployeeNumber, Department, JobRole, Attrition, OverTime, {R('AttritionProb')} AS AttritionProb, RiskLevel,
       pred AS predicted, act AS actual
FROM scored""")
def scan_scored(spark, sf):
    d = scored(spark, sf)
    return d.select("EmployeeNumber", "Department", "JobRole", "Attrition", "OverTime", "AttritionProb", "RiskLevel",
                    F.col(P.PREDICTED_LABEL_COL).alias("predicted"), F.col(P.ACTUAL_LABEL_COL).alias("actual"))


_RAW_NORM = f"""{RAW},
norm AS (
  SELECT CAST(COALESCE(TRY_CAST(EmployeeNumber AS DOUBLE), 0) AS BIGINT) AS EmployeeNumber,
         Department,
         'Unknown' AS JobRole,
         COALESCE(CASE WHEN trim(Attrition) IN ('Yes', 'No') THEN trim(Attrition) END,
                  CASE trim(Attrition) WHEN '1' THEN 'Yes' WHEN '0' THEN 'No' WHEN 'yes' THEN 'Yes' WHEN 'no' THEN 'No'
                       WHEN 'YES' THEN 'Yes' WHEN 'NO' THEN 'No' WHEN '1.0' THEN 'Yes' WHEN '0.0' THEN 'No' END, 'No') AS Attrition,
         COALESCE(CASE WHEN trim(OverTime) IN ('Yes', 'No') THEN trim(OverTime) END,
                  CASE trim(OverTime) WHEN '1' THEN 'Yes' WHEN '0' THEN 'No' WHEN 'Y' THEN 'Yes' WHEN 'N' THEN 'No'
                       WHEN 'yes' THEN 'Yes' WHEN 'no' THEN 'No' WHEN 'YES' THEN 'Yes' WHEN 'NO' THEN 'No'
                       WHEN '1.0' THEN 'Yes' WHEN '0.0' THEN 'No' END, 'No') AS OverTime,
         COALESCE(TRY_CAST(Age AS DOUBLE), {D(30)}) AS Age,
         prob
  FROM workforce_raw)"""


@q("normalize_workforce", f"""WITH {_RAW_NORM}
SELECT EmployeeNumber, Department, JobRole, Attrition, OverTime, Age,
       {D(10000)} AS MonthlyIncome, {D(3)} AS YearsAtCompany, '--' AS Gender, '--' AS BusinessTravel, '--' AS MaritalStatus
FROM norm""")
def normalize_workforce(spark, sf):
    d = N.normalize_workforce(FX.workforce_raw(spark, sf))
    return d.select("EmployeeNumber", "Department", "JobRole", "Attrition", "OverTime", "Age", "MonthlyIncome",
                    "YearsAtCompany", "Gender", "BusinessTravel", "MaritalStatus")


@q("canonical_flag", f"""WITH {_RAW_NORM}
SELECT EmployeeNumber, Attrition, OverTime FROM norm""")
def canonical_flag(spark, sf):
    return N.normalize_workforce(FX.workforce_raw(spark, sf)).select("EmployeeNumber", "Attrition", "OverTime")


@q("prob_rescale", f"""WITH {_RAW_NORM},
p AS (SELECT EmployeeNumber, COALESCE(TRY_CAST(prob AS DOUBLE), 0) AS p0 FROM norm),
mx AS (SELECT MAX(p0) AS m FROM p)
SELECT EmployeeNumber,
       {R(f"LEAST(GREATEST(CASE WHEN (SELECT m FROM mx) > 1 THEN p0 / 100.0 ELSE p0 END, {D(0)}), {D(1)})")} AS AttritionProb,
       CASE WHEN LEAST(GREATEST(CASE WHEN (SELECT m FROM mx) > 1 THEN p0 / 100.0 ELSE p0 END, {D(0)}), {D(1)}) >= {D(0.6)} THEN 'High Risk'
            WHEN LEAST(GREATEST(CASE WHEN (SELECT m FROM mx) > 1 THEN p0 / 100.0 ELSE p0 END, {D(0)}), {D(1)}) >= {D(0.35)} THEN 'Medium Risk'
            ELSE 'Low Risk' END AS RiskLevel
FROM p""")
def prob_rescale(spark, sf):
    d = N.add_risk_columns(N.normalize_workforce(FX.workforce_raw(spark, sf)))
    return d.select("EmployeeNumber", "AttritionProb", "RiskLevel")


@q("surrogate_key", f"""WITH {RAW}
SELECT row_number() OVER (ORDER BY Department ASC NULLS LAST, OverTime ASC NULLS LAST, Attrition ASC NULLS LAST,
                                   Age ASC NULLS LAST, prob ASC NULLS LAST) AS EmployeeNumber,
       Department, OverTime, Attrition, Age, prob
FROM workforce_raw""")
def surrogate_key(spark, sf):
    raw = FX.workforce_raw(spark, sf).drop("EmployeeNumber")
    return N.surrogate_key(raw, order_cols=["Department", "OverTime", "Attrition", "Age", "prob"])


@q("risk_columns", f"""WITH {DASH}
SELECT EmployeeNumber, {R('AttritionProb')} AS AttritionProb, RiskLevel FROM dash""")
def risk_columns(spark, sf):
    return dashboard(spark, sf).select("EmployeeNumber", "AttritionProb", "RiskLevel")


@q("income_compa", f"""WITH {DASH}
SELECT EmployeeNumber, JobRole, {R('IncomeMedianByRole')} AS IncomeMedianByRole, {R('IncomeCompa')} AS IncomeCompa
FROM dash""")
def income_compa(spark, sf):
    return dashboard(spark, sf).select("EmployeeNumber", "JobRole", "IncomeMedianByRole", "IncomeCompa")


@q("label_encode", f"""WITH {WF}
SELECT EmployeeNumber, CASE WHEN Attrition = 'Yes' THEN 1 WHEN Attrition = 'No' THEN 0 END AS AttritionFlag
FROM workforce""")
def label_encode(spark, sf):
    return N.label_encode(FX.workforce(spark, sf)).select("EmployeeNumber", "AttritionFlag")


@q("impute_median", f"""WITH {RAW},
a AS (SELECT EmployeeNumber, TRY_CAST(Age AS DOUBLE) AS Age, Department FROM workforce_raw),
m AS (SELECT quantile_cont(Age, 0.5) AS med FROM a)
SELECT EmployeeNumber, {R('COALESCE(Age, (SELECT med FROM m))')} AS Age, COALESCE(Department, 'Missing') AS Department
FROM a""")
def impute_median(spark, sf):
    raw = FX.workforce_raw(spark, sf).select("EmployeeNumber", F.col("Age").try_cast("double").alias("Age"),
                                             "Department")
    return N.impute_median(raw, numeric=["Age"], categorical=["Department"])


@q("features_numeric", f"""WITH {WF}
SELECT EmployeeNumber, {R('ln(1 + MonthlyIncome)')} AS MonthlyIncome_log FROM workforce""")
def features_numeric(spark, sf):
    return N.log1p_income(FX.workforce(spark, sf)).select("EmployeeNumber", "MonthlyIncome_log")


# ---------------------------------------------------------------- C ----

@q("filter_workforce", f"""WITH {DASH}
SELECT EmployeeNumber, Department, JobRole, RiskLevel FROM dash
WHERE Department = 'BUILDING' AND RiskLevel = 'High Risk'""")
def filter_workforce(spark, sf):
    return RK.filter_workforce(dashboard(spark, sf), dept="BUILDING", risk="High Risk").select(
        "EmployeeNumber", "Department", "JobRole", "RiskLevel")


@q("keyword_search", f"""WITH {DASH}
SELECT EmployeeNumber, Department, JobRole FROM dash
WHERE regexp_matches(CAST(EmployeeNumber AS VARCHAR), 'NATION_1[0-4]|^7')
   OR regexp_matches(Department, 'NATION_1[0-4]|^7') OR regexp_matches(JobRole, 'NATION_1[0-4]|^7')""")
def keyword_search(spark, sf):
    return RK.keyword_search(dashboard(spark, sf), "NATION_1[0-4]|^7").select("EmployeeNumber", "Department", "JobRole")


@q("employee_detail", f"""WITH {DASH}
SELECT EmployeeNumber, Department, JobRole, {R('AttritionProb')} AS AttritionProb, RiskLevel FROM dash
WHERE Department = 'HOUSEHOLD' ORDER BY AttritionProb DESC, EmployeeNumber ASC LIMIT 1""")
def employee_detail(spark, sf):
    d = dashboard(spark, sf)
    return RK.employee_detail(d, RK.filter_workforce(d, dept="HOUSEHOLD")).select(
        "EmployeeNumber", "Department", "JobRole", "AttritionProb", "RiskLevel")


@q("employee_lookup", f"""WITH {DASH}
SELECT EmployeeNumber, Department, JobRole, {R('AttritionProb')} AS AttritionProb FROM dash
WHERE CAST(EmployeeNumber AS VARCHAR) = '42'""")
def employee_lookup(spark, sf):
    d = dashboard(spark, sf)
    return RK.employee_detail(d, d, emp="42").select("EmployeeNumber", "Department", "JobRole", "AttritionProb")


@q("filter_options", f"""WITH {DASH}
SELECT DISTINCT 'Department' AS field, Department AS value FROM dash WHERE Department IS NOT NULL
UNION ALL
SELECT DISTINCT 'JobRole' AS field, JobRole AS value FROM dash WHERE JobRole IS NOT NULL""")
def filter_options(spark, sf):
    d = dashboard(spark, sf)
    a = AG.filter_options(d, "Department").select(F.lit("Department").alias("field"), F.col("Department").alias("value"))
    b = AG.filter_options(d, "JobRole").select(F.lit("JobRole").alias("field"), F.col("JobRole").alias("value"))
    return a.unionByName(b)


# ---------------------------------------------------------------- E ----

@q("home_kpis", f"""WITH {DASH}
SELECT COUNT(*) AS employees,
       round_even(AVG(CASE WHEN Attrition = 'Yes' THEN {D(1)} ELSE {D(0)} END) * 100, 1) AS attrition_rate,
       {R('AVG(YearsAtCompany)')} AS avg_tenure, {R('AVG(AttritionProb)')} AS avg_prob,
       COUNT(*) FILTER (WHERE RiskLevel = 'High Risk') AS high_risk
FROM dash""")
def home_kpis(spark, sf):
    return AG.home_kpis(dashboard(spark, sf))


@q("dashboard_kpis", f"""WITH {DASH}
SELECT COUNT(*) AS employees,
       round_even(AVG(CASE WHEN Attrition = 'Yes' THEN {D(1)} ELSE {D(0)} END) * 100, 1) AS attrition_rate,
       CAST(FLOOR(AVG(MonthlyIncome)) AS BIGINT) AS avg_income, {R('AVG(AttritionProb)')} AS avg_prob
FROM dash""")
def dashboard_kpis(spark, sf):
    return AG.dashboard_kpis(dashboard(spark, sf))


@q("headcount_by_dept", f"""WITH {DASH}
SELECT Department, COUNT(*) AS headcount FROM dash WHERE Department IS NOT NULL GROUP BY Department""")
def headcount_by_dept(spark, sf):
    return AG.headcount_by(dashboard(spark, sf), "Department")


@q("role_mix", f"""WITH {DASH}
SELECT JobRole, COUNT(*) AS headcount FROM dash WHERE JobRole IS NOT NULL GROUP BY JobRole""")
def role_mix(spark, sf):
    return AG.headcount_by(dashboard(spark, sf), "JobRole")


def _rate_sql(col: str) -> str:
    return f"""SELECT {col}, round_even(AVG(CASE WHEN Attrition = 'Yes' THEN {D(1)} ELSE {D(0)} END) * 100, 1) AS attrition_rate,
       COUNT(*) AS headcount FROM dash WHERE {col} IS NOT NULL GROUP BY {col}"""


@q("attrition_rate_by_dept", f"WITH {DASH}\n" + _rate_sql("Department"))
def attrition_rate_by_dept(spark, sf):
    return AG.attrition_rate(dashboard(spark, sf), "Department")


@q("attrition_rate_by_role_top12", f"""WITH {DASH},
r AS (SELECT JobRole, AVG(CASE WHEN Attrition = 'Yes' THEN {D(1)} ELSE {D(0)} END) * 100 AS r
      FROM dash WHERE JobRole IS NOT NULL GROUP BY JobRole)
SELECT JobRole, round_even(r, 1) AS attrition_rate FROM r ORDER BY r DESC, JobRole ASC LIMIT 12""")
def attrition_rate_by_role_top12(spark, sf):
    return AG.attrition_rate_top(dashboard(spark, sf), "JobRole", 12)


@q("rate_by_category", f"""WITH {DASH}
SELECT 'Gender' AS dimension, Gender AS value, round_even(AVG(CASE WHEN Attrition = 'Yes' THEN {D(1)} ELSE {D(0)} END) * 100, 1) AS attrition_rate
FROM dash WHERE Gender IS NOT NULL GROUP BY Gender
UNION ALL
SELECT 'BusinessTravel', BusinessTravel, round_even(AVG(CASE WHEN Attrition = 'Yes' THEN {D(1)} ELSE {D(0)} END) * 100, 1)
FROM dash WHERE BusinessTravel IS NOT NULL GROUP BY BusinessTravel
UNION ALL
SELECT 'MaritalStatus', MaritalStatus, round_even(AVG(CASE WHEN Attrition = 'Yes' THEN {D(1)} ELSE {D(0)} END) * 100, 1)
FROM dash WHERE MaritalStatus IS NOT NULL GROUP BY MaritalStatus""")
def rate_by_category(spark, sf):
    return AG.rate_by_category(dashboard(spark, sf))


@q("overtime_attrition_crosstab", f"""WITH {DASH},
dom AS (SELECT * FROM (VALUES ('No'), ('Yes')) t(v))
SELECT r.v AS OverTime, c.v AS Attrition,
       CAST((SELECT COUNT(*) FROM dash WHERE dash.OverTime = r.v AND dash.Attrition = c.v) AS BIGINT) AS headcount
FROM dom r CROSS JOIN dom c""")
def overtime_attrition_crosstab(spark, sf):
    return AG.overtime_attrition_crosstab(dashboard(spark, sf))


@q("dept_risk_heatmap", f"""WITH {DASH},
lv AS (SELECT * FROM (VALUES ('Low Risk'), ('Medium Risk'), ('High Risk')) t(RiskLevel)),
dp AS (SELECT DISTINCT COALESCE(Department, 'nan') AS Department FROM dash),
ct AS (SELECT dp.Department, lv.RiskLevel,
              CAST((SELECT COUNT(*) FROM dash d WHERE COALESCE(d.Department, 'nan') = dp.Department AND d.RiskLevel = lv.RiskLevel) AS BIGINT) AS headcount
       FROM dp CROSS JOIN lv),
mx AS (SELECT CASE WHEN MAX(headcount) <= 0 THEN 1 ELSE MAX(headcount) END AS m FROM ct)
SELECT Department, RiskLevel, headcount, {R(f'{D(0.15)} + {D(0.85)} * headcount / (SELECT m FROM mx)')} AS intensity
FROM ct""")
def dept_risk_heatmap(spark, sf):
    return AG.dept_risk_heatmap(dashboard(spark, sf))


_TENURE_CASE = """CASE WHEN YearsAtCompany > -1 AND YearsAtCompany <= 1 THEN '<1y'
            WHEN YearsAtCompany > 1 AND YearsAtCompany <= 3 THEN '1-3y'
            WHEN YearsAtCompany > 3 AND YearsAtCompany <= 5 THEN '3-5y'
            WHEN YearsAtCompany > 5 AND YearsAtCompany <= 8 THEN '5-8y'
            WHEN YearsAtCompany > 8 AND YearsAtCompany <= 100 THEN '8y+' END"""
_TENURE_DOM = "SELECT * FROM (VALUES ('<1y', 0), ('1-3y', 1), ('3-5y', 2), ('5-8y', 3), ('8y+', 4)) t(tenure_bucket, ord)"


@q("role_tenure_heatmap", f"""WITH {DASH},
rl AS (SELECT * REPLACE (COALESCE(JobRole, 'nan') AS JobRole) FROM dash),
top AS (SELECT JobRole FROM rl GROUP BY JobRole ORDER BY COUNT(*) DESC, JobRole ASC LIMIT 10),
b AS (SELECT JobRole, {_TENURE_CASE} AS tb FROM rl WHERE JobRole IN (SELECT JobRole FROM top)),
dom AS ({_TENURE_DOM}),
ct AS (SELECT t.JobRole, dom.tenure_bucket,
              CAST((SELECT COUNT(*) FROM b WHERE b.JobRole = t.JobRole AND b.tb = dom.tenure_bucket) AS BIGINT) AS headcount
       FROM top t CROSS JOIN dom),
mx AS (SELECT CASE WHEN MAX(headcount) <= 0 THEN 1 ELSE MAX(headcount) END AS m FROM ct)
SELECT JobRole, tenure_bucket, headcount, {R(f'{D(0.12)} + {D(0.88)} * headcount / (SELECT m FROM mx)')} AS intensity FROM ct""")
def role_tenure_heatmap(spark, sf):
    return AG.role_tenure_heatmap(dashboard(spark, sf))


@q("satisfaction_compare", f"""WITH {DASH},
g AS (SELECT CASE WHEN Attrition = 'No' THEN 'Stayed' WHEN Attrition = 'Yes' THEN 'Left' END AS grp, * FROM dash),
m AS (SELECT grp, AVG(JobSatisfaction) a, AVG(WorkLifeBalance) b, AVG(EnvironmentSatisfaction) c,
             AVG(RelationshipSatisfaction) d FROM g WHERE grp IS NOT NULL GROUP BY grp),
dom AS (SELECT * FROM (VALUES ('Stayed'), ('Left')) t(grp)),
j AS (SELECT dom.grp, m.a, m.b, m.c, m.d FROM dom LEFT JOIN m ON dom.grp = m.grp)
SELECT grp AS "group", 'Job Satisfaction' AS measure, COALESCE(round_even(a, 2), {D(0)}) AS mean_value FROM j
UNION ALL SELECT grp, 'Work-Life Balance', COALESCE(round_even(b, 2), {D(0)}) FROM j
UNION ALL SELECT grp, 'Environment', COALESCE(round_even(c, 2), {D(0)}) FROM j
UNION ALL SELECT grp, 'Relationships', COALESCE(round_even(d, 2), {D(0)}) FROM j""")
def satisfaction_compare(spark, sf):
    return AG.satisfaction_compare(dashboard(spark, sf))


@q("overtime_prob_summary", f"""WITH {DASH},
s AS (SELECT OverTime, AVG(AttritionProb) AS m, quantile_cont(AttritionProb, 0.5) AS q50,
             quantile_cont(AttritionProb, 0.75) AS q75 FROM dash GROUP BY OverTime),
dom AS (SELECT * FROM (VALUES ('No'), ('Yes')) t(OverTime))
SELECT dom.OverTime, {R(f'COALESCE(s.m, {D(0)})')} AS mean_prob, {R(f'COALESCE(s.q50, {D(0)})')} AS median_prob,
       {R(f'COALESCE(s.q75, {D(0)})')} AS p75_prob
FROM dom LEFT JOIN s ON dom.OverTime = s.OverTime""")
def overtime_prob_summary(spark, sf):
    return AG.overtime_prob_summary(dashboard(spark, sf))


def _linspace_sql(lo: float, hi: float, n: int) -> str:
    return "[" + ", ".join(f"CAST({repr(v)} AS DOUBLE)" for v in BN.linspace(lo, hi, n)) + "]"


_Q10 = _linspace_sql(0.0, 1.0, 11)


@q("income_decile_trend", f"""WITH {DASH},
st AS (SELECT quantile_cont(MonthlyIncome, {_Q10}) AS qe, MIN(MonthlyIncome) AS lo, MAX(MonthlyIncome) AS hi FROM dash),
e AS (SELECT qe, lo, hi, len(list_distinct(qe)) = 11 AS ok,
             list_transform(range(11), lambda i: CASE WHEN i = 0 THEN lo - (hi - lo) * 0.001 WHEN i = 10 THEN hi
                                              ELSE lo + i * ((hi - lo) / 10) END) AS ce FROM st),
b AS (SELECT d.AttritionProb,
             CASE WHEN e.ok THEN (CASE WHEN d.MonthlyIncome = e.qe[1] THEN 1
                                       ELSE len(list_filter(e.qe, lambda x: x < d.MonthlyIncome)) END)
                  ELSE len(list_filter(e.ce, lambda x: x < d.MonthlyIncome)) END AS k
      FROM dash d, e),
m AS (SELECT k, AVG(AttritionProb) AS mp FROM b WHERE k BETWEEN 1 AND 10 GROUP BY k)
SELECT 'Q' || CAST(r.k AS VARCHAR) AS decile, CAST(r.k AS INTEGER) AS decile_ord, {R('m.mp')} AS mean_prob
FROM (SELECT unnest(range(1, 11)) AS k) r LEFT JOIN m ON r.k = m.k""")
def income_decile_trend(spark, sf):
    return BN.income_decile_trend(dashboard(spark, sf))


@q("promotion_trend", f"""WITH {DASH}
SELECT LEAST(GREATEST(COALESCE(YearsSinceLastPromotion, 0), {D(0)}), {D(10)}) AS promo_years, {R('AVG(AttritionProb)')} AS mean_prob
FROM dash GROUP BY 1""")
def promotion_trend(spark, sf):
    return AG.promotion_trend(dashboard(spark, sf))


@q("confusion_matrix", f"""WITH {SCORED},
c AS (SELECT act, pred, COUNT(*) AS n FROM scored GROUP BY act, pred),
dom AS (SELECT a.v AS actual, p.v AS predicted FROM (VALUES (0), (1)) a(v) CROSS JOIN (VALUES (0), (1)) p(v)),
j AS (SELECT dom.actual, dom.predicted, CAST(COALESCE(c.n, 0) AS BIGINT) AS n FROM dom LEFT JOIN c
      ON dom.actual = c.act AND dom.predicted = c.pred)
SELECT actual, predicted, n, {R(f'{D(0.15)} + {D(0.85)} * n / GREATEST(1, (SELECT MAX(n) FROM j))')} AS intensity FROM j""")
def confusion_matrix(spark, sf):
    return AG.confusion_matrix(scored(spark, sf))


@q("classification_report", f"""WITH {SCORED},
c AS (SELECT COUNT(*) FILTER (WHERE pred = 1 AND act = 1) AS tp, COUNT(*) FILTER (WHERE pred = 0 AND act = 0) AS tn,
             COUNT(*) FILTER (WHERE pred = 1 AND act = 0) AS fp, COUNT(*) FILTER (WHERE pred = 0 AND act = 1) AS fn,
             COUNT(*) AS n FROM scored),
r AS (SELECT *, tp / GREATEST(tp + fp, 1) AS p, tp / GREATEST(tp + fn, 1) AS rc FROM c)
SELECT tp, tn, fp, fn, round(p, 3) AS precision, round(rc, 3) AS recall,
       round(2 * round(p, 3) * round(rc, 3) / GREATEST(round(p, 3) + round(rc, 3), 1e-9), 3) AS f1_display,
       {R('2 * p * rc / GREATEST(p + rc, 1e-9)')} AS f1,
       round((tp + tn) / GREATEST(n, 1), 3) AS accuracy
FROM r""")
def classification_report(spark, sf):
    return AG.classification_report(scored(spark, sf))


def _profile_sql(where: str) -> str:
    return f"""SELECT
  round(AVG(COALESCE(AttritionProb, 0)) * 100, 1) AS v0,
  round(AVG(CASE WHEN OverTime = 'Yes' THEN {D(1)} ELSE {D(0.2)} END) * 100, 1) AS v1,
  round(AVG((4.0 - LEAST(GREATEST(COALESCE(JobSatisfaction, 3), 1), 4)) / 4.0) * 100, 1) AS v2,
  round(AVG((4.0 - LEAST(GREATEST(COALESCE(WorkLifeBalance, 3), 1), 4)) / 4.0) * 100, 1) AS v3,
  round(AVG(LEAST(GREATEST(COALESCE(YearsSinceLastPromotion, 0), 0), 6) / 6.0) * 100, 1) AS v4,
  round(AVG(LEAST(GREATEST(1.0 - COALESCE(IncomeCompa, 1), 0), 1)) * 100, 1) AS v5,
  round(AVG(LEAST(GREATEST(COALESCE(DistanceFromHome, 0), 0), 30) / 30.0) * 100, 1) AS v6
FROM dash WHERE {where}"""


@q("risk_profile_segments", f"""WITH {DASH},
s AS (SELECT 'Average' AS segment, * FROM ({_profile_sql('TRUE')})
      UNION ALL SELECT 'Medium+High', * FROM ({_profile_sql("RiskLevel IN ('Medium Risk', 'High Risk')")})
      UNION ALL SELECT 'Low', * FROM ({_profile_sql("RiskLevel = 'Low Risk'")}))
""" + "\nUNION ALL ".join(
    f"SELECT segment, '{a}' AS axis, COALESCE(v{i}, {D(0)}) AS value FROM s" for i, a in enumerate(P.RADAR_AXES)))
def risk_profile_segments(spark, sf):
    return AG.risk_profile_segments(dashboard(spark, sf))


# ---------------------------------------------------------------- F ----

@q("tenure_buckets", f"""WITH {DASH},
c AS (SELECT {_TENURE_CASE} AS tb, COUNT(*) AS n FROM dash GROUP BY 1),
dom AS ({_TENURE_DOM})
SELECT dom.tenure_bucket, dom.ord, CAST(COALESCE(c.n, 0) AS BIGINT) AS headcount FROM dom LEFT JOIN c ON dom.tenure_bucket = c.tb""")
def tenure_buckets(spark, sf):
    return BN.tenure_buckets(dashboard(spark, sf))


_E10 = _linspace_sql(0.0, 1.0, 11)


@q("prob_histogram", f"""WITH {DASH},
e AS (SELECT {_E10} AS edges),
b AS (SELECT CASE WHEN d.AttritionProb = e.edges[11] THEN 9
                  ELSE len(list_filter(e.edges, lambda x: x <= d.AttritionProb)) - 1 END AS bin FROM dash d, e
      WHERE d.AttritionProb IS NOT NULL),
c AS (SELECT bin, COUNT(*) AS n FROM b WHERE bin BETWEEN 0 AND 9 GROUP BY bin)
SELECT CAST(r.bin AS INTEGER) AS bin, CAST(COALESCE(c.n, 0) AS BIGINT) AS n,
       e.edges[r.bin + 1] AS lower, e.edges[r.bin + 2] AS upper,
       printf('%.1f-%.1f', e.edges[r.bin + 1], e.edges[r.bin + 2]) AS label
FROM (SELECT unnest(range(10)) AS bin) r CROSS JOIN e LEFT JOIN c ON r.bin = c.bin""")
def prob_histogram(spark, sf):
    return BN.prob_histogram(dashboard(spark, sf))


@q("prob_histogram_auto", f"""WITH {DASH},
mm AS (SELECT MIN(AttritionProb) lo0, MAX(AttritionProb) hi0 FROM dash),
lh AS (SELECT CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo, CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM mm),
e AS (SELECT list_transform(range(31), lambda i: CASE WHEN i = 30 THEN hi ELSE lo + i * ((hi - lo) / 30) END) AS edges FROM lh),
b AS (SELECT CASE WHEN d.AttritionProb = e.edges[31] THEN 29
                  ELSE len(list_filter(e.edges, lambda x: x <= d.AttritionProb)) - 1 END AS bin FROM dash d, e
      WHERE d.AttritionProb IS NOT NULL),
c AS (SELECT bin, COUNT(*) AS n FROM b WHERE bin BETWEEN 0 AND 29 GROUP BY bin)
SELECT CAST(r.bin AS INTEGER) AS bin, CAST(COALESCE(c.n, 0) AS BIGINT) AS n,
       {R('e.edges[r.bin + 1]')} AS lower, {R('e.edges[r.bin + 2]')} AS upper
FROM (SELECT unnest(range(30)) AS bin) r CROSS JOIN e LEFT JOIN c ON r.bin = c.bin""")
def prob_histogram_auto(spark, sf):
    return BN.prob_histogram_auto(dashboard(spark, sf))


@q("quantile_bins_fallback", f"""WITH {DASH},
st AS (SELECT quantile_cont(JobSatisfaction, {_Q10}) AS qe, MIN(JobSatisfaction) AS lo, MAX(JobSatisfaction) AS hi FROM dash),
e AS (SELECT qe, len(list_distinct(qe)) = 11 AS ok,
             list_transform(range(11), lambda i: CASE WHEN i = 0 THEN lo - (hi - lo) * 0.001 WHEN i = 10 THEN hi
                                              ELSE lo + i * ((hi - lo) / 10) END) AS ce FROM st),
b AS (SELECT CASE WHEN e.ok THEN (CASE WHEN d.JobSatisfaction = e.qe[1] THEN 1
                                       ELSE len(list_filter(e.qe, lambda x: x < d.JobSatisfaction)) END)
                  ELSE len(list_filter(e.ce, lambda x: x < d.JobSatisfaction)) END AS k FROM dash d, e)
SELECT 'Q' || CAST(k AS VARCHAR) AS bin_label, CAST(k AS INTEGER) AS bin_ord, COUNT(*) AS n FROM b
WHERE k BETWEEN 1 AND 10 GROUP BY k""")
def quantile_bins_fallback(spark, sf):
    b = BN.qcut_or_cut(dashboard(spark, sf), "JobSatisfaction", 10, out="bin_label")
    return (b.where(F.col("bin_label").isNotNull()).groupBy("bin_label", "bin_label_ord")
            .agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("bin_label_ord", "bin_ord"))


@q("feature_bands", f"""WITH {WF}
SELECT EmployeeNumber,
  COALESCE(CASE WHEN YearsAtCompany <= 2 THEN '0-2年' WHEN YearsAtCompany <= 5 THEN '3-5年'
                WHEN YearsAtCompany <= 10 THEN '6-10年' WHEN YearsAtCompany > 10 THEN '10年以上' END, 'Missing') AS TenureBand,
  COALESCE(CASE WHEN DistanceFromHome <= 5 THEN '近距离' WHEN DistanceFromHome <= 15 THEN '中距离'
                WHEN DistanceFromHome > 15 THEN '远距离' END, 'Missing') AS CommuteBand,
  COALESCE(CASE WHEN YearsSinceLastPromotion <= 1 THEN '近期晋升' WHEN YearsSinceLastPromotion <= 3 THEN '观察期'
                WHEN YearsSinceLastPromotion > 3 THEN '长期未晋升' END, 'Missing') AS PromotionWaitBand
FROM workforce""")
def feature_bands(spark, sf):
    return BN.feature_bands(FX.workforce(spark, sf)).select("EmployeeNumber", "TenureBand", "CommuteBand",
                                                             "PromotionWaitBand")


# ---------------------------------------------------------------- G ----

def _pearson_sql(x: str, y: str) -> str:
    both = f"({x}) IS NOT NULL AND ({y}) IS NOT NULL"
    xx, yy = f"CASE WHEN {both} THEN {x} END", f"CASE WHEN {both} THEN {y} END"
    return f"covar_pop({xx}, {yy}) / NULLIF(stddev_pop({xx}) * stddev_pop({yy}), 0)"


_FLAG = f"CASE WHEN Attrition = 'Yes' THEN {D(1)} ELSE {D(0)} END"


def _corr_rows_sql(features) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{c}' AS feature, {_pearson_sql(c, _FLAG)} AS r, MIN({c}) < MAX({c}) AS ok, "
        f"COUNT(DISTINCT {c}) AS u, COUNT({c}) AS n FROM dash" for c in features)


@q("corr_with_target", f"""WITH {DASH},
c AS ({_corr_rows_sql(P.CORR_FEATURES)})
SELECT feature, round(r, 3) AS pearson_r FROM c WHERE ok AND r IS NOT NULL ORDER BY abs(r) DESC, feature ASC LIMIT 10""")
def corr_with_target(spark, sf):
    return CR.corr_with_target(dashboard(spark, sf))


@q("pearson_rank", f"""WITH {DASH},
c AS ({_corr_rows_sql(P.CORR_FEATURES)}),
k AS (SELECT feature, round(r, 6) AS pearson_r,
             CASE WHEN r > 0 THEN 'Positive' WHEN r < 0 THEN 'Negative' ELSE 'Neutral' END AS direction,
             CASE WHEN abs(r) < 0.10 THEN 'Very Weak' WHEN abs(r) < 0.30 THEN 'Weak' WHEN abs(r) < 0.50 THEN 'Moderate'
                  ELSE 'Strong' END AS strength, n AS rows_used
      FROM c WHERE u > 1 AND n >= 3 AND r IS NOT NULL AND NOT isnan(r))
SELECT * FROM k ORDER BY abs(pearson_r) DESC, feature ASC LIMIT 10""")
def pearson_rank(spark, sf):
    return CR.pearson_rank(dashboard(spark, sf), 10)


def _matrix_sql() -> str:
    cols = P.MATRIX_COLUMNS
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            parts.append(f"SELECT '{a}' AS row_feature, '{b}' AS col_feature, {i} AS row_ord, {j} AS col_ord, "
                         f"{_pearson_sql(cols[min(i, j)], cols[max(i, j)])} AS r FROM dash")
    return "\nUNION ALL ".join(parts)


@q("corr_matrix", f"""WITH {DASH},
m AS ({_matrix_sql()}),
v AS (SELECT row_feature, col_feature, row_ord, col_ord, COALESCE(CASE WHEN isnan(r) THEN 0 ELSE r END, {D(0)}) AS v FROM m)
SELECT row_feature, col_feature, CAST(row_ord AS INTEGER) AS row_ord, CAST(col_ord AS INTEGER) AS col_ord,
       round(v, 3) AS value, {R(f'{D(0.12)} + {D(0.88)} * LEAST(abs(v), 1)')} AS intensity FROM v""")
def corr_matrix(spark, sf):
    return CR.corr_matrix(dashboard(spark, sf))


def _impact_frame(spark, sf):
    from ..operators.normalize import log1p_income
    return log1p_income(FE.add_interaction_features(dashboard(spark, sf)))


_IMPACT_EXPR = {
    "OverTime_No": f"CASE WHEN OverTime = 'No' THEN {D(1)} ELSE {D(0)} END",
    "JobRole_Research Scientist": f"CASE WHEN JobRole = 'Research Scientist' THEN {D(1)} ELSE {D(0)} END",
    "JobRole_Laboratory Technician": f"CASE WHEN JobRole = 'Laboratory Technician' THEN {D(1)} ELSE {D(0)} END",
    "TravelRisk": f"CASE BusinessTravel WHEN 'Non-Travel' THEN {D(0)} WHEN 'Travel_Rarely' THEN {D(1)} "
                  f"WHEN 'Travel_Frequently' THEN {D(2)} ELSE {D(0)} END",
    "Age_WorkBalance": "Age * WorkLifeBalance",
    "MonthlyIncome_log": "ln(1 + MonthlyIncome)",
    "Income_per_YearAtCompany": "MonthlyIncome / (YearsAtCompany + 1)",
}
_IMPACT_LONG = f"""{DASH},
lng AS (""" + "\nUNION ALL ".join(
    f"SELECT EmployeeNumber AS id, COALESCE(AttritionProb, 0) AS t, '{f}' AS feature, {i} AS ord, "
    f"CAST({_IMPACT_EXPR.get(f, f)} AS DOUBLE) AS x FROM dash" for i, f in enumerate(P.IMPACT_FEATURES)) + """),
st AS (SELECT feature, ord, COUNT(*) AS n, """ + _pearson_sql("x", "t") + """ AS corr, AVG(x) AS mean,
              stddev_pop(x) AS std, MIN(x) AS xmin, MAX(x) AS xmax FROM lng WHERE x IS NOT NULL GROUP BY feature, ord
       HAVING COUNT(*) >= 8),
imp AS (SELECT l.id, l.feature, CAST(l.ord AS INTEGER) AS ord,
               LEAST(GREATEST((CASE WHEN s.std > 1e-12 THEN (l.x - s.mean) / s.std ELSE l.x * 0.0 END)
                              * COALESCE(s.corr, 0) * 2.6, -4.5), 4.5) AS impact,
               CASE WHEN s.xmax > s.xmin THEN (l.x - s.xmin) / (s.xmax - s.xmin) ELSE 0.5 END AS norm_value
        FROM lng l JOIN st s ON l.feature = s.feature AND l.ord = s.ord WHERE l.x IS NOT NULL)"""


@q("feature_impact", f"""WITH {_IMPACT_LONG}
SELECT id, feature, ord, {R('impact')} AS impact, {R('norm_value')} AS norm_value FROM imp""")
def feature_impact(spark, sf):
    return CR.feature_impact(_impact_frame(spark, sf))


@q("feature_impact_sample", f"""WITH {_IMPACT_LONG},
s AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY md5('7:' || CAST(id AS VARCHAR)), id) AS rn FROM imp)
SELECT id, feature, ord, {R('impact')} AS impact, {R('norm_value')} AS norm_value FROM s WHERE rn <= 140""")
def feature_impact_sample(spark, sf):
    imp = CR.feature_impact(_impact_frame(spark, sf))
    return RK.stratified_sample(imp, "feature", 140, key="id")


@q("feature_impact_range", f"""WITH {_IMPACT_LONG},
s AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY md5('7:' || CAST(id AS VARCHAR)), id) AS rn FROM imp),
m AS (SELECT MAX(abs(impact)) AS m FROM s WHERE rn <= 140)
SELECT CASE WHEN m IS NULL THEN {D(3)} ELSE LEAST({D(6)}, GREATEST({D(2.6)}, round(m + 0.5, 1))) END AS x_limit FROM m""")
def feature_impact_range(spark, sf):
    imp = CR.feature_impact(_impact_frame(spark, sf))
    return CR.impact_range(RK.stratified_sample(imp, "feature", 140, key="id"))


# ---------------------------------------------------------------- H / I ----

@q("top50_risk", f"""WITH {DASH}
SELECT EmployeeNumber, Department, JobRole, {R('AttritionProb')} AS AttritionProb, RiskLevel, Attrition
FROM dash ORDER BY AttritionProb DESC, EmployeeNumber ASC LIMIT 50""")
def top50_risk(spark, sf):
    return RK.top_at_risk(dashboard(spark, sf), 50).select("EmployeeNumber", "Department", "JobRole", "AttritionProb",
                                                           "RiskLevel", "Attrition")


@q("early_warning", f"""WITH {DASH},
t AS (SELECT * FROM dash ORDER BY AttritionProb DESC, EmployeeNumber ASC LIMIT 3),
r AS (SELECT EmployeeNumber, Department, AttritionProb,
             list_filter([CASE WHEN OverTime = 'Yes' THEN 'Overtime' END,
                          CASE WHEN COALESCE(JobSatisfaction, 4) <= 2 THEN 'Low satisfaction' END,
                          CASE WHEN COALESCE(WorkLifeBalance, 4) <= 2 THEN 'Poor work-life balance' END,
                          CASE WHEN COALESCE(YearsSinceLastPromotion, 0) >= 3 THEN 'Long since last promotion' END,
                          CASE WHEN COALESCE(IncomeCompa, 1) < 1 THEN 'Below role median pay' END], lambda x: x IS NOT NULL) AS rs
      FROM t)
SELECT EmployeeNumber, Department, {R('AttritionProb')} AS AttritionProb,
       CASE WHEN len(rs) = 0 THEN 'Review recommended' ELSE array_to_string(rs[1:3], ', ') END AS reasons FROM r""")
def early_warning(spark, sf):
    return RK.early_warning(dashboard(spark, sf), 3)


@q("employee_list", f"""WITH {DASH},
f AS (SELECT * FROM dash WHERE Department = 'MACHINERY')
SELECT EmployeeNumber, Department, JobRole, {R('AttritionProb')} AS AttritionProb, (SELECT COUNT(*) FROM f) AS total
FROM f ORDER BY AttritionProb DESC, EmployeeNumber ASC LIMIT 200""")
def employee_list(spark, sf):
    f = RK.filter_workforce(dashboard(spark, sf), dept="MACHINERY")
    return RK.employee_list(f, 200).select("EmployeeNumber", "Department", "JobRole", "AttritionProb", "total")


@q("employee_radar", f"""WITH {DASH},
t AS (SELECT * FROM dash ORDER BY AttritionProb DESC, EmployeeNumber ASC LIMIT 1),
v AS (SELECT EmployeeNumber, [COALESCE(AttritionProb, 0),
        CASE WHEN OverTime = 'Yes' THEN {D(1)} ELSE {D(0.2)} END,
        GREATEST(0, (4.0 - COALESCE(JobSatisfaction, 3)) / 4.0),
        GREATEST(0, (4.0 - COALESCE(WorkLifeBalance, 3)) / 4.0),
        LEAST(COALESCE(YearsSinceLastPromotion, 0) / 6.0, 1),
        LEAST(GREATEST(1.0 - COALESCE(IncomeCompa, 1), 0), 1),
        LEAST(COALESCE(DistanceFromHome, 0) / 30.0, 1)] AS vals FROM t)
SELECT EmployeeNumber, CAST(i - 1 AS INTEGER) AS axis_ord,
       {list(P.RADAR_AXES)}[i] AS axis, round(vals[i] * 100, 1) AS value
FROM v, (SELECT unnest(range(1, 8)) AS i)""")
def employee_radar(spark, sf):
    return RK.radar_values(RK.top_at_risk(dashboard(spark, sf), 1))


@q("stratified_sample", f"""WITH {DASH},
s AS (SELECT *, row_number() OVER (PARTITION BY Attrition ORDER BY md5('7:' || CAST(EmployeeNumber AS VARCHAR)), EmployeeNumber) AS rn
      FROM dash)
SELECT EmployeeNumber, Attrition, YearsAtCompany, MonthlyIncome FROM s WHERE rn <= 250""")
def stratified_sample(spark, sf):
    s = RK.stratified_sample(dashboard(spark, sf), "Attrition", 250)
    return s.select("EmployeeNumber", "Attrition", "YearsAtCompany", "MonthlyIncome")


@q("risk_rank", f"""WITH {SCORED}
SELECT EmployeeNumber, {R('AttritionProb')} AS probability, pred AS predicted,
       row_number() OVER (ORDER BY AttritionProb DESC, EmployeeNumber ASC) AS risk_rank
FROM scored WHERE AttritionProb IS NOT NULL""")
def risk_rank(spark, sf):
    s = scored(spark, sf).select("EmployeeNumber", F.col("AttritionProb").alias("probability"),
                                 F.col(P.PREDICTED_LABEL_COL).alias("predicted"))
    return RK.risk_rank(s)


@q("high_risk_list", f"""WITH {SCORED}
SELECT EmployeeNumber, {R('AttritionProb')} AS probability, pred AS predicted FROM scored WHERE pred = 1
UNION ALL
SELECT * FROM (SELECT EmployeeNumber, {R('AttritionProb')}, pred FROM scored ORDER BY AttritionProb DESC, EmployeeNumber LIMIT 30)
WHERE (SELECT COUNT(*) FROM scored WHERE pred = 1) = 0""")
def high_risk_list(spark, sf):
    s = scored(spark, sf).select("EmployeeNumber", F.col("AttritionProb").alias("probability"),
                                 F.col(P.PREDICTED_LABEL_COL).alias("predicted"))
    return RK.high_risk_list(s)


_DRIVER_FEATURES = ["Age", "MonthlyIncome", "DistanceFromHome", "YearsAtCompany", "JobSatisfaction"]


def _contrib_frame(spark, sf):
    """Per-row additive contributions: population z-scores of five features (a given, SQL-expressible input)."""
    d = dashboard(spark, sf)
    st = d.select(F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c)
                             for c in _DRIVER_FEATURES])).scalar()
    arr = F.array(*[F.struct(F.lit(c).alias("feature"),
                             ((F.col(c) - st[c]["m"]) / st[c]["s"]).alias("value")) for c in _DRIVER_FEATURES])
    return d.select("EmployeeNumber", arr.alias("contributions"))


@q("top3_drivers", f"""WITH {DASH},
st AS (SELECT {", ".join(f"AVG({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _DRIVER_FEATURES)} FROM dash),
c AS (SELECT EmployeeNumber, [{", ".join(f"{{'feature': '{c}', 'value': ({c} - m_{c}) / s_{c}}}" for c in _DRIVER_FEATURES)}] AS arr
      FROM dash, st),
s AS (SELECT EmployeeNumber, list_sort(list_transform(arr, lambda x: {{'k': -abs(x.value), 'f': x.feature, 'v': x.value}})) AS srt FROM c)
SELECT EmployeeNumber, array_to_string(list_transform(srt[1:3], lambda x: printf('%s(%.3f)', x.f, x.v)), '; ') AS top3_drivers FROM s""")
def top3_drivers(spark, sf):
    return RK.top3_drivers(_contrib_frame(spark, sf))


@q("cumulative_feature_select", f"""WITH {DASH},
c AS ({_corr_rows_sql(P.CORR_FEATURES)}),
imp AS (SELECT feature AS raw_feature, COALESCE(abs(r), 0) AS importance FROM c),
pool AS (SELECT * FROM imp WHERE importance > 0 OR (SELECT COUNT(*) FROM imp WHERE importance > 0) = 0),
rk AS (SELECT raw_feature, importance, row_number() OVER (ORDER BY importance DESC, raw_feature) AS pos,
              SUM(importance) OVER (ORDER BY importance DESC, raw_feature ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
              / GREATEST((SELECT SUM(importance) FROM pool), 1e-8) AS cum_ratio FROM pool),
k AS (SELECT GREATEST((SELECT COUNT(*) FROM rk WHERE cum_ratio <= 0.92) + 1,
                      LEAST(GREATEST(12, CEIL((SELECT COUNT(*) FROM imp) * 0.65)), (SELECT COUNT(*) FROM imp))) AS keep_n)
SELECT raw_feature, {R('importance')} AS importance, pos, {R('cum_ratio')} AS cum_ratio FROM rk WHERE pos <= (SELECT keep_n FROM k)""")
def cumulative_feature_select(spark, sf):
    d = dashboard(spark, sf)
    y = F.when(F.col("Attrition") == "Yes", 1.0).otherwise(0.0)
    imp = d.agg(*[F.abs(CR.pearson(F.col(c), y)).alias(c) for c in P.CORR_FEATURES])
    cells = F.array(*[F.struct(F.lit(c).alias("raw_feature"), F.coalesce(F.col(c), F.lit(0.0)).alias("importance"))
                      for c in P.CORR_FEATURES])
    return RK.cumulative_feature_select(imp.select(F.inline(cells)))
