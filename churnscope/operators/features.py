"""Derived employee features.

Each derived column is added only when its inputs exist (K5: plan-time check
of ``df.columns``); all of them are scalar expressions in one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .binning import feature_bands

SATISFACTION_SET = ["JobSatisfaction", "EnvironmentSatisfaction", "RelationshipSatisfaction", "WorkLifeBalance"]


def _c(name: str) -> Column:
    return F.col(name)


def _flag_le(name: str, v: float) -> Column:
    # pandas (x <= v).astype(float): NULL compares False -> 0.0
    return F.when(_c(name) <= v, 1.0).otherwise(0.0)


def add_interaction_features(df: DataFrame) -> DataFrame:
    """K1-K4 + F5 in the reference's order."""
    have = set(df.columns)
    new: dict[str, Column] = {}

    def has(*cs):
        return all(c in have or c in new for c in cs)

    def col(name):
        return new[name] if name in new else _c(name)

    if has("OverTime"):
        new["OverTimeFlag"] = F.coalesce(F.when(_c("OverTime") == "No", 0.0).when(_c("OverTime") == "Yes", 1.0),
                                         F.lit(0.0))
    if has("MonthlyIncome", "YearsAtCompany"):
        new["Income_per_YearAtCompany"] = _c("MonthlyIncome") / (_c("YearsAtCompany") + 1)
    if has("MonthlyIncome", "TotalWorkingYears"):
        new["Income_per_WorkYear"] = _c("MonthlyIncome") / (_c("TotalWorkingYears") + 1)
    if has("MonthlyIncome", "JobLevel"):
        new["Income_per_JobLevel"] = _c("MonthlyIncome") / (_c("JobLevel") + 1)
    if has("Age", "WorkLifeBalance"):
        new["Age_WorkBalance"] = _c("Age") * _c("WorkLifeBalance")
    if has("BusinessTravel"):
        bt = _c("BusinessTravel")
        new["TravelRisk"] = F.coalesce(F.when(bt == "Non-Travel", 0.0).when(bt == "Travel_Rarely", 1.0)
                                       .when(bt == "Travel_Frequently", 2.0), F.lit(0.0))
    sat = [c for c in SATISFACTION_SET if c in have]
    if sat:
        arr = F.filter(F.array(*[_c(c).cast("double") for c in sat]), lambda x: x.isNotNull())
        # pandas row mean / max / min skip NaN; all-NaN -> NaN
        new["SatisfactionIndex"] = F.when(F.size(arr) > 0,
                                          F.aggregate(arr, F.lit(0.0), lambda a, x: a + x) / F.size(arr))
        if len(sat) > 1:
            new["SatisfactionGap"] = F.array_max(arr) - F.array_min(arr)
    if has("JobInvolvement", "WorkLifeBalance"):
        new["EngagementBalanceScore"] = _c("JobInvolvement") * _c("WorkLifeBalance")
    if has("YearsSinceLastPromotion", "YearsAtCompany"):
        new["PromotionWaitRatio"] = _c("YearsSinceLastPromotion") / (_c("YearsAtCompany") + 1)
    if has("YearsInCurrentRole", "YearsAtCompany"):
        new["RoleStagnationRatio"] = _c("YearsInCurrentRole") / (_c("YearsAtCompany") + 1)
    if has("YearsWithCurrManager", "YearsAtCompany"):
        new["ManagerTenureRatio"] = _c("YearsWithCurrManager") / (_c("YearsAtCompany") + 1)
    if has("YearsInCurrentRole", "YearsSinceLastPromotion"):
        gap = _c("YearsInCurrentRole") - _c("YearsSinceLastPromotion")
        new["PromotionRoleGap"] = F.when(gap.isNull(), None).otherwise(F.greatest(gap, F.lit(0.0)))
    if has("NumCompaniesWorked", "TotalWorkingYears"):
        new["ExternalMobilityRatio"] = _c("NumCompaniesWorked") / (_c("TotalWorkingYears") + 1)
    if has("DistanceFromHome"):
        new["DistanceOverTimePressure"] = (_c("DistanceFromHome") * (1 + col("OverTimeFlag"))
                                           if "OverTimeFlag" in new else _c("DistanceFromHome"))
    if "TravelRisk" in new and "OverTimeFlag" in new:
        new["TravelOverTimeRisk"] = col("TravelRisk") * (1 + col("OverTimeFlag"))
    if has("StockOptionLevel"):
        new["LowStockOptionFlag"] = F.when(_c("StockOptionLevel") <= 0, 1.0).otherwise(0.0)
        if "OverTimeFlag" in new:
            new["LowStockOverTimeRisk"] = col("LowStockOptionFlag") * col("OverTimeFlag")
    stress = []
    if has("WorkLifeBalance"):
        new["LowWorkLifeFlag"] = _flag_le("WorkLifeBalance", 2)
        stress.append("LowWorkLifeFlag")
    if has("JobSatisfaction"):
        new["LowJobSatisfactionFlag"] = _flag_le("JobSatisfaction", 2)
        stress.append("LowJobSatisfactionFlag")
    if has("EnvironmentSatisfaction"):
        new["LowEnvironmentSatisfactionFlag"] = _flag_le("EnvironmentSatisfaction", 2)
        stress.append("LowEnvironmentSatisfactionFlag")
    if "OverTimeFlag" in new:
        stress.append("OverTimeFlag")
    if stress:
        total = F.lit(0.0)
        for s in stress:
            total = total + col(s)
        new["StressLoadScore"] = total
    # Dependent features reference the defining expressions (col() above), so one projection suffices.
    df = df.withColumns(new)
    return feature_bands(df)


def preprocess_employees(df: DataFrame, drop_cols=("Over18", "StandardHours", "DailyRate", "HourlyRate")) -> DataFrame:
    """Reference employee load: drop unused columns (the id is kept, R2), AttritionFlag,
    median / 'Missing' imputation, log income."""
    from .normalize import impute_median, label_encode, log1p_income
    df = df.drop(*[c for c in drop_cols if c in df.columns])
    if "Attrition" in df.columns:
        df = label_encode(df)
    from pyspark.sql.types import NumericType, StringType
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)
           and f.name not in ("EmployeeNumber",)]
    cat = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    df = impute_median(df, num, cat)
    return log1p_income(df)
