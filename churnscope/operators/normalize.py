"""Schema repair and derived risk columns.

``normalize_workforce`` repairs an arbitrary employee table into the dashboard
schema; ``add_risk_columns`` adds AttritionProb / RiskLevel / IncomeCompa.
Global statistics (column max, per-role medians) are aggregates that Spark
computes once; per-row work stays in one projection.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import params as P
from ..functions.numeric import clip, try_double
from .numbering import global_row_number
from .quantiles import exact_quantiles, group_quantile


def resolve_first(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """First candidate present among ``columns`` (plan-time)."""
    for c in candidates:
        if c in columns:
            return c
    return None


def trim_and_rename(df: DataFrame, aliases: Sequence[tuple[str, str]] = P.RENAME_ALIASES) -> DataFrame:
    """B1: strip column names, then rename an alias when its target is absent."""
    df = df.toDF(*[str(c).strip() for c in df.columns])
    for src, dst in aliases:
        if src in df.columns and dst not in df.columns:
            df = df.withColumnRenamed(src, dst)
    return df


def canonical_flag(c, mapping: Mapping[str, str], default: str = "No") -> Column:
    """Trimmed string through a Yes/No dictionary; anything else -> default.

    pandas ``astype(str)`` turns a missing value into 'nan'/'None', which then
    falls to the default, so NULL maps to the default here too.
    """
    s = F.trim(F.col(c).cast("string")) if isinstance(c, str) else F.trim(c.cast("string"))
    keep = F.when(s.isin("Yes", "No"), s)
    mapped = F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), s)
    return F.coalesce(keep, mapped, F.lit(default))


def surrogate_key(df: DataFrame, key: str = "EmployeeNumber", order_cols: Sequence[str] | None = None) -> DataFrame:
    """1..N surrogate key when the id column is missing, in the order of ``order_cols``."""
    if key in df.columns:
        return df
    return global_row_number(df, [(c, False) for c in order_cols or df.columns], key)


def normalize_workforce(df: DataFrame,
                        aliases: Sequence[tuple[str, str]] = P.RENAME_ALIASES,
                        defaults: Mapping[str, float] = P.NUMERIC_DEFAULTS,
                        accept_float_labels: bool = True) -> DataFrame:
    """Repaired employee table (schema of the dashboard)."""
    df = trim_and_rename(df, aliases)
    cols = df.columns
    out: dict[str, Column] = {}
    if "EmployeeNumber" not in cols:
        df = surrogate_key(df)
        cols = df.columns
    for c in ("Department", "JobRole"):
        if c not in cols:
            out[c] = F.lit("Unknown")
    att_map = dict(P.ATTRITION_VALUES)
    ot_map = dict(P.OVERTIME_VALUES)
    if accept_float_labels:
        att_map.update(P.FLOAT_LABEL_VALUES)
        ot_map.update(P.FLOAT_LABEL_VALUES)
    if "Attrition" in cols:
        out["Attrition"] = canonical_flag("Attrition", att_map)
    elif P.ACTUAL_LABEL_COL in cols:
        y = F.coalesce(F.col(P.ACTUAL_LABEL_COL).try_cast("double").cast("int"), F.lit(0))
        out["Attrition"] = F.when(y == 1, "Yes").otherwise("No")
    else:
        out["Attrition"] = F.lit("No")
    for c, d in defaults.items():
        out[c] = F.coalesce(try_double(c), F.lit(float(d))) if c in cols else F.lit(float(d))
    out["OverTime"] = canonical_flag("OverTime", ot_map) if "OverTime" in cols else F.lit("No")
    for c in P.DASH_DEFAULT_COLUMNS:
        out[c] = F.coalesce(F.col(c).cast("string"), F.lit("--")) if c in cols else F.lit("--")
    for c in (P.PREDICTED_LABEL_COL, P.ACTUAL_LABEL_COL):
        if c in cols:
            out[c] = F.coalesce(F.col(c).try_cast("double").cast("int"), F.lit(0))
    out["EmployeeNumber"] = F.coalesce(try_double("EmployeeNumber").cast("bigint"), F.lit(0).cast("bigint"))
    return df.withColumns(out)


def risk_level(p) -> Column:
    """High / Medium / Low risk from a probability."""
    p = F.col(p) if isinstance(p, str) else p
    return (F.when(p >= P.RISK_HIGH, "High Risk").when(p >= P.RISK_MEDIUM, "Medium Risk")
            .otherwise("Low Risk"))


def rescale_probability(df: DataFrame, src: str | None, out: str = "AttritionProb",
                        rescale: bool = True) -> DataFrame:
    """Numeric probability, divided by 100 when the column max exceeds 1, clipped to [0,1].

    The column max is a scalar subquery: one small aggregate job whose single
    value is inlined into the projection (no join, no window).
    """
    if src is None:
        return df.withColumn(out, F.lit(0.0))
    p = F.coalesce(try_double(src), F.lit(0.0))
    if rescale:
        pmax = df.select(F.max(p).alias("m")).scalar()
        p = F.when(F.coalesce(pmax, F.lit(0.0)) > 1.0, p / 100.0).otherwise(p)
    return df.withColumn(out, F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))


def role_income_median(df: DataFrame, role: str = "JobRole", income: str = "MonthlyIncome") -> DataFrame:
    """D1 (aggregate side): exact median income per role (pandas drops NULL roles, T22)."""
    return group_quantile(df.where(F.col(role).isNotNull()), income, role, 0.5, "IncomeMedianByRole")


def add_income_compa(df: DataFrame, role: str = "JobRole", income: str = "MonthlyIncome") -> DataFrame:
    """IncomeMedianByRole mapped back to rows, IncomeCompa clipped to [0.5, 1.8].

    The per-role median table has one row per role; AQE broadcasts it when its
    measured size is under the broadcast threshold, else it is a shuffle join.
    """
    med = role_income_median(df, role, income)
    out = df.join(med, on=role, how="left")
    ratio = F.col(income) / F.nullif(F.col("IncomeMedianByRole"), F.lit(0.0))
    compa = F.coalesce(ratio, F.lit(1.0))
    return out.withColumn("IncomeCompa", F.least(F.greatest(compa, F.lit(P.COMPA_MIN)), F.lit(P.COMPA_MAX)))


def add_risk_columns(df: DataFrame, prob_candidates: Sequence[str] = P.PROB_COLUMN_CANDIDATES,
                     rescale: bool = True) -> DataFrame:
    """B8-B10 + D1: the dashboard table."""
    src = resolve_first(df.columns, prob_candidates)
    df = rescale_probability(df, src, rescale=rescale)
    df = df.withColumn("RiskLevel", risk_level("AttritionProb"))
    return add_income_compa(df)


def dashboard_table(df: DataFrame) -> DataFrame:
    """normalize -> risk columns: the table every dashboard query reads."""
    return add_risk_columns(normalize_workforce(df))


def label_encode(df: DataFrame, col: str = "Attrition", out: str = "AttritionFlag") -> DataFrame:
    """Yes -> 1, No -> 0, anything else NULL."""
    return df.withColumn(out, F.when(F.col(col) == "Yes", 1).when(F.col(col) == "No", 0))


def impute_median(df: DataFrame, numeric: Sequence[str] | None = None,
                  categorical: Sequence[str] | None = None) -> DataFrame:
    """Numeric NULL -> column median (exact, interpolated), string NULL -> 'Missing'.

    All medians come from one range refinement; their single row is inlined through a
    scalar subquery per column.
    """
    from pyspark.sql.types import NumericType, StringType
    fields = df.schema.fields
    if numeric is None:
        numeric = [f.name for f in fields if isinstance(f.dataType, NumericType)]
    if categorical is None:
        categorical = [f.name for f in fields if isinstance(f.dataType, StringType)]
    out: dict[str, Column] = {}
    if numeric:
        med = exact_quantiles(df.select(*numeric), {c: [0.5] for c in numeric})
        s = med.select(F.struct(*[F.col(c)[0].alias(c) for c in numeric]).alias("m")).scalar()
        for c in numeric:
            out[c] = F.coalesce(F.col(c).cast("double"), s[c])
    for c in categorical:
        out[c] = F.coalesce(F.col(c), F.lit("Missing"))
    return df.withColumns(out)


def log1p_income(df: DataFrame, col: str = "MonthlyIncome") -> DataFrame:
    """B14."""
    if col not in df.columns:
        return df
    return df.withColumn(f"{col}_log", F.log1p(F.col(col)))
