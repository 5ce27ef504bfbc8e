"""Shared plan pieces for the driver queries: cached inputs and output rounding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..functions import params as P
from ..operators import normalize as N
from ..sources import fixtures as FX


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Hash-comparable doubles: every double column rounded to ``digits`` (sums depend on order)."""
    out = {f.name: F.round(F.col(f"`{f.name}`"), digits) for f in df.schema.fields
           if isinstance(f.dataType, (DoubleType, FloatType))}
    return df.withColumns(out) if out else df


def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """workforce -> normalize -> risk columns (the dashboard table)."""
    return N.dashboard_table(FX.workforce(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dashboard table with predicted / actual labels (threshold 0.5) like a model output sheet."""
    d = dashboard(spark, sf_dir)
    return d.withColumns({P.PREDICTED_LABEL_COL: F.when(F.col("AttritionProb") >= 0.5, 1).otherwise(0),
                          P.ACTUAL_LABEL_COL: F.when(F.col("Attrition") == "Yes", 1).otherwise(0)})
