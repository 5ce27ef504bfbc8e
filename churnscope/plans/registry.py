"""Driver registry: query key -> Spark plan builder, and key -> DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import dashboard_queries, evaluation_queries, model_queries, policy_queries
from .common import round_doubles

_MODULES = [dashboard_queries, policy_queries, evaluation_queries, model_queries]


def _load():
    spark_q: dict = {}
    sql_q: dict = {}
    for mod in _MODULES:
        spark_q.update(mod.SPARK)
        sql_q.update(mod.SQL)
    return spark_q, sql_q


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    spark_q, _ = _load()

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        return run
    return {k: wrap(v) for k, v in spark_q.items()}


def oracle_sql() -> dict[str, str]:
    _, sql_q = _load()
    return dict(sql_q)
