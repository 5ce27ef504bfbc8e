"""Numeric column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def try_double(c) -> Column:
    """Tolerant numeric parse (pandas ``to_numeric(errors='coerce')``, traps T1 and T3).

    NaN becomes NULL so it cannot poison ``corr``/``greatest`` later.
    """
    d = _col(c).try_cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def clip(c, lo=None, hi=None) -> Column:
    """pandas ``clip``: NULL stays NULL (trap T21)."""
    x = _col(c)
    out = x
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(out)


def with_scalars(df, stats):
    """Attach the columns of a ONE-ROW aggregate to every row of ``df``.

    ``stats`` must be a global aggregate (exactly one row, so its size is
    bounded by construction); it is broadcast and joined on a constant key,
    which keeps the lookup a map-side hash join and lets array columns feed
    higher-order functions (scalar subqueries cannot appear inside lambdas).
    """
    key = "__one"
    return (df.withColumn(key, F.lit(1))
            .join(F.broadcast(stats.withColumn(key, F.lit(1))), key)
            .drop(key))
