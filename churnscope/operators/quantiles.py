"""Exact quantiles of many columns, at many fractions, for many groups.

``percentile`` gathers a group's distinct values in one task.  Here ranks are found by range refinement:

1. One aggregate counts rows by (group, column, range); ranges are PER_OCTAVE to a doubling of the value's size, so a
   group has a bounded number of them.  Running sums give the ranks that each range holds.
2. Ranges that hold a wanted rank, and more than one value, are cut into STEPS between their own least and greatest value
   and counted again, as long as any holds more than EXACT rows of different values.
3. The values that are left are counted one by one and ranked inside their range.

Rows of other ranges are never sorted or moved again, a group with most of all values is spread over its ranges, and only one
number for each pass comes to the driver.  Fractions are interpolated linearly between the neighbouring ranks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

PER_OCTAVE, STEPS, EXACT = 64, 4096, 100_000
#: Passes after which the values are ranked whatever their number: each cuts a range's width by STEPS.
MOST_PASSES = 8


def _first_range(x: Column) -> Column:
    """A range's number, ascending with the value."""
    size = F.least(F.log2(F.abs(x) + 1.0), F.lit(1100.0))
    return F.floor(F.signum(x) * size * PER_OCTAVE).cast("long")


def _counted(rows: DataFrame) -> DataFrame:
    """Ranges of rows (g, c, x, parent, base, s): their size, ends and the number of smaller values in the group."""
    r = rows.groupBy("g", "c", "parent", "base", "s").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    below = F.sum("n").over(Window.partitionBy("g", "c", "parent").orderBy("s")) - F.col("n")
    return r.withColumn("base", F.col("base") + below)


def _held(ranges: DataFrame) -> DataFrame:
    """Ranges that hold some of their wanted ``ranks``, with those."""
    own = F.filter("ranks", lambda r: (r >= F.col("base")) & (r < F.col("base") + F.col("n")))
    return ranges.withColumn("ranks", own).where(F.size("ranks") > 0)


def exact_quantiles(df: DataFrame, wanted: Mapping[str, Sequence[float] | tuple[Column, Sequence[float]]], by: Sequence[str] = ()) -> DataFrame:
    """One row for each group (one row without ``by``): for each name of ``wanted`` an array with its quantiles.

    ``wanted``: name -> fractions of the column of that name, or (expression, fractions).  Nulls and NaN don't count; a
    group without values has null instead of an array (or no row, if that holds for all names).
    """
    names = list(wanted)
    exprs, fractions = [], []
    for name in names:
        expr, own = wanted[name] if isinstance(wanted[name], tuple) else (F.col(f"`{name}`"), wanted[name])
        x = expr.cast("double")
        exprs.append(F.when(~F.isnan(x), x))
        fractions.append([float(f) for f in own])
    group = F.struct(*[F.col(f"`{c}`") for c in by]) if by else F.struct(F.lit(0).alias("all"))
    cells = F.array(*[F.struct(F.lit(i).alias("c"), x.alias("x")) for i, x in enumerate(exprs)])
    rows = df.select(group.alias("g"), F.inline(cells)).where("x is not null")
    rows = rows.select("g", "c", "x", F.lit("").alias("parent"), F.lit(0).cast("long").alias("base"), _first_range(F.col("x")).alias("s"))

    asked = F.get(F.array(*[F.array(*[F.lit(f) for f in own]) for own in fractions]), F.col("c"))
    first = _counted(rows)
    first = first.withColumn("total", F.sum("n").over(Window.partitionBy("g", "c")))
    at = F.transform(asked, lambda f: f * (F.col("total") - 1))
    ranks = F.array_distinct(F.flatten(F.transform(at, lambda h: F.array(F.floor(h), F.ceil(h)))))
    held = cut_lineage(_held(first.withColumn("ranks", ranks)))  # a few ranges for each group, column and fraction
    totals = held.select("g", "c", "total").distinct()

    found = []
    for again in range(MOST_PASSES):
        found.append(held.where("lo = hi").select("g", "c", "ranks", F.col("lo").alias("x")))
        open_ = held.where("lo < hi").select("g", "c", F.concat_ws(".", "parent", F.col("s").cast("string")).alias("path"), "lo", "hi", "base", "ranks", "n")
        most = open_.agg(F.max("n")).first()[0]
        if most is None:
            break
        here = rows.withColumn("path", F.concat_ws(".", "parent", F.col("s").cast("string"))).drop("base", "parent", "s").alias("r")
        near = open_.drop("ranks", "n").alias("o")
        same = F.col("r.g").eqNullSafe(F.col("o.g")) & (F.col("r.c") == F.col("o.c")) & (F.col("r.path") == F.col("o.path"))
        rows = here.join(near, same).select("r.g", "r.c", "r.x", F.col("r.path").alias("parent"), "base", "lo", "hi")
        if most <= EXACT or again == MOST_PASSES - 1:
            rows = rows.select("g", "c", "x", "parent", "base", F.col("x").alias("s"))
        else:
            width = F.col("hi") / 2 - F.col("lo") / 2  # halves don't overflow; the tiniest may vanish
            part = F.when(width > 0, F.floor((F.col("x") / 2 - F.col("lo") / 2) / F.nullif(width, F.lit(0.0)) * STEPS).cast("double"))
            rows = rows.select("g", "c", "x", "parent", "base", F.coalesce(part, (F.col("x") > F.col("lo")).cast("double")).alias("s"))
        left, right = _counted(rows).alias("n"), open_.select("g", "c", "path", "ranks").alias("o")
        same = F.col("n.g").eqNullSafe(F.col("o.g")) & (F.col("n.c") == F.col("o.c")) & (F.col("n.parent") == F.col("o.path"))
        held = cut_lineage(_held(left.join(right, same).select("n.*", "o.ranks")))

    values = found[0]
    for more in found[1:]:
        values = values.unionByName(more)
    values = values.select("g", "c", "x", F.explode("ranks").alias("rank"))
    known = values.groupBy("g", "c").agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("m"))  # two ranks a fraction
    same = F.col("k.g").eqNullSafe(F.col("t.g")) & (F.col("k.c") == F.col("t.c"))
    known = known.alias("k").join(totals.alias("t"), same).select("k.g", "k.c", "m", "total")

    def value(f: Column) -> Column:
        h = f * (F.col("total") - 1)
        low, high = F.element_at("m", F.floor(h)), F.element_at("m", F.ceil(h))
        return low + (h - F.floor(h)) * (high - low)

    known = known.withColumn("q", F.transform(asked, value))
    out = [F.first(F.when(F.col("c") == i, F.col("q")), ignorenulls=True).alias(name) for i, name in enumerate(names)]
    if not by:
        return known.agg(*out)
    return known.groupBy("g").agg(*out).select("g.*", *[f"`{n}`" for n in names])


def group_quantile(df: DataFrame, column: str, by: str, fraction: float, out: str) -> DataFrame:
    """``by`` and ``out``: one quantile of ``column`` for each group, as a lazy plan.

    For columns that many plans carry along and few of them use: Spark drops the whole computation where ``out`` isn't read.
    The group's distinct values are counted once, ranges of a fixed fineness (16 * PER_OCTAVE to a doubling) get the number of values below
    them, and values are ranked within their range, so no task holds a group.
    """
    x = F.col(f"`{column}`").cast("double")
    rows = df.select(F.col(f"`{by}`").alias(by), F.when(~F.isnan(x), x).alias("__x")).where("__x is not null")
    counts = rows.groupBy(by, "__x").agg(F.count(F.lit(1)).alias("__n"))
    size = F.least(F.log2(F.abs("__x") + 1.0), F.lit(1100.0))
    counts = counts.withColumn("__r", F.floor(F.signum("__x") * size * 16 * PER_OCTAVE).cast("long"))
    whole = Window.partitionBy(by)
    ranges = counts.groupBy(by, "__r").agg(F.sum("__n").alias("__own"))  # bounded for each group
    ranges = ranges.select(F.col(by).alias("__g"), F.col("__r").alias("__s"), (F.sum("__own").over(whole.orderBy("__r")) - F.col("__own")).alias("__below"), F.sum("__own").over(whole).alias("__all"))
    values = counts.join(ranges, F.col(by).eqNullSafe(F.col("__g")) & (F.col("__r") == F.col("__s"))).drop("__g", "__s")
    inside = Window.partitionBy(by, "__r").orderBy("__x").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("__below") + F.coalesce(F.sum("__n").over(inside), F.lit(0))
    values = values.withColumns({"__at": first, "__h": F.lit(float(fraction)) * (F.col("__all") - 1)})
    holds = lambda rank: F.max(F.when((F.col("__at") <= rank) & (rank < F.col("__at") + F.col("__n")), F.col("__x")))
    h = F.col("__h")
    low, high, part = holds(F.floor(h)), holds(F.ceil(h)), F.max(h - F.floor(h))
    return values.groupBy(by).agg((low + part * (high - low)).alias(out))
