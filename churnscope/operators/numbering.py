"""Global 1..N numbering without moving all rows into one task.

Rows are put into buckets by their sort key's *values*: literal boundaries, computed once from a bounded sample,
cut the key's order into ranges.  A row's bucket hence doesn't depend on how tasks split the
data, so the numbers are 1..N however often and with whatever partitioning Spark evaluates the input.
Bucket sizes (one row for each bucket) give each bucket's offset, and ``row_number`` counts within a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

#: Ranges, and rows of the sample that their boundaries come from.
BUCKETS, SAMPLE = 64, 4096


def _sort_key(df: DataFrame, order: Sequence[tuple[str, bool]]) -> Column:
    """One orderable value for (column, descending) pairs; nulls last.  Descending columns are numeric."""
    parts = []
    for i, (name, descending) in enumerate(order):
        c = F.col(f"`{name}`")
        parts += [c.isNull().alias(f"n{i}"), (-c if descending else c).alias(f"v{i}")]
    return F.struct(*parts)


def global_row_number(df: DataFrame, order: Sequence[tuple[str, bool]], out: str) -> DataFrame:
    """``df`` plus ``out``: the row's place, from 1, in the order of (column, descending) pairs, nulls last.

    Rows that are equal in all those columns get different numbers in any order.
    """
    keyed = df.withColumn("__key", _sort_key(df, order))
    sample = keyed.select("__key").orderBy(F.xxhash64("__key")).limit(SAMPLE).orderBy("__key").collect()
    step = max(1, len(sample) // BUCKETS)
    cuts = sample[step::step][: BUCKETS - 1]
    # one row with at most BUCKETS keys
    schema = StructType([StructField("__cuts", ArrayType(keyed.schema["__key"].dataType))])
    bounds = df.sparkSession.createDataFrame([([r["__key"] for r in cuts],)], schema)
    keyed = keyed.crossJoin(F.broadcast(bounds)).withColumn("__bucket", F.size(F.filter("__cuts", lambda b: b <= F.col("__key")))).drop("__cuts")
    sizes = keyed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__bucket").orderBy("__key"))
    return keyed.join(F.broadcast(offsets), "__bucket").withColumn(out, (F.col("__before") + inside).cast("bigint")).drop("__key", "__bucket", "__before")

