"""Global numbers are 1..N in order, whatever the partitioning and AQE do."""

import pytest
from pyspark.sql import functions as F

from churnscope.operators import normalize as N
from churnscope.operators import ranking as R

CONF = ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")


@pytest.mark.parametrize("aqe", ["true", "false"])
@pytest.mark.parametrize("partitions", ["8", "64"])
def test_ranks_are_complete_and_ordered(spark, aqe, partitions):
    before = [spark.conf.get(k) for k in CONF]
    for k, v in zip(CONF, (aqe, partitions)):
        spark.conf.set(k, v)
    try:
        df = spark.range(15_000).select(
            F.col("id").alias("EmployeeNumber"),
            F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.round(F.rand(3), 2)).alias("probability"),  # a third ties
            *[F.repeat(F.md5(F.concat(F.lit(str(i)), F.col("id").cast("string"))), 4).alias(f"wide{i}") for i in range(5)],
        )
        rows = R.risk_rank(df).select("risk_rank", "probability", "EmployeeNumber").collect()
        assert sorted(r.risk_rank for r in rows) == list(range(1, 15_001))
        want = sorted(rows, key=lambda r: (-r.probability, r.EmployeeNumber))
        assert [r.risk_rank for r in want] == list(range(1, 15_001))
        named = df.select((F.col("EmployeeNumber") % 7).alias("Age"), F.when(F.col("EmployeeNumber") % 5 > 0, F.col("wide0")).alias("JobRole"), "wide1")
        keys = [r.EmployeeNumber for r in N.surrogate_key(named).select("EmployeeNumber").collect()]
        assert sorted(keys) == list(range(1, 15_001))
    finally:
        for k, v in zip(CONF, before):
            spark.conf.set(k, v)


def test_empty_and_one_row(spark):
    df = spark.createDataFrame([], "EmployeeNumber long, probability double")
    assert R.risk_rank(df).collect() == []
    one = spark.createDataFrame([(3, 0.5), (4, None)], "EmployeeNumber long, probability double")
    assert [(r.EmployeeNumber, r.risk_rank) for r in R.risk_rank(one).collect()] == [(3, 1)]
