"""Test views over the driver tables (FIXTURES.md), built with the DataFrame API.

The reference ships no data.  These views recreate its input schemas from the
TPC-H-style tables: ``workforce`` (one row per customer with orders),
``workforce_raw`` (dirty strings), ``model_scores`` (three probability columns)
and ``policies`` (one row per document, whole text, every document).

The DuckDB twins used by the oracle are the ``*_SQL`` strings at the bottom.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dictionary import Dictionary, load

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Employee table: customer x nation x per-customer order statistics."""
    orders = table(spark, sf_dir, "orders")
    status_f = F.col("o_orderstatus") == "F"
    urgent = F.col("o_orderpriority") == "1-URGENT"
    o = (orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_ord"),
        F.sum(F.when(status_f, 1).otherwise(0)).alias("n_f"),
        F.sum(F.when(status_f & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1).otherwise(0)).alias("n_fh"),
        F.sum(F.when(urgent, 1).otherwise(0)).alias("n_urg"),
        F.min(F.year("o_orderdate")).alias("first_y")))
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k = F.col("c_custkey")
    df = (c.join(n, c.c_nationkey == n.n_nationkey)
          .join(o, o.o_custkey == c.c_custkey))
    dbl = lambda e: e.cast("double")
    return df.select(
        k.cast("bigint").alias("EmployeeNumber"),
        F.col("c_mktsegment").alias("Department"),
        F.col("n_name").alias("JobRole"),
        F.when(k % 3 == 0, "Technical").when(k % 3 == 1, "Marketing").otherwise("Other").alias("EducationField"),
        F.when(k % 2 == 0, "Female").otherwise("Male").alias("Gender"),
        F.when(k % 5 == 0, "Single").when(k % 5 == 1, "Divorced").otherwise("Married").alias("MaritalStatus"),
        F.when((k * 3) % 7 == 0, "Non-Travel").when((k * 3) % 7 <= 2, "Travel_Frequently")
        .otherwise("Travel_Rarely").alias("BusinessTravel"),
        dbl(18 + (k * 7) % 43).alias("Age"),
        F.round(F.col("c_acctbal") + 1000.0, 2).alias("MonthlyIncome"),
        dbl(F.col("n_ord")).alias("YearsAtCompany"),
        dbl(F.floor(dbl(F.col("n_ord") * ((k % 5) + 1)) / 5)).alias("YearsInCurrentRole"),
        dbl((k * 17) % 13).alias("YearsSinceLastPromotion"),
        dbl((k * 13) % 9).alias("YearsWithCurrManager"),
        dbl(F.col("n_ord") + 2001 - F.col("first_y")).alias("TotalWorkingYears"),
        dbl((k * 11) % 29 + 1).alias("DistanceFromHome"),
        dbl((k * 19) % 10).alias("NumCompaniesWorked"),
        dbl(11 + (k * 23) % 15).alias("PercentSalaryHike"),
        dbl((k * 5) % 7).alias("TrainingTimesLastYear"),
        dbl(1 + k % 4).alias("JobSatisfaction"),
        dbl(1 + (k * 3 + F.col("n_urg")) % 4).alias("WorkLifeBalance"),
        dbl(1 + (k * 5 + F.col("n_f")) % 4).alias("EnvironmentSatisfaction"),
        dbl(1 + (k + F.col("n_ord")) % 4).alias("RelationshipSatisfaction"),
        dbl(1 + (k * 7 + F.col("n_ord")) % 4).alias("JobInvolvement"),
        dbl(1 + (k * 2) % 5).alias("JobLevel"),
        dbl((k * 3) % 4).alias("StockOptionLevel"),
        F.when(F.col("n_urg") >= 3, "Yes").otherwise("No").alias("OverTime"),
        F.when(F.col("n_fh") * 4 >= F.col("n_ord"), "Yes").otherwise("No").alias("Attrition"),
        F.round(dbl(F.col("n_f")) / F.col("n_ord"), 3).alias("AttritionProb"),
    )


def workforce_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty string columns for schema repair."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.cast("string").alias("EmployeeNumber"),
        F.when(k % 11 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")).alias("Department"),
        F.when(k % 6 == 0, " yes ").when(k % 6 == 1, "1").when(k % 6 == 2, "NO").when(k % 6 == 3, "maybe")
        .when(k % 6 == 4, "Y").otherwise(F.lit(None)).alias("OverTime"),
        F.when(k % 5 == 0, "YES").when(k % 5 == 1, "0").when(k % 5 == 2, "no").when(k % 5 == 3, "1.0")
        .otherwise("Yes").alias("Attrition"),
        F.when(k % 7 == 0, "n/a").when(k % 7 == 1, "").otherwise((18 + k % 43).cast("string")).alias("Age"),
        (k % 101).cast("string").alias("prob"),
    )


def model_scores(wf: DataFrame) -> DataFrame:
    """Three base-model probabilities per employee (L13-L24 inputs)."""
    e = F.col("EmployeeNumber")
    p = F.col("AttritionProb")
    return wf.select(
        e.alias("id"),
        F.when(F.col("Attrition") == "Yes", 1).otherwise(0).alias("y"),
        p.alias("p_a"),
        ((200 + F.floor(p * 600) + 10 * ((e * 7) % 20)).cast("double") / 1000).alias("p_b"),
        ((50 + F.floor(p * 500) + 20 * (4 - F.col("JobSatisfaction")) + 10 * ((e * 13) % 25)).cast("double")
         / 1000).alias("p_c"),
    )


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One policy per document: whole text, every document (no id subset, no prefix)."""
    d = F.col("doc_id")
    nat = lambda e: F.concat(F.lit("NATION_"), (e % 25).cast("string"))
    return table(spark, sf_dir, "documents").select(
        d.alias("policy_id"),
        F.concat(F.lit("policy "), d.cast("string")).alias("title"),
        F.col("text").alias("content"),
        F.date_add(F.lit("2024-01-01").cast("date"), ((d * 37) % 720).cast("int")).alias("publish_date"),
        F.when(d % 5 == 0, "").when(d % 5 == 1, nat(d))
        .otherwise(F.concat(nat(d), F.lit(", nation-"), ((d * 3) % 25).cast("string"))).alias("roles"),
        F.when(d % 4 == 0, "BUILDING/machinery").when(d % 4 == 1, "Household").otherwise("").alias("departments"),
        F.col("lang").alias("source"),
    )


# Explicit policy column mapping for the fixture view (its names are not in the
# reference's candidate lists, which would otherwise see only title and date).
POLICY_FIXTURE_COLUMNS = {"title": "title", "content": "content", "time": "publish_date",
                          "role": "roles", "department": "departments", "source": "source"}


def _dictionary(names: DataFrame) -> Dictionary:
    return load(names.toDF("canonical").distinct().select("canonical", F.lit(None).cast("array<string>").alias("aliases"), F.lit(0).alias("ord")))


def fixture_role_aliases(spark: SparkSession, sf_dir: str) -> Dictionary:
    """Role dictionary of the fixture: every nation name, in their order."""
    return _dictionary(table(spark, sf_dir, "nation").select("n_name"))


def fixture_department_aliases(spark: SparkSession, sf_dir: str) -> Dictionary:
    """Department dictionary of the fixture: the market-segment values, in their order."""
    return _dictionary(table(spark, sf_dir, "customer").select("c_mktsegment"))


# ---------------------------------------------------------------------------
# DuckDB twins (oracle side).  Same semantics, written as SQL.
# ---------------------------------------------------------------------------
WORKFORCE_SQL = """
WITH o AS (
  SELECT o_custkey,
         COUNT(*) AS n_ord,
         SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS n_f,
         SUM(CASE WHEN o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS n_fh,
         SUM(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS n_urg,
         CAST(MAX(EXTRACT(YEAR FROM o_orderdate)) AS INT) AS last_y,
         CAST(MIN(EXTRACT(YEAR FROM o_orderdate)) AS INT) AS first_y
  FROM orders GROUP BY o_custkey)
SELECT CAST(c.c_custkey AS BIGINT) AS EmployeeNumber,
       c.c_mktsegment AS Department,
       n.n_name AS JobRole,
       CASE c.c_custkey % 3 WHEN 0 THEN 'Technical' WHEN 1 THEN 'Marketing' ELSE 'Other' END AS EducationField,
       CASE WHEN c.c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS Gender,
       CASE c.c_custkey % 5 WHEN 0 THEN 'Single' WHEN 1 THEN 'Divorced' ELSE 'Married' END AS MaritalStatus,
       CASE (c.c_custkey * 3) % 7 WHEN 0 THEN 'Non-Travel' WHEN 1 THEN 'Travel_Frequently' WHEN 2 THEN 'Travel_Frequently' ELSE 'Travel_Rarely' END AS BusinessTravel,
       CAST(18 + (c.c_custkey * 7) % 43 AS DOUBLE) AS Age,
       ROUND(c.c_acctbal + 1000.0, 2) AS MonthlyIncome,
       CAST(o.n_ord AS DOUBLE) AS YearsAtCompany,
       CAST(FLOOR(CAST(o.n_ord * ((c.c_custkey % 5) + 1) AS DOUBLE) / 5) AS DOUBLE) AS YearsInCurrentRole,
       CAST((c.c_custkey * 17) % 13 AS DOUBLE) AS YearsSinceLastPromotion,
       CAST((c.c_custkey * 13) % 9 AS DOUBLE) AS YearsWithCurrManager,
       CAST(o.n_ord + 2001 - o.first_y AS DOUBLE) AS TotalWorkingYears,
       CAST((c.c_custkey * 11) % 29 + 1 AS DOUBLE) AS DistanceFromHome,
       CAST((c.c_custkey * 19) % 10 AS DOUBLE) AS NumCompaniesWorked,
       CAST(11 + (c.c_custkey * 23) % 15 AS DOUBLE) AS PercentSalaryHike,
       CAST((c.c_custkey * 5) % 7 AS DOUBLE) AS TrainingTimesLastYear,
       CAST(1 + c.c_custkey % 4 AS DOUBLE) AS JobSatisfaction,
       CAST(1 + (c.c_custkey * 3 + o.n_urg) % 4 AS DOUBLE) AS WorkLifeBalance,
       CAST(1 + (c.c_custkey * 5 + o.n_f) % 4 AS DOUBLE) AS EnvironmentSatisfaction,
       CAST(1 + (c.c_custkey + o.n_ord) % 4 AS DOUBLE) AS RelationshipSatisfaction,
       CAST(1 + (c.c_custkey * 7 + o.n_ord) % 4 AS DOUBLE) AS JobInvolvement,
       CAST(1 + (c.c_custkey * 2) % 5 AS DOUBLE) AS JobLevel,
       CAST((c.c_custkey * 3) % 4 AS DOUBLE) AS StockOptionLevel,
       CASE WHEN o.n_urg >= 3 THEN 'Yes' ELSE 'No' END AS OverTime,
       CASE WHEN o.n_fh * 4 >= o.n_ord THEN 'Yes' ELSE 'No' END AS Attrition,
       ROUND(CAST(o.n_f AS DOUBLE) / o.n_ord, 3) AS AttritionProb
FROM customer c
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN o ON o.o_custkey = c.c_custkey
"""

WORKFORCE_RAW_SQL = """
SELECT CAST(c_custkey AS VARCHAR) AS EmployeeNumber,
       CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS Department,
       CASE c_custkey % 6 WHEN 0 THEN ' yes ' WHEN 1 THEN '1' WHEN 2 THEN 'NO' WHEN 3 THEN 'maybe' WHEN 4 THEN 'Y' ELSE NULL END AS OverTime,
       CASE c_custkey % 5 WHEN 0 THEN 'YES' WHEN 1 THEN '0' WHEN 2 THEN 'no' WHEN 3 THEN '1.0' ELSE 'Yes' END AS Attrition,
       CASE WHEN c_custkey % 7 = 0 THEN 'n/a' WHEN c_custkey % 7 = 1 THEN '' ELSE CAST(18 + c_custkey % 43 AS VARCHAR) END AS Age,
       CAST(c_custkey % 101 AS VARCHAR) AS prob
FROM customer
"""

MODEL_SCORES_SQL = """
SELECT EmployeeNumber AS id,
       CASE WHEN Attrition = 'Yes' THEN 1 ELSE 0 END AS y,
       AttritionProb AS p_a,
       CAST(200 + FLOOR(AttritionProb * 600) + 10 * ((EmployeeNumber * 7) % 20) AS DOUBLE) / 1000 AS p_b,
       CAST(50 + FLOOR(AttritionProb * 500) + 20 * (4 - JobSatisfaction) + 10 * ((EmployeeNumber * 13) % 25) AS DOUBLE) / 1000 AS p_c
FROM workforce
"""

POLICIES_SQL = """
SELECT doc_id AS policy_id,
       CONCAT('policy ', CAST(doc_id AS VARCHAR)) AS title,
       text AS content,
       DATE '2024-01-01' + CAST(doc_id * 37 % 720 AS INTEGER) AS publish_date,
       CASE WHEN doc_id % 5 = 0 THEN ''
            WHEN doc_id % 5 = 1 THEN CONCAT('NATION_', CAST(doc_id % 25 AS VARCHAR))
            ELSE CONCAT('NATION_', CAST(doc_id % 25 AS VARCHAR), ', nation-', CAST(doc_id * 3 % 25 AS VARCHAR)) END AS roles,
       CASE WHEN doc_id % 4 = 0 THEN 'BUILDING/machinery' WHEN doc_id % 4 = 1 THEN 'Household' ELSE '' END AS departments,
       lang AS source
FROM documents
"""
