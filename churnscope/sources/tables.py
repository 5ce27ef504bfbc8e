"""Readers with explicit schemas, result writers and the pick of the newest output (A1-A5).

Files are matched by column *name*: a csv is read as text with its header and cast, so that column order, missing or
further columns don't matter and no schema inference pass runs.  A value that doesn't parse is null.
Only Spark's readers and writers touch the files, so any store that Spark knows will do.

A run's tables lie in a folder of the run's own, ``folder/prefix/run/name.parquet``.  They become visible together: when all are written, a
manifest is written to ``folder/prefix/runs/run``, and only runs with a manifest are ever picked.  A run that
is interrupted leaves files that nobody reads, and a later run overwrites nothing.
"""

from __future__ import annotations

import threading
import uuid
from collections import OrderedDict
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

_LONG = ("EmployeeNumber",)
_TEXT = ("Department", "JobRole", "EducationField", "Gender", "MaritalStatus", "BusinessTravel", "OverTime", "Attrition")
_NUMBER = ("Age", "MonthlyIncome", "YearsAtCompany", "YearsInCurrentRole", "YearsSinceLastPromotion", "YearsWithCurrManager",
           "TotalWorkingYears", "DistanceFromHome", "NumCompaniesWorked", "PercentSalaryHike", "TrainingTimesLastYear",
           "JobSatisfaction", "WorkLifeBalance", "EnvironmentSatisfaction", "RelationshipSatisfaction", "JobInvolvement",
           "JobLevel", "StockOptionLevel")


def _schema(**kinds: Sequence[str]) -> StructType:
    types = {"long": LongType(), "text": StringType(), "number": DoubleType()}
    return StructType([StructField(c, types[k]) for k, cols in kinds.items() for c in cols])


EMPLOYEES = _schema(long=_LONG, text=_TEXT, number=_NUMBER)
SCORED = StructType([*EMPLOYEES.fields, StructField("AttritionProb", DoubleType())])
POLICIES = _schema(long=("policy_id",), text=("title", "content", "publish_date", "roles", "departments", "source"))


def read_table(spark: SparkSession, path: str, schema: StructType, fmt: str | None = None, multi_line: bool = False) -> DataFrame:
    """``path`` (csv, json or parquet, by ``fmt`` or its ending) with the columns and types of ``schema``.

    Columns that the file lacks are null; others are dropped.  Texts may hold quotes, and line breaks with ``multi_line``, which makes
    one task of each csv file; without it a file is split among tasks.
    """
    fmt = fmt or path.rstrip("/").rpartition(".")[2].lower()
    if fmt == "csv":
        df = spark.read.options(header=True, multiLine=multi_line, escape='"', inferSchema=False).csv(path)
    elif fmt == "json":
        df = spark.read.schema(StructType([StructField(f.name, StringType()) for f in schema.fields])).json(path)
    elif fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"{path}: neither csv, json nor parquet")
    df = df.toDF(*[c.strip() for c in df.columns])

    def value(f: StructField) -> Column:
        return F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)

    return df.select(*[value(f).alias(f.name) for f in schema.fields])


def read_employees(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """A1."""
    return read_table(spark, path, EMPLOYEES, fmt)


def read_policies(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """A2.  Policy texts hold line breaks."""
    return read_table(spark, path, POLICIES, fmt, multi_line=True)


class TableCache:
    """A3: scored tables by path, persisted as long as their files stay the same; the ``size`` last used ones.

    The key of a table is a fingerprint of its files' names, times and sizes, made by one small aggregate over the listing (no
    content is read).  A table that is dropped, because its files changed or others came, is unpersisted.
    """

    def __init__(self, size: int = 8):
        self.size = size
        self._held: OrderedDict[tuple, tuple[tuple, DataFrame]] = OrderedDict()
        self._lock = threading.Lock()

    @staticmethod
    def fingerprint(spark: SparkSession, path: str) -> tuple:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime", "length")
        each = F.xxhash64("path", "modificationTime", "length").cast("decimal(20,0)")
        return tuple(files.agg(F.count(F.lit(1)), F.sum("length"), F.max("modificationTime"), F.sum(each)).first())

    def read(self, spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
        key, now = (id(spark), path, fmt), self.fingerprint(spark, path)
        with self._lock:
            old, df = self._held.pop(key, (None, None))
            if old != now:
                if df is not None:
                    df.unpersist()
                df = read_table(spark, path, SCORED, fmt).persist()
            self._held[key] = now, df
            while len(self._held) > self.size:
                _, (_, last) = self._held.popitem(last=False)
                last.unpersist()
        return df

    def clear(self) -> None:
        with self._lock:
            while self._held:
                self._held.popitem()[1][1].unpersist()


CACHE = TableCache()


def read_scored(spark: SparkSession, path: str, fmt: str | None = None, cached: bool = False) -> DataFrame:
    """A3: fresh, or from the cache of a page's many reads."""
    return CACHE.read(spark, path, fmt) if cached else read_table(spark, path, SCORED, fmt)


def write_results(tables: Mapping[str, DataFrame], folder: str, prefix: str, csv: bool = False, run: str | None = None) -> list[str]:
    """A5: a run's tables as ``folder/prefix/run/name.parquet`` (and ``.csv``, texts only there), then its manifest; the tables' paths."""
    run = run or f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"
    base = f"{folder.rstrip('/')}/{prefix}"
    paths = []
    for name, df in tables.items():
        path = f"{base}/{run}/{name}"
        df.write.parquet(f"{path}.parquet")
        paths.append(f"{path}.parquet")
        if csv:
            df.write.options(header=True, escape='"').csv(f"{path}.csv")
            paths.append(f"{path}.csv")
    if tables:
        spark = next(iter(tables.values())).sparkSession
        spark.createDataFrame([(run, list(tables))], _MANIFEST).coalesce(1).write.json(f"{base}/runs/{run}")  # one row
    return paths


_MANIFEST = "run string, tables array<string>"


def finished_runs(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """A row for each run with a manifest: order (of the folder), base, prefix, run, tables, modificationTime."""
    found = None
    for order, folder in enumerate(folders):
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
                 .load(folder).select("path", "modificationTime", "content"))
        at = "^(.*/([^/]+))/runs/([^/]+)/part-[^/]+[.]json$"
        part = files.where(F.col("path").rlike(at)).select(
            F.lit(order).alias("order"), F.regexp_extract("path", at, 1).alias("base"), F.regexp_extract("path", at, 2).alias("prefix"),
            F.from_json(F.col("content").cast("string"), _MANIFEST).alias("m"), "modificationTime")
        part = part.select("order", "base", "prefix", "m.run", "m.tables", "modificationTime").where("run is not null")
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], f"order int, base string, prefix string, {_MANIFEST}, modificationTime timestamp")


def latest_output(spark: SparkSession, folders: Sequence[str], table: str, preferred: str, named: str | None = None) -> str | None:
    """A4: the path of ``table`` to show: the one ``named`` by the run, else that of the newest finished run with the preferred prefix
    in the first folder in order that has one, else of the newest finished run; None without any."""
    if named:
        return named
    found = finished_runs(spark, folders).where(F.array_contains("tables", table)).withColumn("first", F.coalesce(F.col("prefix") == preferred, F.lit(False)))
    best = found.orderBy(F.desc("first"), F.when(F.col("first"), F.col("order")), F.desc("modificationTime"), "order", F.desc("run"), "base").first()
    return f"{best['base']}/{best['run']}/{table}.parquet" if best else None
