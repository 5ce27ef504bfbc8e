"""Readers, writers and the pick of the newest output."""

import os

import pytest

from churnscope.sources import tables as T

ROWS = [(1, "R&D", 'line\nbreak, "quoted"', "Yes", 33.0, 0.25), (2, None, "", "No", None, None)]


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame(ROWS, "EmployeeNumber long, Department string, JobRole string, OverTime string, Age double, AttritionProb double")


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_round_trip_by_name(spark, scored, tmp_path, fmt):
    shuffled = scored.selectExpr("AttritionProb", "Age", "'more' AS Other", "OverTime", "JobRole", "EmployeeNumber", "Department")
    path = f"{tmp_path}/t.{fmt}"
    getattr(shuffled.write.options(header=True, escape='"') if fmt == "csv" else shuffled.write, fmt)(path)
    got = T.read_table(spark, path, T.SCORED, multi_line=True)
    assert got.schema == T.SCORED
    rows = sorted((r.EmployeeNumber, r.Department, r.JobRole or "", r.OverTime, r.Age, r.AttritionProb, r.JobLevel) for r in got.collect())
    assert rows == [(1, "R&D", 'line\nbreak, "quoted"', "Yes", 33.0, 0.25, None), (2, None, "", "No", None, None, None)]


def test_bad_values_are_null_and_bad_formats_refused(spark, tmp_path):
    with open(tmp_path / "e.csv", "w") as f:
        f.write(" EmployeeNumber ,Age\n7,n/a\nx,4\n")
    assert sorted([(r.EmployeeNumber, r.Age) for r in T.read_employees(spark, str(tmp_path / "e.csv")).collect()], key=str) == [(7, None), (None, 4.0)]
    with pytest.raises(ValueError):
        T.read_policies(spark, str(tmp_path / "e.xlsx"))


def test_latest_output(spark, scored, tmp_path):
    one, two = f"{tmp_path}/one", f"{tmp_path}/two"
    for k, (folder, prefix) in enumerate(((one, "old"), (two, "new"), (two, "best"))):
        T.write_results({"detail": scored, "other": scored}, folder, prefix, run=f"r{k}")
        at = f"{folder}/{prefix}/runs/r{k}"
        for name in os.listdir(at):
            os.utime(os.path.join(at, name), (1_700_000_000 - k, 1_700_000_000 - k))
    pick = lambda *a, **b: T.latest_output(spark, *a, **b)
    assert pick([one, two], "detail", "best").endswith("two/best/r2/detail.parquet")
    assert pick([one, two], "detail", "none").endswith("one/old/r0/detail.parquet")
    assert pick([one, two], "missing", "best") is None
    assert pick([one], "detail", "best", named="given") == "given"
    assert T.read_scored(spark, pick([one, two], "detail", "best")).count() == 2
    assert T.latest_output(spark, [], "detail", "best") is None


def test_interrupted_run_is_never_picked(spark, scored, tmp_path):
    folder = f"{tmp_path}/out"
    T.write_results({"detail": scored, "other": scored}, folder, "p", run="whole")
    bad = scored.withColumn("x", scored.Age.cast("string").substr(1, 1).cast("int") / 0)  # fails while it is written
    with pytest.raises(Exception, match="zero"):
        T.write_results({"detail": scored.limit(1), "other": bad}, folder, "p", run="broken")
    assert os.path.exists(f"{folder}/p/broken/detail.parquet")
    for table in ("detail", "other"):
        path = T.latest_output(spark, [folder], table, "p")
        assert path.endswith(f"p/whole/{table}.parquet") and spark.read.parquet(path).count() == 2
    # tables of one run belong together: the next whole run is picked for both
    T.write_results({"detail": scored.limit(1), "other": scored.limit(1)}, folder, "p", run="zz-next")
    assert [spark.read.parquet(T.latest_output(spark, [folder], t, "p")).count() for t in ("detail", "other")] == [1, 1]


def test_cached_reads_follow_their_files(spark, scored, tmp_path):
    cache = T.TableCache(size=8)
    path = f"{tmp_path}/t.parquet"
    scored.write.parquet(path)
    first = cache.read(spark, path)
    assert first.count() == 2 and first.is_cached and cache.read(spark, path) is first
    scored.limit(1).write.mode("overwrite").parquet(path)
    second = cache.read(spark, path)
    assert second is not first and second.count() == 1 and not first.is_cached
    for k in range(8):
        scored.write.parquet(f"{tmp_path}/{k}.parquet")
        cache.read(spark, f"{tmp_path}/{k}.parquet")
    assert not second.is_cached and cache.read(spark, path) is not second  # the ninth entry had dropped it
    cache.clear()
