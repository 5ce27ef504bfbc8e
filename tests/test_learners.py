"""Encoding and learners: nothing of the held-out rows reaches the fitted model."""

import pytest
from pyspark.sql import functions as F

from churnscope.operators import learners as L


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, int(i % 4 == 0), float(i % 11) if i % 9 else None, (i * 7 % 13) * 1.5, "a" if i % 3 else None, f"g{i % 5}") for i in range(300)]
    return spark.createDataFrame(rows, f"EmployeeNumber long, {L.LABEL} int, x double, z double, kind string, grp string")


def test_column_kinds(table):
    assert L.column_kinds(table) == (["x", "z"], ["kind", "grp"])


def test_statistics_of_training_rows(table):
    st = L.fit_statistics(table, ["x", "z"], ["kind", "grp"])
    assert st["n"] == 300 and st["pos"] == 75 and st["mode_kind"] == "a" and st["mode_grp"] == "g0"
    out = L.apply_statistics(table, st, ["x", "z"], ["kind"]).agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.count_if(F.col("kind").isNull()).alias("k")).first()
    assert abs(out.m) < 1e-9 and abs(out.s - 1) < 1e-9 and out.k == 0


def test_held_out_rows_do_not_change_the_model(table):
    train, test = table.where("EmployeeNumber < 200"), table.where("EmployeeNumber >= 200")
    odd = test.withColumns({"x": F.lit(1e6), "grp": F.lit("new"), L.LABEL: F.lit(1)})
    both = [L.fit_predict(train, t.unionByName(train), ["x", "z"], ["kind", "grp"], ("lr", "rf"), num_trees=5) for t in (test, odd)]
    scores = [{r.EmployeeNumber: (r.p_lr, r.p_rf) for r in b.where("EmployeeNumber < 200").collect()} for b in both]
    assert scores[0] == scores[1]


def test_encoded_names_map_to_columns(table):
    st = L.fit_statistics(table, [], ["grp"])
    x = L.encoder([], ["grp"]).fit(table).transform(L.apply_statistics(table, st, [], ["grp"]))
    names = L.encoded_feature_names(x)
    assert [n.split("__ohe_")[0] for n in names] == ["grp"] * 5
    new = L.encoder([], ["grp"]).fit(table.where("grp <> 'g1'")).transform(table.where("grp = 'g1'")).first().features
    assert new.size == 4 and new.numNonzeros() == 0  # an unknown category is all zeros


def test_out_of_fold_covers_the_pool_once(table):
    out = L.oof_predictions(table, k=3, learners=("lr",)).collect()
    assert sorted(r.EmployeeNumber for r in out) == list(range(300)) and {r.fold for r in out} == {0, 1, 2}


def test_random_search(table):
    draws = L.sample_settings(16)
    assert len({tuple(d.items()) for d in draws}) == 16 and all(d[k] in L.GBT_SPACE[k] for d in draws for k in d)
    assert draws == L.sample_settings(16)
    small = {"maxIter": [1, 2], "maxDepth": [2], "minInstancesPerNode": [5]}
    rows = L.tune_gbt(table, n=16, folds=2, space=small).collect()
    assert len(rows) == 2 and rows[0].auc >= rows[1].auc and set(rows[0].settings) == set(small)


def test_key_of_another_name_is_no_feature(spark):
    rows = [(i, int(i % 3 == 0), (i * 7 % 10) / 10, (i * 3 % 10) / 10, (i * 11 % 10) / 10) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, y int, p_a double, p_b double, p_c double")
    _, num, cat = L.training_columns(df, "y", "id")
    assert num == ["p_a", "p_b", "p_c"] and cat == []
    got = L.meta_oof(df, k=3).collect()
    assert sorted(r.id for r in got) == list(range(120)) and all(0 <= r.meta_prob <= 1 for r in got)
    # ids that give the label away change nothing
    other = df.withColumn("id", F.col("id") + F.col("y") * 1000)
    folds = {r.id: r.fold for r in L.meta_oof(other, k=3).collect()}
    assert len(folds) == 120


def test_independent_fits_overlap(spark, table, monkeypatch):
    import threading
    import time

    running, most, lock = [0], [0], threading.Lock()
    fit = L.LogisticRegression.fit

    def counted(self, *a, **b):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.3)
        try:
            return fit(self, *a, **b)
        finally:
            with lock:
                running[0] -= 1

    monkeypatch.setattr(L.LogisticRegression, "fit", counted)
    both = [{r.EmployeeNumber: r.p_lr for r in L.oof_predictions(table, k=4, learners=("lr",), parallel=n).collect()} for n in (4, 1)]
    assert most[0] >= 2
    assert set(both[0]) == set(both[1]) and all(abs(both[0][i] - both[1][i]) < 1e-9 for i in both[0])


def test_jobs_raise_their_error(spark):
    assert L.run_jobs(spark, {i: lambda i=i: i * i for i in range(5)}) == {i: i * i for i in range(5)}
    with pytest.raises(ZeroDivisionError):
        L.run_jobs(spark, {i: lambda i=i: 1 // i for i in range(3)})


def test_large_training_tables_are_dealt_in_equal_parts(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    df = spark.range(100 * cores + 1).withColumn("y", F.col("id") % 2).coalesce(3)
    assert L.spread(df, 100 * cores + 1).rdd.getNumPartitions() == 3  # small
    monkeypatch.setattr(L, "SPREAD_ROWS", 10)
    monkeypatch.setattr(L, "PART_ROWS", 60)
    got = L.spread(df, 100 * cores + 1)
    sizes = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 2 * cores and max(r["count"] for r in sizes) < 70 and sum(r["count"] for r in sizes) == 100 * cores + 1
    wide = df.withColumn("x", F.rand(1))
    tr, _, _ = L.encoded(wide, wide.limit(1), ["x"], [], "y")
    assert tr.rdd.getNumPartitions() == 2 * cores
    tr.unpersist()


def test_large_pools_hold_one_fold_at_a_time(table, monkeypatch):
    import threading

    def plain(rows):
        return {r.EmployeeNumber: (r.fold, round(r.p_lr, 12), round(r.p_rf, 12)) for r in rows}

    options = dict(k=3, learners=("lr", "rf"), num_trees=3)
    small = plain(L.oof_predictions(table, **options).collect())
    told, held, most, lock, encoded, DataFrame = [], set(), [0], threading.Lock(), L.encoded, type(table)

    def counted(*a, **b):
        out = encoded(*a, **b)
        with lock:
            told.append(out[0].columns)
            held.add(id(out[0]))
            most[0] = max(most[0], len(held))
        return out

    def dropped(self, *a, unpersist=DataFrame.unpersist):
        held.discard(id(self))
        return unpersist(self, *a)

    monkeypatch.setattr(L, "encoded", counted)
    monkeypatch.setattr(DataFrame, "unpersist", dropped)
    monkeypatch.setattr(L, "SPREAD_ROWS", 1)
    monkeypatch.setattr(L, "spread", lambda df, rows: df)
    assert plain(L.oof_predictions(table, **options).collect()) == small
    assert most[0] == 1 and told == [[L.LABEL, "w_balanced", "w_pos", "features"]] * 3
