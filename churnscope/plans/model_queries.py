"""Driver queries for encoding, base learners, out-of-fold predictions and linear
contributions (SURVEY §2.L: L3, L9-L12, L27).  Learner outputs depend on the
training engine, so these get the driver's rows-only check; the relational
parts they use (folds, split, weights, standardisation) are SQL-checked in
``evaluation_queries``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attributions as AT
from ..operators import evaluation as EV
from ..operators import features as FE
from ..operators import learners as LN
from ..operators import normalize as N
from ..operators import ranking as RK
from ..session import cut_lineage
from ..sources import fixtures as FX

SPARK: dict = {}
SQL: dict[str, str] = {}


def q(name: str, sql: str | None = None):
    def deco(fn):
        SPARK[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def training_table(spark, sf):
    """Employee features + 0/1 label; the given score columns are dropped (they would leak)."""
    wf = FX.workforce(spark, sf).drop("AttritionProb")
    d = FE.add_interaction_features(N.normalize_workforce(wf))
    return d.withColumn(LN.LABEL, F.when(F.col("Attrition") == "Yes", 1).otherwise(0))


def _split(spark, sf):
    """Training pool and test rows, separated before anything is fitted."""
    d, num, cat = LN.training_columns(training_table(spark, sf))
    # several jobs pass over both parts: the split is made once
    s = cut_lineage(EV.stratified_split(d, LN.LABEL, "EmployeeNumber", 0.2, 42).drop("class_rank"))
    return s.where(~F.col("is_test")).drop("is_test"), s.where(F.col("is_test")).drop("is_test"), num, cat


def _base(spark, sf, learner):
    tr, te, num, cat = _split(spark, sf)
    return LN.fit_predict(tr, te, num, cat, (learner,)).select("EmployeeNumber", LN.LABEL, f"p_{learner}")


@q("base_lr")
def base_lr(spark, sf):
    return _base(spark, sf, "lr")


@q("base_forest")
def base_forest(spark, sf):
    return _base(spark, sf, "rf")


@q("base_gbt")
def base_gbt(spark, sf):
    return _base(spark, sf, "gbt")


@q("oof_predictions")
def oof_predictions(spark, sf):
    """L12 over the training pool (the test rows are set aside first)."""
    return LN.oof_predictions(_split(spark, sf)[0])


@q("linear_contributions")
def linear_contributions(spark, sf):
    return LN.linear_contributions(training_table(spark, sf))


@q("one_hot")
def one_hot(spark, sf):
    """L3 long form: (EmployeeNumber, feature, value) for every non-zero encoded categorical slot."""
    pool, test, num, cat = _split(spark, sf)
    st = LN.fit_statistics(pool, num, cat)
    enc = LN.encoder([], cat).fit(LN.apply_statistics(pool, st, [], cat))
    x = enc.transform(LN.apply_statistics(pool.unionByName(test), st, [], cat))
    names = LN.encoded_feature_names(x)
    from pyspark.ml.functions import vector_to_array
    arr = vector_to_array(F.col("features"))
    slots = F.array(*[F.struct(F.lit(n).alias("feature"), arr[i].alias("value")) for i, n in enumerate(names)])
    return x.select("EmployeeNumber", F.inline(slots)).where(F.col("value") != 0)


def _boosted(spark, sf):
    """The encoded pool and learner 1, fitted on it, with its slots' names."""
    pool, _, num, cat = _split(spark, sf)
    coded, models = LN.fit_models(pool, pool, num, cat, ("gbt",))
    return coded, models["gbt"], LN.encoded_feature_names(coded)


@q("tree_contributions")
def tree_contributions(spark, sf):
    """The three largest attributions of learner 1 for each training row, with its margin."""
    coded, model, names = _boosted(spark, sf)
    found = AT.tree_contributions(coded, model, names, "EmployeeNumber")
    return found.join(RK.top3_drivers(found), "EmployeeNumber").select("EmployeeNumber", "margin", "expected_margin", "top3_drivers")


@q("importance_by_raw_feature")
def importance_by_raw_feature(spark, sf):
    """Learner 1's gains by encoded slot, summed back to the raw feature (one-hot slots -> column)."""
    _, model, names = _boosted(spark, sf)
    raw = F.split(F.col("feature"), "__ohe_").getItem(0)
    return (AT.gain_importance(spark, model, names).groupBy(raw.alias("raw_feature")).agg(F.sum("importance").alias("importance"))
            .orderBy(F.desc("importance"), F.asc("raw_feature")))


@q("top_features")
def top_features(spark, sf):
    """Top-20 encoded features by learner 1's gain (a top-k report)."""
    _, model, names = _boosted(spark, sf)
    return AT.gain_importance(spark, model, names).orderBy(F.desc("importance"), F.asc("feature")).limit(20)
