"""Feature encoding, base learners, out-of-fold predictions, linear contributions
(L1-L4, L7-L12, L27) on Spark ML.

Encoding follows the reference's preprocessor: numeric columns are median
imputed and standardised with the POPULATION std (trap T9, exact aggregates,
not ``ml.Imputer`` / ``StandardScaler``); categoricals are mode imputed and
one-hot encoded with unknown categories -> all zeros (``StringIndexer(keep)`` +
``OneHotEncoder(dropLast=True)``, trap T11).  All of these statistics, and the
class weights, come from training rows alone (``fit_statistics``); test and
validation rows only get them applied.  Learners are Spark ML estimators
(distributed training).  Fits that don't depend on each other (learners, folds) run at the same
time: ``run_jobs`` starts each in a thread of its own that is pinned to a JVM thread and to a scheduler pool, so
that the short jobs of one boosting fill the executors' gaps that another leaves.
"""

from __future__ import annotations

import random
import threading
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from ..functions.numeric import with_scalars
from ..session import cut_lineage, ensure_checkpoint_dir
from . import evaluation as EV
from .quantiles import exact_quantiles

LABEL = "AttritionFlag"
EXCLUDE = {"Attrition", "AttritionFlag", "EmployeeNumber"}

# FIXED VALUES: learner settings of the reference (mapped to Spark ML names)
LR_C = 0.35
FOREST_TREES = 400
FOREST_DEPTH = 7
FOREST_MIN_LEAF = 5
# boosted trees: one point of the reference's search space (rounds 120-320, depth 2-4, leaf 35-90,
# rate 0.02-0.05, rows 0.65-0.85); the smallest leaf that Spark's trees allow to differ is kept at the space's low end
GBT_DEFAULTS = {"maxIter": 120, "maxDepth": 3, "stepSize": 0.05, "subsamplingRate": 0.75, "minInstancesPerNode": 35}


#: Fits that run at the same time.
PARALLEL_FITS = 4
T = TypeVar("T")
K = TypeVar("K")


def run_jobs(spark: SparkSession, jobs: Mapping[K, Callable[[], T]], parallel: int = PARALLEL_FITS) -> dict[K, T]:
    """The results of independent driver jobs, ``parallel`` of them at a time; the first error is raised.

    A job's Spark work goes to a scheduler pool of its thread's own (used where the cluster schedules fairly).
    """
    if len(jobs) < 2 or parallel < 2:
        return {k: job() for k, job in jobs.items()}

    def pinned(job: Callable[[], T]) -> Callable[[], T]:
        def run() -> T:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{threading.get_ident()}")
            try:
                return job()
            finally:
                spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
        return inheritable_thread_target(spark)(run)

    with ThreadPoolExecutor(min(parallel, len(jobs))) as pool:
        started = {k: pool.submit(pinned(job)) for k, job in jobs.items()}
        return {k: f.result() for k, f in started.items()}


#: Rows of a training table's part, at most, and those a core must get for the table to be dealt anew.
PART_ROWS, SPREAD_ROWS = 200_000, 10_000


def spread(df: DataFrame, rows: int) -> DataFrame:
    """A large training table in equal parts, as many as all cores take in whole rounds: a fit makes hundreds of passes over it, and
    each lasts as long as its slowest core.  Small tables are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if rows < cores * SPREAD_ROWS:
        return df
    return df.repartition(cores * -(-rows // (cores * PART_ROWS)))


def column_kinds(df: DataFrame, label: str = LABEL, exclude: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """L1: numeric and string columns from the schema (plan time), label and ids excluded."""
    skip = set(EXCLUDE) | {label} | set(exclude)
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in skip]
    cat = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name not in skip]
    return num, cat


def fit_statistics(train: DataFrame, num: Sequence[str], cat: Sequence[str], label: str = LABEL) -> dict:
    """L2/L3/L7 statistics of the training rows: medians, means and population stds after imputation,
    modes (smallest on ties) and class counts.  A few small rows on the driver."""
    first = train.agg(*[F.mode(F.col(c), True).alias(f"mode_{c}") for c in cat],
                      F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("pos")).first().asDict()
    if num:
        medians = exact_quantiles(train.select(*[f"`{c}`" for c in num]), {c: [0.5] for c in num}).first()
        first |= {f"med_{c}": medians[c][0] if medians[c] else None for c in num}
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(first[f"med_{c}"])) for c in num}
    second = train.agg(F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(f"mean_{c}") for c, x in filled.items()],
                       *[F.stddev_pop(x).alias(f"std_{c}") for c, x in filled.items()]).first().asDict()
    return first | second


def apply_statistics(df: DataFrame, st: dict, num: Sequence[str], cat: Sequence[str]) -> DataFrame:
    """Impute and standardise with given statistics: one projection."""
    out = {}
    for c in num:
        x = F.coalesce(F.col(c).cast("double"), F.lit(st[f"med_{c}"]).cast("double"))
        out[c] = (x - F.lit(st[f"mean_{c}"])) / F.lit(st[f"std_{c}"]) if st[f"std_{c}"] else F.lit(0.0)
    out |= {c: F.coalesce(F.col(c), F.lit(st[f"mode_{c}"])) for c in cat}
    return df.withColumns(out)


def encoder(num: Sequence[str], cat: Sequence[str], out: str = "features") -> Pipeline:
    """L3/L4: one-hot (unknown -> zeros) + assembly; the assembled vector's ML attributes
    carry the encoded -> raw feature names."""
    idx = [StringIndexer(inputCols=list(cat), outputCols=[f"{c}__idx" for c in cat], handleInvalid="keep",
                         stringOrderType="alphabetAsc")] if cat else []  # one pass for all columns
    ohe = OneHotEncoder(inputCols=[f"{c}__idx" for c in cat], outputCols=[f"{c}__ohe" for c in cat],
                        dropLast=True) if cat else None  # the dropped last slot is the indexer's "unknown"
    asm = VectorAssembler(inputCols=list(num) + [f"{c}__ohe" for c in cat], outputCol=out, handleInvalid="keep")
    return Pipeline(stages=[*idx, *([ohe] if ohe else []), asm])


def encoded_feature_names(model_df: DataFrame, col: str = "features") -> list[str]:
    """L4: names of the encoded slots in vector order (from ML attribute metadata)."""
    meta = model_df.schema[col].metadata.get("ml_attr", {}).get("attrs", {})
    slots = [a for kind in meta.values() for a in kind]
    return [a["name"] for a in sorted(slots, key=lambda a: a["idx"])]


def with_class_weights(df: DataFrame, st: dict, label: str = LABEL) -> DataFrame:
    """``w_balanced`` = n / (2 max(n_c, 1)) and ``w_pos`` = max(neg, 1) / max(pos, 1) for positives (else 1)."""
    n, pos = st["n"], max(st["pos"], 1)
    neg = max(n - st["pos"], 1)
    is_pos = F.col(label) == 1
    return df.withColumns({"w_balanced": F.when(is_pos, n / (2.0 * pos)).otherwise(n / (2.0 * neg)),
                           "w_pos": F.when(is_pos, neg / pos).otherwise(1.0)})


def logistic(sum_weights: float, features: str = "features", label: str = LABEL) -> LogisticRegression:
    """Balanced logistic regression, C = 0.35 -> regParam = 1 / (C * sum of weights)."""
    return LogisticRegression(featuresCol=features, labelCol=label, weightCol="w_balanced",
                              regParam=1.0 / (LR_C * max(sum_weights, 1e-12)), elasticNetParam=0.0,
                              standardization=False, maxIter=200, probabilityCol="lr_probability",
                              rawPredictionCol="lr_raw", predictionCol="lr_pred")


def forest(features: str = "features", label: str = LABEL, num_trees: int = FOREST_TREES,
           seed: int = 42) -> RandomForestClassifier:
    """Forest of depth-7 trees, sqrt feature subsets, balanced weights."""
    return RandomForestClassifier(featuresCol=features, labelCol=label, weightCol="w_balanced",
                                  numTrees=num_trees, maxDepth=FOREST_DEPTH, minInstancesPerNode=FOREST_MIN_LEAF,
                                  featureSubsetStrategy="sqrt", seed=seed, probabilityCol="rf_probability",
                                  rawPredictionCol="rf_raw", predictionCol="rf_pred", cacheNodeIds=True, maxMemoryInMB=512)


def boosted(features: str = "features", label: str = LABEL, seed: int = 42, **params) -> GBTClassifier:
    """Boosted trees with the positive-class weight (differences: SURVEY §7.5)."""
    p = dict(GBT_DEFAULTS, **params)
    # no table of node ids: a row passes the few splits of its one small tree faster than a table is made anew for each level
    m = GBTClassifier(featuresCol=features, labelCol=label, weightCol="w_pos", seed=seed, cacheNodeIds=False, **p)
    return m.setProbabilityCol("gbt_probability").setRawPredictionCol("gbt_raw").setPredictionCol("gbt_pred")


# FIXED VALUES: the random search's space, as far as Spark's boosted trees have such settings (the two
# regularisation weights and the number of leaves have no counterpart)
GBT_SPACE = {
    "stepSize": [0.02, 0.03, 0.05],
    "maxIter": [120, 180, 240, 320],
    "maxDepth": [2, 3, 4],
    "minInstancesPerNode": [35, 50, 70, 90],
    "subsamplingRate": [0.65, 0.75, 0.85],
    "featureSubsetStrategy": ["0.6", "0.7", "0.8"],
    "minInfoGain": [0.0, 0.1, 0.2, 0.4],
}


def sample_settings(n: int = 16, seed: int = 42, space: dict | None = None) -> list[dict]:
    """``n`` different draws from the search space, each value alike likely."""
    space = space or GBT_SPACE
    total = 1
    for values in space.values():
        total *= len(values)
    draws = []
    for number in random.Random(seed).sample(range(total), min(n, total)):
        one = {}
        for name, values in space.items():
            number, at = divmod(number, len(values))
            one[name] = values[at]
        draws.append(one)
    return draws


def tune_gbt(pool: DataFrame, label: str = LABEL, key: str = "EmployeeNumber", n: int = 16, folds: int = 4, seed: int = 42,
             space: dict | None = None, parallelism: int = 4) -> DataFrame:
    """Mean ROC AUC of sampled boosting settings over stratified folds, best first (ties by the draw's number).

    n * folds distributed fits, ``parallelism`` of them at a time; the fold is a column of the training table.
    """
    ensure_checkpoint_dir(pool.sparkSession)
    d, num, cat = training_columns(pool, label, key)
    st = fit_statistics(d, num, cat, label)
    d = with_class_weights(apply_statistics(EV.stratified_folds(d, label, key, folds, seed).drop("class_rank"), st, num, cat), st, label)
    x = encoder(num, cat).fit(d).transform(d).persist()
    try:
        model, draws = boosted(label=label, seed=seed), sample_settings(n, seed, space)
        maps = [{model.getParam(k): v for k, v in one.items()} for one in draws]
        judge = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="gbt_raw", metricName="areaUnderROC")
        auc = CrossValidator(estimator=model, estimatorParamMaps=maps, evaluator=judge, numFolds=folds, foldCol="fold",
                             parallelism=parallelism).fit(x).avgMetrics
    finally:
        x.unpersist()
    rows = [(i, float(a), {k: str(v) for k, v in one.items()}) for i, (a, one) in enumerate(zip(auc, draws))]
    table = pool.sparkSession.createDataFrame(rows, "draw int, auc double, settings map<string,string>")  # a row for each draw
    return table.orderBy(F.desc("auc"), "draw")


def _p1(col: str) -> F.Column:
    return vector_to_array(F.col(col))[1]


def training_columns(df: DataFrame, label: str = LABEL, key: str = "EmployeeNumber",
                     exclude: Sequence[str] = ()) -> tuple[DataFrame, list[str], list[str]]:
    """The key, the label and the raw input columns; (table, numeric columns, categorical columns).  The key is no input."""
    num, cat = column_kinds(df, label, [key, *exclude])
    return df.select(key, label, *num, *cat), num, cat


def _weights(st: dict) -> float:
    """The sum of the balanced weights: half the rows for each class that there is."""
    return st["n"] / 2.0 * ((st["pos"] > 0) + (st["n"] > st["pos"]))


def encoded(train: DataFrame, test: DataFrame, num, cat, label: str = LABEL, statistics: dict | None = None,
            dealt: bool = False) -> tuple[DataFrame, DataFrame, dict]:
    """``train`` (with class weights) and ``test``, encoded with what ``train`` has (and ``statistics``, unless those come from it
    too), and the training rows' statistics.  Of the training table, what fits read (label, weights, features) is persisted, in equal
    parts (unless it is ``dealt`` already): they pass over it many times."""
    own = fit_statistics(train, num, cat, label) if statistics is None else train.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("pos")).first().asDict()
    st = statistics or own
    train = with_class_weights(apply_statistics(train, st, num, cat), own, label)
    enc = encoder(num, cat).fit(train)
    coded = enc.transform(train if dealt else spread(train, own["n"])).select(label, "w_balanced", "w_pos", "features")
    return coded.persist(), enc.transform(apply_statistics(test, st, num, cat)), own


def _estimator(name: str, st: dict, label: str, gbt_params: dict | None, num_trees: int):
    if name == "lr":
        return logistic(_weights(st), label=label)
    return forest(num_trees=num_trees, label=label) if name == "rf" else boosted(label=label, **(gbt_params or {}))


def _scored(test: DataFrame, models: Mapping[str, object]) -> DataFrame:
    """Encoded rows with each model's probability, without the encoding."""
    out = test
    for name, model in models.items():
        out = model.transform(out).withColumn(f"p_{name}", _p1(f"{name}_probability"))
    keep = [c for c in out.columns if not c.endswith(("_raw", "_probability", "_pred", "__idx", "__ohe"))]
    return out.select(*[c for c in keep if c != "features"])


def parse_settings(settings: Mapping[str, str], space: dict | None = None) -> dict:
    """A draw of ``tune_gbt``'s table as parameters again."""
    space = space or GBT_SPACE
    return {k: next(v for v in space[k] if str(v) == text) for k, text in settings.items()}


def fit_models(train: DataFrame, test: DataFrame, num, cat, learners: Sequence[str] = ("gbt", "lr", "rf"),
               gbt_params: dict | None = None, num_trees: int = FOREST_TREES, label: str = LABEL,
               statistics: dict | None = None, parallel: int = PARALLEL_FITS) -> tuple[DataFrame, dict]:
    """The encoded ``test`` and the learners by name, fitted on ``train`` at the same time."""
    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    tr, te, st = encoded(train, test, num, cat, label, statistics)
    try:
        return te, run_jobs(spark, {n: lambda n=n: _estimator(n, st, label, gbt_params, num_trees).fit(tr) for n in learners}, parallel)
    finally:
        tr.unpersist()


def fit_predict(train: DataFrame, test: DataFrame, num, cat, learners: Sequence[str] = ("gbt", "lr", "rf"),
                gbt_params: dict | None = None, num_trees: int = FOREST_TREES, label: str = LABEL,
                statistics: dict | None = None, parallel: int = PARALLEL_FITS) -> DataFrame:
    """Fit statistics (unless given), weights, the encoder and the chosen learners on ``train``; score ``test``
    (p_gbt, p_lr, p_rf).  The learners are fitted at the same time."""
    return _scored(*fit_models(train, test, num, cat, learners, gbt_params, num_trees, label, statistics, parallel))


def oof_predictions(pool: DataFrame, label: str = LABEL, key: str = "EmployeeNumber", k: int = 5,
                    learners: Sequence[str] = ("gbt", "lr", "rf"), seed: int = 42,
                    gbt_params: dict | None = None, num_trees: int = FOREST_TREES, per_fold: bool = False,
                    parallel: int = PARALLEL_FITS) -> DataFrame:
    """Out-of-fold probabilities over a training pool; folds are stratified (L6).  Imputation and scaling come
    from the pool (or, ``per_fold``, from each fold's training rows), class weights from each fold's training rows.

    The pool with its folds is materialised once.  The folds' encodings, and then all k x learners fits, run
    ``parallel`` at a time.  Of a large pool (see ``spread``) one fold at a time is encoded, held and fitted: a pass of one fit
    keeps all cores busy there, and k training tables and forests together don't fit the executors' memory.  One union of k scored
    folds; an empty fold has no rows.
    """
    spark = pool.sparkSession
    d, num, cat = training_columns(pool, label, key)
    n_rows = pool.count()
    d = cut_lineage(spread(EV.stratified_folds(d, label, key, k, seed).drop("class_rank"), n_rows))
    st = None if per_fold else fit_statistics(d, num, cat, label)
    together = [range(k)] if n_rows < spark.sparkContext.defaultParallelism * SPREAD_ROWS else [[f] for f in range(k)]
    folds, models = {}, {}
    for some in together:
        folds |= run_jobs(spark, {f: lambda f=f: encoded(d.where(F.col("fold") != f), d.where(F.col("fold") == f), num, cat, label, st, True) for f in some}, parallel)
        try:
            models |= run_jobs(spark, {(f, n): lambda f=f, n=n: _estimator(n, folds[f][2], label, gbt_params, num_trees).fit(folds[f][0]) for n in learners for f in some}, parallel)
        finally:
            for f in some:
                folds[f][0].unpersist()
    out = None
    for f, (_, te, _) in folds.items():
        part = _scored(te, {n: models[f, n] for n in learners}).select(key, label, "fold", *[f"p_{n}" for n in learners])
        out = part if out is None else out.unionByName(part)
    return out


def meta_oof(df: DataFrame, label: str = "y", key: str = "id", k: int = 5, seed: int = 42,
             weights: Sequence[float] = EV.DEFAULT_WEIGHTS) -> DataFrame:
    """Out-of-fold probabilities of the meta learner (scaling and balanced logistic per fold) over the meta features
    of three base probabilities."""
    meta = EV.meta_features(df, weights=weights).select(key, label, "p_a", "p_b", "p_c", "blend_prob", "mean_prob", "std_prob", "disagreement")
    return oof_predictions(meta, label, key, k, ("lr",), seed, per_fold=True).withColumnRenamed("p_lr", "meta_prob")


def score_blend(df: DataFrame, weights: Sequence[float], probs: Sequence[str] = ("p_a", "p_b", "p_c"),
                calibrator: tuple[float, float] | None = None, out: str = "score") -> DataFrame:
    """Base probabilities blended with weights normalised to 1, then the optional calibrator (coefficient, intercept)."""
    total = sum(weights) or 1.0
    blend = sum((F.col(c).cast("double") * (w / total) for c, w in zip(probs, weights)), F.lit(0.0))
    return EV.platt_apply(df.withColumn("__blend", blend), "__blend", *(calibrator or (None, None)), out=out).drop("__blend")


def balanced_logistic(df: DataFrame, label: str = LABEL, key: str = "EmployeeNumber"):
    """The encoded table, its slot names and the balanced logistic model's coefficients, fitted on all of ``df``."""
    d, num, cat = training_columns(df, label, key)
    st = fit_statistics(d, num, cat, label)
    d = with_class_weights(apply_statistics(d, st, num, cat), st, label)
    x = encoder(num, cat).fit(d).transform(d)
    names = encoded_feature_names(x)
    total = x.agg(F.sum("w_balanced")).first()[0] or 0.0
    return x, names, [float(c) for c in logistic(total, label=label).fit(x).coefficients.toArray()]


def linear_contributions(df: DataFrame, label: str = LABEL, key: str = "EmployeeNumber") -> DataFrame:
    """L27 (re-aimed): per-row additive contributions coef_j * (x_j - mean_j) of the balanced
    logistic model, long form (key, feature, contribution), one row per encoded slot."""
    x, names, coef = balanced_logistic(df, label, key)
    arr = vector_to_array(F.col("features"))
    means = x.agg(F.array(*[F.avg(arr[i]) for i in range(len(names))]).alias("__mu"))
    x = with_scalars(x.select(key, arr.alias("__x")), means)
    slots = F.array(*[F.struct(F.lit(n).alias("feature"),
                               (F.lit(c) * (F.col("__x")[i] - F.col("__mu")[i])).alias("contribution"))
                      for i, (n, c) in enumerate(zip(names, coef))])
    return x.select(key, F.inline(slots))
