"""Exact additive attributions of a boosted model, from the table of its trees' paths.

The model is written by Spark ML's own writer and its node table read back.  Every leaf is a path: for each feature on it the
interval that the row's value must lie in, and the share of training weight that the feature's splits pass on to the leaf.
With S the features whose value is known, a leaf of value v counts

    v * product over S of [value in interval] * product over the others of their share,

and a feature's attribution is its Shapley value in that game.  It depends on the row only by which intervals hold, so
each leaf has a small table: a row for each of the 2 ** m patterns of its m features (m is at most the trees' depth).  A row's attributions
are sums of table entries, and they add up to its margin less the model's expected margin.

The node and path tables are bounded by the model (rounds x leaves x depth), never by the data; rows are explained where they are.
"""

from __future__ import annotations

import uuid
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: Rows that are explained together.
TOGETHER = 500


def tree_nodes(spark: SparkSession, model: GBTClassificationModel) -> DataFrame:
    """A row for each node: tree, id, value, cover, gain, left, right, feature, threshold (leaves have no left and a feature of -1).

    Two-valued columns, which Spark splits as categories, get a threshold of one half and, where 1 goes left, their
    children exchanged.
    """
    path = f"{checkpoint_dir(spark).rstrip('/')}/models/{uuid.uuid4().hex}"
    model.write().save(path)
    n = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    low = F.col("split.leftCategoriesOrThreshold")
    kinds = F.col("split.numCategories")
    turned = (kinds == 2) & (F.get(low, F.lit(0)) == 1.0)
    threshold = F.when(kinds < 0, F.get(low, F.lit(0))).when(kinds == 2, F.lit(0.5)).when(F.col("leftChild") < 0, F.lit(None))
    threshold = threshold.otherwise(F.raise_error(F.lit("columns of more than two categories are one-hot encoded first")).cast("double"))
    return n.select("tree", "id", F.col("prediction").alias("value"), F.get("impurityStats", F.lit(0)).alias("cover"), "gain",
                    F.when(turned, F.col("rightChild")).otherwise(F.col("leftChild")).alias("left"),
                    F.when(turned, F.col("leftChild")).otherwise(F.col("rightChild")).alias("right"),
                    F.col("split.featureIndex").alias("feature"), threshold.alias("threshold"))


def leaf_paths(nodes: DataFrame, weights: list[float]) -> pd.DataFrame:
    """A row for each leaf and feature on its path: leaf, feature, lo, hi (lo < x <= hi), share, value (times the tree's weight).

    Leaves of a tree without splits have feature -1.  ``nodes`` is as large as the model.
    """
    rows = []
    for tree, own in nodes.toPandas().sort_values(["tree", "id"]).groupby("tree"):
        at = {r.id: r for r in own.itertuples(index=False)}
        todo = [(0, {})]
        while todo:
            i, path = todo.pop()
            node = at[i]
            if node.left < 0:
                leaf = f"{tree}.{i}"
                for f, (lo, hi, share) in sorted(path.items()) or [(-1, (-np.inf, np.inf, 1.0))]:
                    rows.append((leaf, f, lo, hi, share, node.value * weights[tree]))
                continue
            lo, hi, share = path.get(node.feature, (-np.inf, np.inf, 1.0))
            for child, a, b in ((node.left, lo, min(hi, node.threshold)), (node.right, max(lo, node.threshold), hi)):
                part = at[child].cover / node.cover if node.cover else 0.0
                todo.append((child, path | {node.feature: (a, b, share * part)}))
    return pd.DataFrame(rows, columns=["leaf", "feature", "lo", "hi", "share", "value"])


def pattern_table(value: float, share: np.ndarray) -> np.ndarray:
    """Shapley values of a leaf's features for each pattern of intervals that hold (bit j: the j-th feature's): 2 ** m x m."""
    m = len(share)
    out = np.zeros((1 << m, m))
    for pattern in range(1 << m):
        known = np.array([pattern >> j & 1 for j in range(m)], float)
        for i in range(m):
            rest = [j for j in range(m) if j != i]
            total = 0.0
            for size in range(m):
                weight = factorial(size) * factorial(m - size - 1) / factorial(m)
                for chosen in combinations(rest, size):
                    total += weight * np.prod(known[list(chosen)]) * np.prod([share[j] for j in rest if j not in chosen])
            out[pattern, i] = value * (known[i] - share[i]) * total
    return out


def attribution_tables(paths: pd.DataFrame) -> dict:
    """Arrays of ``paths`` for ``explain``, and the expected margin."""
    paths = paths.sort_values(["leaf", "feature"], kind="stable").reset_index(drop=True)
    leaves = paths.groupby("leaf", sort=True)
    expected = float((leaves["share"].prod() * leaves["value"].first()).sum())
    paths = paths[paths["feature"] >= 0].reset_index(drop=True)
    first = np.flatnonzero(np.r_[True, paths["leaf"].to_numpy()[1:] != paths["leaf"].to_numpy()[:-1]]) if len(paths) else np.zeros(0, int)
    sizes = np.diff(np.append(first, len(paths)))
    tables, begins, at = [], [], 0
    for a, n in zip(first, sizes):
        own = pattern_table(paths["value"][a], paths["share"].to_numpy()[a : a + n])
        begins.append(at)
        tables.append(own.ravel())
        at += own.size
    bit = np.arange(len(paths)) - np.repeat(first, sizes)
    return {"expected": expected, "feature": paths["feature"].to_numpy(), "lo": paths["lo"].to_numpy(), "hi": paths["hi"].to_numpy(), "bit": bit, "first": first,
            "sizes": sizes, "begins": np.array(begins, np.int64), "flat": np.concatenate(tables) if tables else np.zeros(0)}


def explain(t: dict, x: np.ndarray) -> np.ndarray:
    """Attributions (rows x features) of encoded rows."""
    out = np.zeros(x.shape)
    if not len(t["feature"]) or not len(x):
        return out
    own = x[:, t["feature"]]
    holds = (own > t["lo"]) & (own <= t["hi"])
    pattern = np.add.reduceat(holds.astype(np.int64) << t["bit"], t["first"], axis=1)
    entry = np.repeat(t["begins"] + pattern * t["sizes"], t["sizes"], axis=1) + t["bit"]
    values = t["flat"][entry]
    order = np.argsort(t["feature"], kind="stable")
    feature = t["feature"][order]
    begin = np.flatnonzero(np.r_[True, feature[1:] != feature[:-1]])
    out[:, feature[begin]] = np.add.reduceat(values[:, order], begin, axis=1)
    return out


def tree_contributions(df: DataFrame, model: GBTClassificationModel, names: list[str], key: str, features: str = "features") -> DataFrame:
    """Key, margin, expected_margin and contributions (an array of feature and value for each encoded slot) of encoded rows."""
    spark = df.sparkSession
    tables = attribution_tables(leaf_paths(tree_nodes(spark, model), list(model.treeWeights)))
    shared = spark.sparkContext.broadcast(tables)  # bounded by the model's size
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        t = shared.value
        for pdf in batches:
            for at in range(0, len(pdf), TOGETHER):
                part = pdf.iloc[at : at + TOGETHER]
                values = explain(t, np.stack(part["x"].to_numpy()).astype(float))
                yield pd.DataFrame({"k": part["k"].to_numpy(), "margin": values.sum(1) + t["expected"], "values": list(values)})

    rows = df.select(F.col(key).alias("k"), vector_to_array(F.col(features)).alias("x"))
    found = rows.mapInPandas(run, f"k {kind}, margin double, values array<double>")
    slots = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("feature"), F.col("values").alias("value"))
    return found.select(F.col("k").alias(key), "margin", F.lit(tables["expected"]).alias("expected_margin"), slots.alias("contributions"))


def gain_importance(spark: SparkSession, model: GBTClassificationModel, names: list[str]) -> DataFrame:
    """feature, importance (its splits' gain weighted by cover, as a share of the whole), splits: a row for each encoded slot."""
    nodes = tree_nodes(spark, model).where("left >= 0")
    weights = F.element_at(F.array(*[F.lit(float(w)) for w in model.treeWeights]), F.col("tree") + 1)
    own = nodes.groupBy("feature").agg(F.sum(F.col("gain") * F.col("cover") * weights).alias("gain"), F.count(F.lit(1)).alias("splits"))
    slots = spark.createDataFrame(list(enumerate(names)), "slot int, name string")  # a row for each encoded slot
    whole = own.agg(F.sum("gain")).first()[0] or 1.0
    found = slots.join(own, slots["slot"] == own["feature"], "left")
    return found.select(F.col("name").alias("feature"), (F.coalesce("gain", F.lit(0.0)) / whole).alias("importance"), F.coalesce("splits", F.lit(0)).alias("splits"))
