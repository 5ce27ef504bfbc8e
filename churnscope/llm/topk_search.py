"""Exact top-k search by inner product (operator 4).

Vectors become integers, floor(256 * x), and the score is their inner product.  By Cauchy-Schwarz a score is
at most the product of the two lengths, so candidates are laid out by descending length in blocks of about
BLOCK rows; every vector is also rotated onto the right singular vectors of the whole table, which gathers
most of its length in the leading coordinates.  Two waves of block joins follow:

1. every query meets the block of the longest vectors, which sets its k-th best score so far;
2. it then meets only those blocks whose longest vector could still reach that score.

Within a block, chunks of descending length are dropped for a query when length * length falls below its
threshold; what is left gets the partial product over the LEAD leading rotated coordinates plus the product
of the remaining lengths as an upper bound, and only pairs whose bound reaches the threshold are scored, in
whole numbers.  Bounds are widened by SLACK, so that rounding can't drop a pair; ties are never dropped.

Both sides of a block join are bounded: BLOCK candidates by QUERIES queries, however many rows there are.

Cases: vectors that are null or hold null or non-finite components, and rows without id, take no part;
shorter vectors count as filled up with zeros; rows with a query's own id are its own row; repeated rows with
another id compete as they are; fewer than k candidates give fewer rows; empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, table, tree_sum

BLOCK = 4096
QUERIES = 2048
CHUNK = 512
LEAD = 16
SLACK = 1e-6


def _stack(lists, dim: int) -> np.ndarray:
    out = np.zeros((len(lists), dim))
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def exact_products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All inner products of integer-valued rows as int64.  float64 is exact while sums stay below 2**53."""
    if len(q) and len(c) and np.abs(q).max() * np.abs(c).max() * q.shape[1] < 2**53:
        return (q @ c.T).astype(np.int64)
    return q.astype(np.int64) @ c.astype(np.int64).T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id, as an array (rows x up to k)."""
    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)
    return order[:, :k]


def search_block(qid, q, qr, floor, cid, c, cr, k: int) -> pd.DataFrame:
    """The best k candidates of a block for each query, as far as they reach its ``floor``.

    q, c: integer-valued rows; qr, cr: the same rotated; c by descending length.  floor: what a score must
    reach; only scores above or at it can matter.
    """
    n, low = len(qid), -np.iinfo(np.int64).max
    qlen, clen = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
    qrest, crest = (np.sqrt(np.maximum(0, x**2 - (r[:, :LEAD] ** 2).sum(1))) for x, r in ((qlen, qr), (clen, cr)))
    top, who = np.full((n, k), low), np.full((n, k), np.iinfo(np.int64).max)
    for at in range(0, len(cid), CHUNK):
        part = slice(at, at + CHUNK)
        least = np.maximum(floor, np.where(top[:, -1] == low, -np.inf, top[:, -1]))
        wide = SLACK * (1 + qlen * clen[at])
        alive = np.flatnonzero(qlen * clen[at] + wide >= least)
        if not len(alive):
            break  # all later candidates are shorter still
        bound = qr[alive, :LEAD] @ cr[part, :LEAD].T + qrest[alive, None] * crest[None, part] + wide[alive, None]
        may = (bound >= least[alive, None]) & (qid[alive, None] != cid[None, part])
        found = np.full(may.shape, low)
        if may.mean() > 0.05:
            found[may] = exact_products(q[alive], c[part])[may]
        else:
            i, j = np.nonzero(may)
            safe = not len(i) or np.abs(q).max() * np.abs(c).max() * q.shape[1] < 2**53
            a, b = (q[alive][i], c[part][j]) if safe else (q[alive][i].astype(np.int64), c[part][j].astype(np.int64))
            found[i, j] = np.einsum("ij,ij->i", a, b).astype(np.int64)
        scores = np.hstack([top[alive], found])
        ids = np.hstack([who[alive], np.broadcast_to(cid[part], found.shape)])
        best = _best(scores, ids, k)
        top[alive], who[alive] = np.take_along_axis(scores, best, 1), np.take_along_axis(ids, best, 1)
    row, place = np.nonzero((top > low) & (top >= np.where(np.isfinite(floor), floor, -np.inf)[:, None]))
    return pd.DataFrame({"query_id": qid[row], "vec_id": who[row, place], "score": top[row, place]})


def _search(queries: DataFrame, candidates: DataFrame, dim: int, turn: np.ndarray, k: int) -> DataFrame:
    """Block joins: queries (qb, cb, query_id, asked, floor) with candidates (qb, cb, vec_id, held)."""

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        q, c = _stack(left["asked"], dim), _stack(right["held"], dim)
        order = np.argsort(-(c**2).sum(1), kind="stable")
        c = c[order]
        cid = right["vec_id"].to_numpy()[order]
        return search_block(left["query_id"].to_numpy(), q, q @ turn, left["floor"].to_numpy(), cid, c, c @ turn, k)

    return queries.groupBy("qb", "cb").cogroup(candidates.groupBy("qb", "cb")).applyInPandas(meet, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query among all other rows."""
    good = F.col("id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    ints = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x"), is_query.alias("is_query"))
    ints = ints.filter(good).select("id", F.transform("x", lambda v: F.floor(v * 256).cast("double")).alias("q"), F.coalesce("is_query", F.lit(False)).alias("is_query"))
    size = ints.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("dim"), F.count_if("is_query").alias("asked")).first()
    n, dim = size["n"], max(1, size["dim"] or 1)
    blocks, qblocks = max(1, math.ceil(n / BLOCK)), max(1, math.ceil(size["asked"] / QUERIES))

    def gram(batches):
        total = np.zeros((dim, dim))
        for pdf in batches:
            x = _stack(pdf["q"], dim)
            total += x.T @ x
        return total

    summed = tree_sum(ints.select("q"), gram)
    turn = np.linalg.eigh(summed if summed is not None else np.zeros((dim, dim)))[1][:, ::-1].copy()

    length = F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, v: a + v * v))
    laid = materialise(
        ints.withColumn("len", length).repartitionByRange(blocks, F.col("len").desc(), "id").withColumn("cb", F.spark_partition_id()), "by-length"
    )
    longest = [r["len"] for r in laid.groupBy("cb").agg(F.max("len").alias("len")).orderBy("cb").collect()]  # 8 bytes for each BLOCK rows
    names = [r["cb"] for r in laid.select("cb").distinct().orderBy("cb").collect()]
    number = F.pmod(F.xxhash64("id"), F.lit(qblocks)).cast("int")
    queries = laid.filter("is_query").select(F.col("id").alias("query_id"), F.col("q").alias("asked"), "len", number.alias("qb"))
    candidates = laid.select(F.col("id").alias("vec_id"), F.col("q").alias("held"), F.col("cb").alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(qblocks - 1))).alias("qb"))
    if not names:
        return laid.select(F.lit(0).cast("long").alias("query_id"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("score")).limit(0)

    first = names[0]
    opening = queries.withColumns({"cb": F.lit(first), "floor": F.lit(float("-inf"))})
    start = materialise(_search(opening, candidates.filter(F.col("cb") == first), dim, turn, k), "first-wave")
    sure = start.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("found"))
    floor = F.when(F.col("found") >= k, F.col("least").cast("double")).otherwise(F.lit(float("-inf")))
    later = queries.join(sure, "query_id", "left").withColumn("floor", F.coalesce(floor, F.lit(float("-inf"))))
    reach = F.filter(
        F.arrays_zip(F.lit(names[1:]).cast("array<int>").alias("cb"), F.lit(longest[1:]).cast("array<double>").alias("most")),
        lambda b: F.col("len") * b["most"] * (1 + SLACK) + SLACK >= F.col("floor"),
    )
    rest = later.withColumn("block", F.explode(reach)).select("query_id", "asked", "floor", "qb", F.col("block.cb").alias("cb"))
    found = start.unionByName(_search(rest, candidates.filter(F.col("cb") != first), dim, turn, k)) if names[1:] else start
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SPARK = {"op4_topk_search": op4_topk_search}
SQL = {
    "op4_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5"""
}
