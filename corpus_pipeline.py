"""A training corpus from ``documents``: quality, language, near duplicates, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what a stage returns as
Parquet in the shared folder and gives it, reread, to the next one.  A stage works on all rows that its
predecessor kept, and all but the last return the columns of ``documents``.  Stages may get empty tables; rows with
null or empty texts are judged like others (see the operators' notes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope.llm import language_id, minhash, packing, quality
from churnscope.llm.common import materialise, table

#: Near duplicates: words of a shingle, and the least similarity in percent.
WORDS, PERCENT = 5, 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on ``labels``, doesn't reject (score of 0.5 or more)."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.learn(docs.select("doc_id", "text"), labels, F.lit(True))
    return docs.filter(quality.scorer(spark, model)("text") >= 0.5)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are text in one of the learned languages; those without a letter or far off any go."""
    model = language_id.learn(docs.select("doc_id", "text", "lang"), F.lit(True))
    return docs.filter(~language_id.identifier(spark, model)("text")["rejected"])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: one with the smallest id, if any has an id.

    Rows are told apart by a number of their own, not by id: repeated rows go, and other texts of an id are judged by themselves.
    """
    rows = materialise(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")), "rows", "zstd")
    found = minhash.near_duplicates(rows.select(F.col("row").alias("doc_id"), "doc.text"), WORDS, PERCENT)
    found = materialise(found.select(F.col("doc_id").alias("row"), "component_id"), "found")
    ids = found.join(rows.select("row", F.col("doc.doc_id").alias("id")), "row")
    best = ids.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best"))
    return rows.join(best.select("best.row"), "row", "left_semi").select("doc.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' pieces and their places in training sequences."""
    return packing.pack(docs.select("doc_id", "text", "source"))


STAGES = [
    ("quality", keep_good),
    ("language", keep_language),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack_sequences),
]

#: The learned stages aren't SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage: doc_id, piece, n_words, bin, bin_offset, source."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
