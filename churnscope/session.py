"""Spark session helpers.

The library never hard-codes cluster paths.  ``checkpoint_dir`` reads
``spark.checkpoint.dir`` from the running session; only local sessions fall back
to a scratch folder when the setting is absent.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(cores: int | str = "*", shuffle_partitions: int | None = None,
              app_name: str = "churnscope", driver_memory: str = "16g") -> SparkSession:
    """Local session for tests and the bench; on a cluster use the provided session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app_name)
    conf = dict(LOCAL_CONF)
    conf["spark.driver.memory"] = driver_memory
    if shuffle_partitions is None:
        shuffle_partitions = os.cpu_count() if cores == "*" else int(cores)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only local sessions (tests, bench), whose tasks all run in this process, may leave it unset."""
    found = (spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
             or spark.sparkContext.getCheckpointDir())
    if found:
        return found
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="churnscope-ckpt-")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Set the RDD checkpoint dir from the session setting; only tests get a scratch dir."""
    path = checkpoint_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


#: What bounds the Arrow batches that go to Python workers, and the bounds for rows that hold long texts.
TEXT_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "2m", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """Plans that run meanwhile hand texts to Python workers in small batches: one of 10,000 long texts is held several times over, by
    the executor outside its heap and by the worker.  The session's own settings come back at the end."""
    before = {k: spark.conf.get(k, None) for k in TEXT_BATCHES}
    for k, v in TEXT_BATCHES.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
