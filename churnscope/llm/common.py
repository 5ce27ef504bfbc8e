"""Helpers shared by the operators: tables, written intermediates, hashing and tree sums."""

from __future__ import annotations

import functools
import math
import string
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators between words: space and U+0009 to U+000D.
WORD_BREAK = "[\\x20\\x09-\\x0D]+"
#: Rows that one task of a tree sum adds up.
FAN_IN = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="churnscope-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session whose tasks all run in the driver's own process (``local`` masters, as in tests) may
    leave it unset; it then gets a temporary folder.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _local_dir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends here and survives lost executors."""
    path = scratch(df.sparkSession, name)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z; every other letter stays."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, as UTF-8.

    ``bytes.lower`` and ``bytes.split`` know ASCII only, which is just the rule wanted: A-Z and the separators
    U+0020 and U+0009 to U+000D.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over a uint64 array."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def crc32_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def tree_sum(df: DataFrame, partial: Callable[[Iterator[pd.DataFrame]], np.ndarray | None], piece: int | None = None) -> np.ndarray | None:
    """The sum of float64 arrays of equal shape that ``partial`` makes, one for each partition of ``df``.

    Partial sums meet in rounds of FAN_IN arrays, so neither a task nor the driver gets more than FAN_IN
    of them, however many partitions there are.  With ``piece``, large arrays travel in pieces of so many entries, and the
    driver gets each piece's whole sum only.  None if no partition gives an array.
    """

    def first(batches):
        from pyspark import TaskContext

        made = partial(batches)
        if made is not None:
            flat, step = made.astype(np.float64).ravel(), piece or max(made.size, 1)
            for part, at in enumerate(range(0, max(len(flat), 1), step)):
                yield pd.DataFrame({"slot": [TaskContext.get().partitionId()], "part": [part], "shape": [list(made.shape)], "blob": [flat[at : at + step].tobytes()]})

    def add(pdf):
        total = sum(np.frombuffer(b, np.float64) for b in pdf["blob"])
        return pd.DataFrame({"slot": pdf["slot"][:1], "part": pdf["part"][:1], "shape": pdf["shape"][:1], "blob": [total.tobytes()]})

    schema, n = "slot long, part long, shape array<long>, blob binary", max(1, df.rdd.getNumPartitions())
    sums = df.mapInPandas(first, schema)
    while n > FAN_IN:
        n = math.ceil(n / FAN_IN)
        sums = sums.withColumn("slot", F.col("slot") % n).groupBy("slot", "part").applyInPandas(add, schema)
    if piece and n > 1:
        sums = sums.groupBy("part").applyInPandas(add, schema)
    total, shape = {}, None
    for row in sums.collect():  # FAN_IN rows a piece at most
        one, shape = np.frombuffer(bytes(row["blob"]), np.float64), row["shape"]
        total[row["part"]] = total[row["part"]] + one if row["part"] in total else one
    return np.concatenate([total[k] for k in sorted(total)]).reshape([int(x) for x in shape]) if total else None
