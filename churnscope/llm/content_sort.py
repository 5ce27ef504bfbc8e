"""Exact duplicate documents by content sort (operator 12).

Texts are equal when they are identical after every run of white space (U+0020, U+0009 to U+000D) became one space.

1. Splitters, sampled by Spark, range-partition the normalised texts by their first HEAD characters.  Texts with the same
   head are told apart by the digest of the whole text, copies by id and row number, so that neither a common opening nor a
   group of copies that holds a third of all rows lands in one partition, and a sampled key has a bounded size.
2. Each partition is sorted (Spark spills to disk) by head, digest, whole text, id: equal texts are neighbours.
3. Every text is compared in full with the one before it.  A run of equal texts knows its size and its first, smallest id at once;
   only a partition's first and last run can go on in a neighbouring partition.  Those, two texts a
   partition at most, are compared in full with the next partition's, and chains of equal ones are added up.

Nothing but ids of the current run is held in a task, and the driver gets only Spark's sampled keys.

Cases: a null text counts as empty; empty texts, and texts of white space alone, are groups like others; a row without
id comes last in its group (keep_id is null only if no row of the group has an id); of rows that repeat an id
and a text exactly one is kept; empty tables give empty results; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

#: Characters of a text that its range key holds.
HEAD = 64
#: Runs of white space other than a single space.
_RUNS = "\\x20[\\x20\\x09-\\x0D]+|[\\x09-\\x0D][\\x20\\x09-\\x0D]*"
#: Places of a run in its partition: inside, first, last, both.
INNER, FIRST, LAST = 0, 1, 2


def normalised(text: Column) -> Column:
    """The text with one space for each run of white space; an empty one for null."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), _RUNS, " ")


def _take(found: list[tuple], schema: pa.Schema, place: int, text: pa.Scalar | None = None):
    """Record batches of rows (ids, prints, docs, run starts) whose runs are complete."""
    for ids, prints, docs, starts in found:
        n = len(ids)
        size = np.diff(np.append(starts, n))
        first = np.repeat(starts, size)
        leads = np.arange(n) == first
        edge_text = [None] * n
        if text is not None:
            edge_text[0] = text.as_py()
        columns = {"doc_id": ids, "print": prints, "keep_id": ids.take(pa.array(first)), "size": pa.array(np.repeat(size, size), pa.int64()), "leads": pa.array(leads),
                   "part": pa.array(np.full(n, _part(), np.int32)), "place": pa.array(np.full(n, place, np.int32)), "edge_text": pa.array(edge_text, pa.string())}
        if docs is not None:
            columns["doc"] = docs
        yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name != "doc" else columns["doc"] for f in schema], names=schema.names)


def _part() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _joined(arrays: list[pa.Array]) -> pa.Array:
    return pa.concat_arrays(arrays) if len(arrays) > 1 else arrays[0]


def _runs(with_rows: bool):
    """A function over a sorted partition's record batches: its rows with their runs' size and smallest id."""
    schema = pa.schema([("doc_id", pa.int64()), ("print", pa.string()), ("keep_id", pa.int64()), ("size", pa.int64()), ("leads", pa.bool_()), ("part", pa.int32()), ("place", pa.int32()), ("edge_text", pa.string())])

    def run(batches):
        out = pa.schema([*schema, pa.field("doc", pa.null())]) if with_rows else schema
        held: list[tuple] = []  # the open run: (ids, prints, docs) of each batch
        open_text, closed = None, 0

        def close(place):
            ids, prints = (_joined([h[i] for h in held]) for i in range(2))
            docs = _joined([h[2] for h in held]) if with_rows else None
            return _take([(ids, prints, docs, np.zeros(1, np.int64))], out, place, open_text if place else None)

        for batch in batches:
            n = len(batch)
            if not n:
                continue
            text, ids, prints = (batch.column(x) for x in ("norm", "doc_id", "print"))
            docs = batch.column("doc") if with_rows else None
            new = np.ones(n, bool)
            new[1:] = pc.not_equal(text.slice(1), text.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            new[0] = open_text is None or open_text.as_py() != text[0].as_py()
            starts = np.flatnonzero(new)
            cut = lambda a, i, j: None if a is None else a.slice(i, j - i)
            if not len(starts):
                held.append((ids, prints, docs))
                continue
            if starts[0]:
                held.append(tuple(cut(a, 0, int(starts[0])) for a in (ids, prints, docs)))
            begin, last = int(starts[0]), int(starts[-1])
            if held:
                yield from close(INNER if closed else FIRST)
                closed += 1
            elif not closed and last > begin:
                # the partition's first run is known here to be complete: it goes by itself
                second = int(starts[1])
                held, open_text = [tuple(cut(a, begin, second) for a in (ids, prints, docs))], text[begin]
                yield from close(FIRST)
                closed, begin = 1, second
                starts = starts[1:]
            if last > begin:
                yield from _take([tuple(cut(a, begin, last) for a in (ids, prints, docs)) + (starts[:-1] - begin,)], out, INNER)
                closed += len(starts) - 1
            held, open_text = [tuple(cut(a, last, n) for a in (ids, prints, docs))], text[last]
        if held:
            yield from close(LAST if closed else FIRST | LAST)

    return run


def deduplicate(docs: DataFrame, with_rows: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of (doc_id, text); on request also ``doc``, the whole row."""
    spark = docs.sparkSession
    whole = [F.struct(*docs.columns).alias("doc")] if with_rows else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("norm"), *whole)
    rows = rows.select(F.substring("norm", 1, HEAD).alias("head"), F.sha2(F.col("norm").cast("binary"), 256).alias("print"), "doc_id", F.monotonically_increasing_id().alias("row"), "norm", *["doc"] * with_rows)
    by_id = F.col("doc_id").asc_nulls_last()
    ranged = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "head", "print", by_id, "row")
    ordered = ranged.sortWithinPartitions("head", "print", "norm", by_id, "row").select("doc_id", "print", "norm", *["doc"] * with_rows)
    kind = f", doc {rows.schema['doc'].dataType.simpleString()}" if with_rows else ""
    runs = ordered.mapInArrow(_runs(with_rows), "doc_id long, print string, keep_id long, size long, leads boolean, part int, place int, edge_text string" + kind)
    runs = materialise(runs, "runs")

    # the runs at partitions' ends, in order: equal neighbours are one group
    ends = runs.filter("edge_text is not null").select("part", "place", "edge_text", "keep_id", "size")
    order = ends.select("part", "place", F.row_number().over(Window.orderBy("part", "place")).alias("seq"))  # two small rows a partition
    ends = ends.join(order, ["part", "place"])
    before = ends.select((F.col("seq") + 1).alias("seq"), F.col("edge_text").alias("text_before"))
    ends = ends.join(before, "seq", "left").withColumn("starts", (F.col("text_before").isNull() | (F.col("text_before") != F.col("edge_text"))).cast("int"))
    ends = ends.select("seq", "part", "place", "keep_id", "size", "starts").withColumn("chain", F.sum("starts").over(Window.orderBy("seq")))
    chains = ends.groupBy("chain").agg(F.min_by("keep_id", "seq").alias("keep"), F.sum("size").alias("total"))
    ends = ends.join(chains, "chain").select("part", "place", F.col("keep").alias("chain_keep"), "total", (F.col("starts") == 1).alias("opens"))
    # two rows a partition at most
    found = runs.join(F.broadcast(ends), ["part", "place"], "left")
    inner = F.col("total").isNull()
    return found.select(
        "doc_id", F.when(inner, F.col("keep_id")).otherwise(F.col("chain_keep")).alias("keep_id"), F.coalesce("total", "size").alias("group_size"),
        (F.col("leads") & F.coalesce("opens", F.lit(True))).alias("kept"), F.col("print").alias("text_sha256"), *["doc"] * with_rows,
    )


def unique_documents(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns."""
    return deduplicate(docs, with_rows=True).filter("kept").select("doc.*")


def op12_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))


SPARK = {"op12_content_sort": op12_content_sort}
SQL = {
    "op12_content_sort": """
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)"""
}
