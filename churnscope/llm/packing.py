"""Conflict-constrained best-fit packing of documents into training sequences (operator 9).

Documents are cut into pieces of at most ``capacity`` words and the pieces packed into sequences (bins) of that
size, longest first, each into the bin that it leaves least room in.  Two pieces conflict, and so never share a
bin, when they come from the same source or from copies of one text (equal after lower-casing and
collapsing white space).  Bins are kept ordered by room left and carry bitmaps of the sources and clusters
inside; the search starts at the first bin with enough room and goes on to its successors until one has no
conflict: that is the tightest compatible bin.  As one source or cluster may hold a large share of the pieces,
the frequent ones have orderings of their own that hold only bins without them, so the successor search
isn't a walk over all bins.

Pieces are dealt by a hash of their document, piece and copy number into shards of about SHARD pieces, which are packed apart from each
other; only ids, lengths, sources and clusters go there, not texts.  A shard's size doesn't grow with the
table, and hot sources and clusters spread over all shards.

Cases: a null or empty text (no words) takes no room: one row with 0 words and no bin; a null source or a
text without cluster conflicts with nothing; repeated rows are packed as often as they occur and, being copies,
into different bins; a word count above capacity fills bins of its own and the rest is packed as one piece;
ties go to the smaller document id, then piece, then the bin opened first; empty tables give no rows.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_BREAK, table

CAPACITY = 2048
SHARD = 16384
#: Share of a shard's pieces from which a source or cluster gets an ordering of its own.
HOT = 0.01


def best_fit(pieces: list[tuple[int, int | None, int | None]], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece (size, source, cluster), taken in the order given.

    Each piece goes to the compatible bin with the least room that holds it, the first opened among equals,
    or to a new bin.
    """
    least = max(2.0, HOT * len(pieces))
    per_source, per_cluster = Counter(s for _, s, _ in pieces), Counter(c for _, _, c in pieces)
    # only what occurs twice can conflict and needs a bit
    source_bit = {s: 1 << i for i, s in enumerate(x for x, n in per_source.items() if n > 1 and x is not None)}
    cluster_bit = {c: 1 << i for i, c in enumerate(x for x, n in per_cluster.items() if n > 1 and x is not None)}
    bits = [(source_bit.get(s, 0), cluster_bit.get(c, 0)) for _, s, c in pieces]
    hot_s = {b for s, b in source_bit.items() if per_source[s] >= least}
    hot_c = {b for c, b in cluster_bit.items() if per_cluster[c] >= least}
    profiles = [(s if s in hot_s else 0, c if c in hot_c else 0) for s, c in bits]
    order: dict[tuple[int, int], list[tuple[int, int]]] = {p: [] for p in profiles}  # (room, bin) of compatible bins
    room: list[int] = []
    sources: list[int] = []
    clusters: list[int] = []
    into, offset = [], []
    for (size, _, _), (s, c), profile in zip(pieces, bits, profiles):
        bins = order[profile]
        at = bisect_left(bins, (size, -1))
        while at < len(bins) and (sources[bins[at][1]] & s or clusters[bins[at][1]] & c):
            at += 1
        if at < len(bins):
            b = bins[at][1]
            for (ps, pc), other in order.items():
                if not (sources[b] & ps or clusters[b] & pc):
                    del other[bisect_left(other, (room[b], b))]
        else:
            b = len(room)
            room.append(capacity)
            sources.append(0)
            clusters.append(0)
        into.append(b)
        offset.append(capacity - room[b])
        room[b] -= size
        sources[b] |= s
        clusters[b] |= c
        if room[b]:  # a full bin is in no ordering
            for (ps, pc), other in order.items():
                if not (sources[b] & ps or clusters[b] & pc):
                    insort(other, (room[b], b))
    return into, offset


def count_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, WORD_BREAK), lambda w: w != "")), F.lit(0))


def cluster_of(text: Column) -> Column:
    """A 64-bit key that copies of a text share; null for texts without words."""
    plain = F.trim(F.regexp_replace(F.lower(text), WORD_BREAK, " "))
    return F.when(plain != "", F.xxhash64(plain))


def pack(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, cluster: Column | None = None) -> DataFrame:
    """One row for each piece of each document: doc_id, piece, n_words, bin, bin_offset, and the document's source.

    ``docs``: doc_id, text, source; other columns are not looked at.  ``bin`` is unique over the whole result.
    ``cluster``: a long that copies share, instead of ``cluster_of(text)``.
    """
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        count_words(F.col("text")).alias("words"), (cluster_of(F.col("text")) if cluster is None else cluster).alias("cluster"),
    )
    empty = sized.filter("words = 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).alias("n_words"), F.lit(None).cast("long").alias("bin"), F.lit(None).cast("int").alias("bin_offset"), "source")
    full = sized.filter("words > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("words") / capacity).cast("int") - 1)))
    full = full.withColumn("n_words", F.least(F.lit(capacity), F.col("words") - F.col("piece") * capacity))
    total = sized.agg(F.sum(F.ceil(F.col("words") / capacity))).first()[0] or 0
    shards = max(1, math.ceil(total / shard))
    # rows that repeat a document are counted and numbered, so that they spread over the shards as well
    alike = full.groupBy("doc_id", "source", "cluster", "piece", "n_words").agg(F.count("*").alias("times"))
    alike = alike.withColumn("thousand", F.explode(F.sequence(F.lit(0), F.floor((F.col("times") - 1) / 1000))))
    alike = alike.withColumn("copy", F.explode(F.sequence(F.lit(0), F.least(F.lit(999), F.col("times") - 1 - F.col("thousand") * 1000))))
    dealt = alike.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "thousand", "copy"), F.lit(shards)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_words", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        source, cluster = (pdf[c].astype(object).where(pdf[c].notna(), None) for c in ("source", "cluster"))
        into, offset = best_fit(list(zip(pdf["n_words"].tolist(), source, cluster)), capacity)
        own = pdf[["doc_id", "piece", "n_words", "source"]].copy()
        own["bin"] = pdf["shard"].iloc[0] * 2**32 + pd.Series(into, index=own.index, dtype="int64")
        own["bin_offset"] = pd.Series(offset, index=own.index, dtype="int32")
        return own

    names = ["doc_id", "piece", "n_words", "bin", "bin_offset", "source"]
    packed = dealt.select("shard", "doc_id", "piece", "n_words", "source", F.col("cluster").cast("string")).groupBy("shard").applyInPandas(
        one, "doc_id long, piece int, n_words int, source string, bin long, bin_offset int"
    )
    return packed.select(names).unionByName(empty.select(names))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


SPARK = {"op9_packing": op9_packing}
SQL: dict[str, str] = {}
