"""Near-duplicate documents by fast similarity sketching (operator 8).

A document's set holds the 64-bit hashes of its distinct word shingles.  Its sketch has SIZE
coordinates, filled in rounds: in each of the first t rounds every element is hashed into one bin with a value, a
round counts less than all later ones, and a bin keeps its least value.  Most sets fill all bins in a
round or two; round t + i puts every element into bin i, so after 2t rounds no coordinate is empty.  Two sets
agree in a coordinate with about the probability of their similarity, and the share that agrees concentrates
as it does for independent hashes, at a fraction of the cost.

ROWS coordinates make a band, BANDS bands are used.  Documents that share a band are candidates, and links are confirmed on the full sets:

1. Copies (equal sets) are one node, named by a 64-bit hash of the set's print; the smallest id goes with it and names the component.
2. In each bucket (documents of equal band) every node is checked against the bucket's smallest node, and the
   confirmed links are joined to components.  A large group of near copies becomes one component here,
   with a number of checks linear in its size.
3. Only pairs that share a bucket and are still in different components are then looked at.  Buckets of up to SMALL nodes
   give them as rows.  Larger ones are dealt out as pairs of blocks, with the full sets, and compared inside tasks: a pair counts in
   the first bucket that it shares, and only links that join two components of the task become rows, fewer than its nodes.  A block
   has about SIDE nodes and ELEMENTS shingles at most, so a task's memory doesn't depend on the group.

A pair at the least similarity of 0.8 shares no band with a probability of (1 - 0.8**6)**40, about 5e-6; every pair that shares one
is decided on its full sets, unless the two are already joined.

Cases: a null or empty text, or one without words, has an empty set and is linked with nothing; a text with
fewer words than a shingle is one shingle; a row without id takes no part in links and keeps a null component; rows
that repeat an id get the same result if their texts are equal, else each that of its text; empty tables give empty results; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, mix64, table, words_of
from .components import connected_components

WORDS = 4
PERCENT = 80
BANDS, ROWS = 40, 6
SIZE = BANDS * ROWS
SMALL, SIDE, ELEMENTS = 16, 500, 2_000_000
TOGETHER = 1000
EMPTY = np.uint64(2**64 - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    split = [words_of(t) for t in texts]
    number: dict[bytes, int] = {}
    for ws in split:
        for w in ws:
            number.setdefault(w, len(number))
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
    out = []
    for ws in split:
        if not ws:
            out.append(np.empty(0, np.uint64))
            continue
        h = hashed[np.fromiter(map(number.__getitem__, ws), np.int64, len(ws))]
        size = min(words, len(h))
        n = len(h) - size + 1
        one = mix64(h[:n] + np.uint64(size))
        for j in range(1, size):
            one = mix64(one * _STEP + h[j : j + n])
        out.append(np.unique(one))
    return out


def sketches(sets: list[np.ndarray], size: int) -> np.ndarray:
    """The sketch of each non-empty set: an array (sets x size)."""
    out = np.full(len(sets) * size, EMPTY)
    lengths = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate([*sets, np.empty(0, np.uint64)])
    owner = np.repeat(np.arange(len(sets)), lengths)
    for rnd in range(2 * size):
        h = mix64(flat + np.uint64((int(_STEP) * (rnd + 1)) % 2**64))
        if rnd < size:
            bins = ((h & np.uint64(0xFFFF)) * np.uint64(size) >> np.uint64(16)).astype(np.int64)
        else:
            bins = rnd - size
        np.minimum.at(out, owner * size + bins, np.uint64(rnd << 48) | h >> np.uint64(16))
        docs = np.unique(owner)
        left = docs[(out.reshape(-1, size)[docs] == EMPTY).any(axis=1)]
        if not len(left):
            break
        if len(left) < len(docs):
            keep = np.isin(owner, left)
            flat, owner = flat[keep], owner[keep]
    return out.reshape(-1, size)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each sketch."""
    parts = sketch.reshape(len(sketch), bands, rows)
    key = mix64(np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _STEP, parts.shape[:2]).copy())
    for j in range(rows):
        key = mix64(key * _STEP + parts[:, :, j])
    return key.view(np.int64)


def _sketched(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, print (equal for equal sets; null for an empty one), bands."""

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), TOGETHER):
                part = pdf.iloc[at : at + TOGETHER]
                sets = shingle_sets(part["text"].tolist(), words)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = band_keys(sketches([sets[i] for i in full], SIZE), BANDS, ROWS)
                bands, prints = [None] * len(sets), [None] * len(sets)
                for i, k in zip(full, keys):
                    bands[i], prints[i] = k, xxhash.xxh3_128_hexdigest(sets[i].tobytes())
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("string").astype("Int64"), "n_shingles": [len(s) for s in sets], "print": prints, "bands": bands})

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id long, n_shingles long, print string, bands array<long>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """node, set of the rows given."""

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), TOGETHER):
                part = pdf.iloc[at : at + TOGETHER]
                sets = shingle_sets(part["text"].tolist(), words)
                yield pd.DataFrame({"print": [xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets], "set": [s.view(np.int64) for s in sets]})

    made = docs.select("text").mapInPandas(run, "print string, set array<long>")
    return made.select(F.xxhash64("print").alias("node"), "set").dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) whose full sets are similar enough."""
    first, second = (sets.select(F.col("node").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
    both = F.size(F.array_intersect("set_a", "set_b"))
    near = 100 * both >= percent * (F.size("set_a") + F.size("set_b") - both)
    return pairs.join(first, "a").join(second, "b").filter(near).select("a", "b")


def _joining(large: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) that join the components of ``large`` bucket rows (key, band, node, n_shingles, component, m, elements);
    ``nodes`` has the bands and the set of each node."""
    blocks = F.ceil(F.greatest(F.col("m") / SIDE, F.col("elements") / ELEMENTS)).cast("int")
    rows = large.join(nodes, "node").withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("node", F.lit(51)), blocks).cast("int")})
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "band", "node", "component", "bands", "set")

    def compare(key, pdf):
        _, low, high = key
        node, block, band = (pdf[x].to_numpy() for x in ("node", "block", "band"))
        bands = np.stack(pdf["bands"].to_numpy())
        sizes = pdf["set"].str.len().to_numpy().astype(np.int64)
        ends = np.cumsum(sizes)
        known, word = np.unique(np.concatenate(pdf["set"].to_numpy()), return_inverse=True)
        words = np.split(word, ends[:-1])
        own = np.unique(pdf["component"].to_numpy(), return_inverse=True)[1]
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        mark, links = np.zeros(len(known), bool), []
        for i in left:
            may = (own[right] != own[i]) & (100 * np.minimum(sizes[right], sizes[i]) >= percent * np.maximum(sizes[right], sizes[i]))
            if low == high:
                may &= node[right] > node[i]
            js = right[may]
            js = js[(bands[js] == bands[i]).argmax(1) == band[0]]  # the first bucket that both are in
            if not len(js):
                continue
            mark[words[i]] = True
            both = np.add.reduceat(mark[np.concatenate([words[j] for j in js])], np.cumsum(sizes[js]) - sizes[js], dtype=np.int64)
            mark[words[i]] = False
            for j in js[100 * both >= percent * (sizes[i] + sizes[js] - both)]:
                if own[i] != own[j]:
                    links.append((node[i], node[j]))
                    own[own == own[j]] = own[i]
        return pd.DataFrame(np.array(links, np.int64).reshape(-1, 2), columns=["a", "b"])

    return rows.groupBy("key", "low", "high").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    all_rows = materialise(_sketched(docs, words), "sketched")
    linked = all_rows.filter("doc_id is not null and print is not null")
    nodes = linked.groupBy("print", "n_shingles").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    nodes = materialise(nodes.withColumn("node", F.xxhash64("print")), "nodes")
    members = nodes.select("node", "n_shingles", F.posexplode("bands").alias("band", "key"))
    buckets = members.groupBy("key").agg(F.min(F.struct("node", "n_shingles")).alias("centre"), F.count("*").alias("n")).filter("n > 1").select("key", "centre")
    crowded = materialise(members.join(buckets, "key"), "buckets")
    # the sets of all that meet anyone, made once for both rounds of checks
    wanted = nodes.select("node", "doc_id").join(crowded.select("node").distinct(), "node", "left_semi").select("doc_id").distinct()
    sets = materialise(_sets(docs.join(wanted, "doc_id", "left_semi"), words), "sets")
    alike = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))  # noqa: E731  no set can be as similar to one of another size

    stars = crowded.filter((F.col("node") != F.col("centre.node")) & alike(F.col("n_shingles"), F.col("centre.n_shingles")))
    stars = materialise(stars.select(F.col("node").alias("a"), F.col("centre.node").alias("b")).distinct(), "stars")
    joined = connected_components(_confirmed(stars, sets, percent))

    placed = crowded.join(joined.select(F.col("id").alias("node"), "component"), "node", "left").select("key", "band", "node", "n_shingles", F.coalesce("component", "node").alias("component"))
    placed = materialise(placed, "placed")
    groups = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("m"), F.sum("n_shingles").alias("elements"))
    open_rows = materialise(placed.join(groups.filter("low < high").select("key", "m", "elements"), "key"), "open")
    # every pair of a small bucket
    small = open_rows.filter(F.col("m") <= SMALL)
    left = small.select("key", "component", F.col("node").alias("a"), F.col("n_shingles").alias("n_a"))
    right = small.select("key", F.col("component").alias("other"), F.col("node").alias("b"), F.col("n_shingles").alias("n_b"))
    meet = left.join(right, "key").filter((F.col("a") < F.col("b")) & (F.col("component") != F.col("other")) & alike(F.col("n_a"), F.col("n_b")))
    rest = meet.select("a", "b").distinct().join(stars.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
    links = _confirmed(materialise(rest, "rest"), sets, percent)
    links = links.unionByName(_joining(open_rows.filter(F.col("m") > SMALL), nodes.select("node", "bands").join(sets, "node"), percent))
    final = connected_components(joined.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(links))

    named = nodes.select("print", "node", "doc_id").join(final.withColumnRenamed("id", "node"), "node", "left").select("print", "doc_id", F.coalesce("component", "node").alias("component"))
    named = materialise(named, "named")
    roots = materialise(named.join(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").select("print", "component_id"), "roots")
    rows = linked.select("doc_id", "n_shingles", "print").join(roots, "print").select("doc_id", "n_shingles", "component_id")
    alone = all_rows.filter("doc_id is null or print is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return rows.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SPARK = {"op8_minhash": op8_minhash}
SQL = {
    "op8_minhash": """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS g
  FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
r(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON r.root = e.a),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.id = d.doc_id"""
}
