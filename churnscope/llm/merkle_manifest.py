"""Merkle manifest of a dataset, with proofs (operator 11).

Each row is a leaf; leaves of a source, by id, form a tree of ARITY, and the sources' subroots, by source, form the tree above.

Nodes carry the interval [lo, hi) of leaf ranks that they cover.  Ranks come from a range partitioning by (source, id): a row's
place in its partition plus the counts of the partitions before it, so a source with a third of all rows is spread like the rest.

Trees are built in tiers of TIER levels.  A tier's nodes are put into buckets by the interval of the ancestor TIER levels
above (lo div ARITY ** level); a bucket has at most ARITY ** TIER nodes, whatever the size of the source, builds its levels in one task
and passes one node on.  Small trees, that end within a tier, share buckets.  Downwards a tier's buckets are
joined with the ancestors whose intervals contain theirs.  A node's siblings are the nodes in the difference of its parent's interval and its own;
what lies left and right of it, level by level, is its proof, followed by its ancestor's proof.

Digests are lowercase hex SHA-256 of the concatenated inputs.  A leaf's inputs are its columns, each as byte count, ``:``, value, or ``-`` for null.

Cases: null ids come first in their source, then rows that repeat an id, by digest; every row is a leaf.  A null source is a source of its own, first of
all, and differs from an empty one.  Null, empty and long texts are values like others.  A lone leaf is its subroot, a lone subroot the root.
An empty table has no rows and no root.  Other columns don't matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

ARITY, TIER = 3, 6
WIDE = ARITY**TIER
#: The columns of a leaf, in order.
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest_of(columns: list[Column]) -> Column:
    """H of the columns' values."""
    parts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]).cast("binary"), 256)


def _hash(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _height(nodes: int) -> int:
    """Levels above ``nodes`` nodes up to the one that is left."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // ARITY), levels + 1
    return levels


def _levels(lo: np.ndarray, digests: list[str], base: int, n: int) -> list[tuple[np.ndarray, np.ndarray, list[str]]]:
    """(lo, hi, digests) of a bucket's nodes, level by level, from level ``base`` of a tree with n leaves up to the bucket's one node."""
    width = ARITY**base
    out = [(lo, np.minimum(lo + width, n), digests)]
    for _ in range(min(TIER, _height(-(-n // width)))):
        low, high, own = out[-1]
        width *= ARITY
        first = np.flatnonzero(np.diff(low // width, prepend=-1))
        stops = np.append(first[1:], len(low))
        out.append((low[first], high[stops - 1], [_hash(own[i:j]) for i, j in zip(first.tolist(), stops.tolist())]))
    return out


def _proofs(levels: list[tuple[np.ndarray, np.ndarray, list[str]]], above: list[str]) -> list[list[str]]:
    """What lies left and right of each node of the lowest level, level by level, and then the bucket's own proof."""
    paths = [above]
    for (low, high, digests), (up_low, up_high, _) in zip(levels[-2::-1], levels[:0:-1]):
        parent = np.searchsorted(up_low, low, side="right") - 1  # the one whose interval contains the node's
        begin, end = np.searchsorted(low, up_low[parent]), np.searchsorted(low, up_high[parent])
        at, after = np.searchsorted(low, low), np.searchsorted(low, high)
        paths = [["".join(digests[a:b]), "".join(digests[c:d])] + paths[p] for a, b, c, d, p in zip(begin.tolist(), at.tolist(), after.tolist(), end.tolist(), parent.tolist())]
    return paths


def fold(digest: str, path: list[str]) -> str:
    """The root that a leaf's digest and its proof give."""
    for left, right in zip(path[::2], path[1::2]):
        digest = _hash([left, digest, right])
    return digest


def _numbered(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows with their rank ``lo`` in their tree by the columns ``by``, the tree's number of leaves ``n``, and ``window``, the place of its first leaf."""
    spark = rows.sparkSession
    ordered = rows.withColumn("row", F.monotonically_increasing_id())
    ordered = ordered.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "tree", *by, "row").sortWithinPartitions("tree", *by, "row").drop("row")

    def number(batches):
        from pyspark import TaskContext

        seen, tree, begin = 0, None, 0
        for batch in batches:
            trees = batch.column("tree").to_numpy(zero_copy_only=False)
            if not len(trees):
                continue
            at = np.arange(seen, seen + len(trees))
            new = np.r_[trees[0] != tree, trees[1:] != trees[:-1]]
            first = np.maximum.accumulate(np.where(new, at, begin))
            seen, tree, begin = seen + len(trees), trees[-1], first[-1]
            part = pa.array(np.full(len(trees), TaskContext.get().partitionId(), np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, part, pa.array(first), pa.array(at - first)], names=[*batch.schema.names, "part", "first", "at"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    placed = materialise(ordered.mapInArrow(number, fields + ", part long, first long, at long"), "placed")
    whole = Window.partitionBy("tree")  # a row for each partition that holds leaves of the tree
    counts = placed.groupBy("tree", "part").agg(F.count("*").alias("own"), F.min("first").alias("first"))
    counts = counts.select("tree", "part", (F.sum("own").over(whole.orderBy("part")) - F.col("own")).alias("before"), F.sum("own").over(whole).alias("n"),
                           F.min(F.struct("part", "first")).over(whole).alias("begin"))
    found = placed.drop("first").join(counts, ["tree", "part"])
    window = F.shiftleft(F.col("begin.part"), 40) + F.floor(F.col("begin.first") / WIDE)
    return found.select(*rows.columns, (F.col("before") + F.col("at")).alias("lo"), "n", window.alias("window"))


def _bucketed(nodes: DataFrame, level: int) -> DataFrame:
    """Nodes with their bucket: the interval of the ancestor on ``level``; trees that end there share buckets."""
    small = (F.col("n") <= WIDE) if level == TIER else F.lit(False)
    own = F.floor(F.col("lo") / ARITY**level)
    return nodes.withColumns({"cell": F.when(small, F.lit("")).otherwise(F.col("tree")), "bucket": F.when(small, F.col("window")).otherwise(own).cast("long")})


def _up(base: int):
    """Buckets of nodes of level ``base`` to the one node of each tree in them."""

    def up(pdf):
        out = []
        for tree, own in pdf.groupby("tree", sort=False):
            own, n = own.sort_values("lo"), int(own["n"].iloc[0])
            low, high, digests = _levels(own["lo"].to_numpy(), own["digest"].tolist(), base, n)[-1]
            out.append([tree, int(low[0]), n, 0, digests[0], bool(high[0] - low[0] == n)])
        return pd.DataFrame(out, columns=["tree", "lo", "n", "window", "digest", "done"])

    return up


def _build(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Of leaves (tree, lo, n, window, digest): the nodes of each tier, in buckets, and the roots (tree, digest, n)."""
    tiers, roots, base = [], [], 0
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        here = _bucketed(nodes, base + TIER)
        tiers.append(here)
        made = here.select("cell", "bucket", "tree", "lo", "n", "digest").groupBy("cell", "bucket")
        made = materialise(made.applyInPandas(_up(base), "tree string, lo long, n long, window long, digest string, done boolean"), "tier")
        roots.append(made.filter("done").select("tree", "digest", "n"))
        nodes, base = made.filter("not done").drop("done"), base + TIER
        if most <= ARITY**base:
            break
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    return tiers, found


def _down(base: int, finish):
    """Buckets of nodes of level ``base``, with the proofs of the nodes that they end in, to what ``finish`` makes of each tree in them."""

    def down(own, up):
        own, out = own.sort_values(["tree", "lo"]), []
        above = {tree: row for tree, *row in up[["tree", "path", "subroot", "root"]].itertuples(index=False)}
        for tree, part in own.groupby("tree", sort=False):
            path, subroot, root = above[tree]
            levels = _levels(part["lo"].to_numpy(), part["digest"].tolist(), base, int(part["n"].iloc[0]))
            out.append(finish(part, _proofs(levels, list(path)), subroot, root))
        return pd.concat(out)

    return down


def _to_node(part, proofs, subroot, root):
    return pd.DataFrame({"tree": part["tree"], "lo": part["lo"], "n": part["n"], "path": proofs, "subroot": subroot, "root": root, "window": 0})


def _attach(tiers: list[DataFrame], above: DataFrame, finish, schema: str) -> DataFrame:
    """Proofs from the top down.  above: (tree, n, window, path, subroot, root) of each tree's root; ``finish`` makes the rows of the lowest
    tier from a bucket's nodes of a tree, their proofs, the subroot and the root."""
    below = None
    for t in reversed(range(len(tiers))):
        base, ends = t * TIER, (t + 1) * TIER
        # trees whose root is this tier's last node; the others' buckets have their proofs from the tier above
        closed = (F.col("n") <= ARITY**ends) & ((F.col("n") > ARITY**base) if t else F.lit(True))
        tops = above.filter(closed).select("tree", F.lit(0).cast("long").alias("lo"), "n", "path", "subroot", "root", "window")
        parents = tops if below is None else tops.unionByName(below)
        left = tiers[t].groupBy("cell", "bucket")
        right = _bucketed(parents, ends).select(F.col("cell").alias("up_cell"), F.col("bucket").alias("up_bucket"), "tree", "path", "subroot", "root").groupBy("up_cell", "up_bucket")
        kind = schema if t == 0 else "tree string, lo long, n long, path array<string>, subroot string, root string, window long"
        below = left.cogroup(right).applyInPandas(_down(base, finish if t == 0 else _to_node), kind)
    return below


def manifest(docs: DataFrame, tampered: Column | None = None, with_proofs: bool = False) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row; on request also source, lo, n and ``proof``.

    proof: what lies left and right of the leaf, level by level.  ``tampered`` is the text that is verified instead of the row's
    own where it isn't null; folded_root is what it gives with the proof of the untampered leaf.
    """
    given = [F.col(c) for c in COLUMNS]
    # a null source first, others by their bytes
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    other = F.when(tampered.isNotNull(), digest_of([*given[:-1], tampered])) if tampered is not None else F.lit(None).cast("string")
    leaves = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), digest_of(given).alias("digest"), other.alias("other"))
    leaves = materialise(_numbered(leaves, ["doc_id", "digest"]), "leaves")
    tiers, subroots = _build(leaves)
    sources = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("n").alias("leaves"), "digest")
    sources = materialise(_numbered(sources, ["of"]), "sources")
    source_tiers, root = _build(sources)

    def to_source(part, proofs, subroot, root):
        return pd.DataFrame({"tree": part["of"], "n": part["leaves"], "path": proofs, "subroot": part["digest"], "root": root})

    top = root.select("tree", "n", F.array().cast("array<string>").alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root")).join(sources.select("tree", "window").distinct(), "tree")
    above = _attach(source_tiers, materialise(top, "top"), to_source, "tree string, n long, path array<string>, subroot string, root string")
    above = materialise(above.join(leaves.select("tree", "window").distinct(), "tree"), "subroots")

    more = ", source string, lo long, n long, proof array<string>" * with_proofs

    def to_leaf(part, proofs, subroot, root):
        folded = [fold(d if o is None else o, p) for d, o, p in zip(part["digest"], part["other"], proofs)]
        out = pd.DataFrame({"doc_id": part["doc_id"].astype("string").astype("Int64"), "leaf": part["digest"], "subroot": subroot, "root": root, "proof_sha256": [_hash(p) for p in proofs], "folded_root": folded, "verified": [x == root for x in folded]})
        return out.assign(source=part["tree"].str[1:].where(part["tree"].str[0] == "s", None), lo=part["lo"], n=part["n"], proof=proofs) if with_proofs else out

    tiers[0] = tiers[0].withColumn("doc_id", F.col("doc_id").cast("string"))
    return _attach(tiers, above, to_leaf, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + more)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return manifest(table(spark, sf_dir, "documents"), F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))))


SPARK = {"op11_merkle_manifest": op11_merkle_manifest}
SQL = {
    "op11_merkle_manifest": """
WITH RECURSIVE d AS (
  SELECT *, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_transform(range(0, 8), lambda i: (ascii(c)::BIGINT >> i) & 1)))),
    lambda c, b: xor(c >> 1, CASE WHEN xor(c & 1, b) = 1 THEN 3988292384 ELSE 0 END)) AS crc FROM documents),
v AS (
  SELECT doc_id, source, text, crc,
    list_aggregate(list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR], lambda x: CASE WHEN x IS NULL THEN '-' ELSE strlen(x) || ':' || x END), 'string_agg', '') AS head FROM d),
h AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 2 = 0 AND text IS NOT NULL THEN sha256(head || strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '')) END AS other FROM v),
l AS (SELECT *, coalesce('s' || source, 'n') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k FROM h),
n(tree, level, k, d, more) AS (
  SELECT tree, 0, k, leaf, count(*) OVER (PARTITION BY tree) > 1 FROM l
  UNION ALL
  SELECT tree, level + 1, p, d, count(*) OVER (PARTITION BY tree) > 1
  FROM (SELECT tree, level, k // 3 AS p, sha256(string_agg(d, '' ORDER BY k)) AS d FROM n WHERE more GROUP BY ALL)),
t(level, k, d, more, tree) AS (
  SELECT 0, row_number() OVER (ORDER BY encode(tree)) - 1, d, count(*) OVER () > 1, tree FROM n WHERE NOT more
  UNION ALL
  SELECT level + 1, p, d, count(*) OVER () > 1, NULL
  FROM (SELECT level, k // 3 AS p, sha256(string_agg(d, '' ORDER BY k)) AS d FROM t WHERE more GROUP BY ALL)),
b AS (SELECT tree, max(level) AS top FROM n GROUP BY 1),
a AS (SELECT n.tree, level, k, d, more FROM n UNION ALL SELECT NULL, level, k, d, more FROM t),
s AS (
  SELECT x.tree, x.level, x.k, coalesce(string_agg(y.d, '' ORDER BY y.k) FILTER (y.k < x.k), '') AS lft, coalesce(string_agg(y.d, '' ORDER BY y.k) FILTER (y.k > x.k), '') AS rgt
  FROM a x LEFT JOIN a y ON x.tree IS NOT DISTINCT FROM y.tree AND x.level = y.level AND x.k // 3 = y.k // 3 AND x.k <> y.k WHERE x.more GROUP BY ALL),
f(id, tree, level, k, d, proof) AS (
  SELECT tree || '/' || k, tree, 0, k, coalesce(other, leaf), '' FROM l
  UNION ALL
  SELECT id, tree, level + 1, k // 3, sha256(lft || d || rgt), proof || lft || rgt FROM f JOIN s USING (tree, level, k)),
g(id, level, k, d, proof) AS (
  SELECT f.id, 0, t.k, f.d, f.proof FROM f JOIN b ON f.tree = b.tree AND f.level = b.top JOIN t ON t.tree = f.tree
  UNION ALL
  SELECT g.id, g.level + 1, g.k // 3, sha256(lft || d || rgt), proof || lft || rgt FROM g JOIN s ON s.tree IS NULL AND s.level = g.level AND s.k = g.k)
SELECT l.doc_id, l.leaf, sr.d AS subroot, r.d AS root, sha256(g.proof) AS proof_sha256, g.d AS folded_root, g.d = r.d AS verified
FROM l JOIN (SELECT tree, d FROM n WHERE NOT more) sr ON sr.tree = l.tree CROSS JOIN (SELECT d, level FROM t WHERE NOT more) r JOIN g ON g.id = l.tree || '/' || l.k AND g.level = r.level"""
}
