"""Near-duplicate embeddings by a robust-pruned flat graph (operator 3).

Vectors are linked when they have the same label and a cosine of at least ``threshold``.

1. Copies of a vector (same label, same components) are one node with a count.
2. Each label's nodes are cut into cells of at most CELL, level by level: a k-means of at most FAN centres, fitted on
   a bounded sample of the cell (PER_CENTRE rows for each centre, documented parameter), assigns all its nodes.  A node is at home
   with its nearest centre, a member of the second nearest cell too (so the shards overlap), and a visitor of all
   other cells whose centre is at most ``margin`` radians farther than the nearest one.
3. Each cell builds a graph on its home nodes and members: every node's POOL nearest are pruned robustly (a candidate goes
   when a kept neighbour is ALPHA times closer to it than the node itself), at most DEGREE stay, and links run both ways.
4. The adjacency lists that a node got in different cells are united.
5. Every node searches the cells where it is at home, member or visitor: a greedy search starts from the medoids of the
   cell's connected parts (and from the node itself), widens along the BEAM best nodes, and once it has met
   nodes in range goes on through all nodes in range.
6. Links are verified in double precision.  A neighbour counts only in its home cell, hence once.  A task returns for each node
   the number of its links and the smallest node that it is connected with inside the task, so no list of links is ever
   made; components join these by large-star and small-star steps.
7. The recall is audited: AUDIT nodes, chosen by a hash, are compared with all nodes.  Below ``least_recall``, the margin grows by
   half and steps 2 to 6 run again.

Cells are bounded and so are the blocks of nodes that search one, however large a label or a group of near copies is.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label or id, link with nothing
(0 links; the component is the row's own id, null without one; kept); vectors of different sizes don't link;
rows that repeat an id with equal label and vector count as one vector and share its result; a null embedding column
or an empty table gives no links or rows; other columns don't matter.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table
from .components import connected_components

THRESHOLD = 0.93
CELL, FAN, PER_CENTRE = 600, 32, 32
POOL, DEGREE, ALPHA, BEAM, WIDTH = 48, 20, 1.2, 20, 5
#: Nodes that one task assigns, and that one task searches with.
CHUNK, QUERIES = 20_000, 4_000
MARGIN, LEAST_RECALL, AUDIT, WITH_LINKS = 0.12, 0.97, 256, 64
HOME, MEMBER, VISITOR = 0, 1, 2
ROWS = "cell string, node long, role int, x array<double>"


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square over- or underflows
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def spread(keys: np.ndarray, n: int) -> np.ndarray:
    """A number below n for each key."""
    h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centres of unit vectors."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = (x @ centres.T).argmax(1)
        for j in range(k):
            own = x[near == j]
            if len(own) and (length := np.linalg.norm(total := own.sum(0))) > 0:
                centres[j] = total / length
    return centres


def places(x: np.ndarray, node: np.ndarray, role: np.ndarray, centres: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, centre, role) of every cell that rows go to.  Equal centres share their nodes by a hash."""
    angle = np.arccos(np.clip(x @ centres.T, -1, 1))
    tie = (spread(node, 1 << 20)[:, None] + np.arange(len(centres)) * 7919) % 104729
    order = np.lexsort((tie, np.round(angle, 9)), axis=1)
    goes = angle <= angle.min(1, keepdims=True) + margin
    kind = np.full(angle.shape, VISITOR)
    rows = np.arange(len(x))
    stays = role != VISITOR
    if len(centres) > 1:
        second = stays & (role == HOME)
        goes[rows[second], order[second, 1]] = True
        kind[rows[second], order[second, 1]] = MEMBER
    goes[rows, order[:, 0]] = True
    kind[rows[stays], order[stays, 0]] = role[stays]
    i, j = np.nonzero(goes)
    return i, j, kind[i, j]


def build_graph(x: np.ndarray) -> list[np.ndarray]:
    """Neighbours of each unit vector: robustly pruned, links both ways."""
    n = len(x)
    if n < 2:
        return [np.empty(0, np.int64)] * n
    pool = min(POOL, n - 1)
    source, target = [], []
    for at in range(0, n, 256):
        own = np.arange(at, min(n, at + 256))
        sim = x[own] @ x.T
        sim[np.arange(len(own)), own] = -np.inf
        cand = np.argpartition(-sim, pool - 1, axis=1)[:, :pool]
        cand = np.take_along_axis(cand, np.argsort(-np.take_along_axis(sim, cand, 1), axis=1, kind="stable"), 1)
        to_node = 2 - 2 * np.take_along_axis(sim, cand, 1)
        each = x[cand]
        between = 2 - 2 * np.einsum("bcd,bed->bce", each, each, optimize=True)
        alive = np.ones(cand.shape, bool)
        rows = np.arange(len(own))
        for _ in range(min(DEGREE, pool)):
            pick = alive.argmax(1)
            some = alive[rows, pick]
            if not some.any():
                break
            source.append(own[some])
            target.append(cand[rows[some], pick[some]])
            alive &= ALPHA**2 * between[rows, pick] > to_node
            alive[rows, pick] = False
    source, target = np.concatenate(source), np.concatenate(target)
    return _lists(np.concatenate([source, target]), np.concatenate([target, source]), n)


def _lists(source: np.ndarray, target: np.ndarray, n: int) -> list[np.ndarray]:
    both = np.unique(source * n + target)
    source, target = both // n, both % n
    return np.split(target, np.searchsorted(source, np.arange(1, n)))


def _parts(source: np.ndarray, target: np.ndarray, n: int) -> np.ndarray:
    """The smallest row that each row is connected with."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, source, low[target])
        np.minimum.at(new, target, low[source])
        new = np.minimum(new, new[new])
        if (new == low).all():
            return low
        low = new


def search(x: np.ndarray, lists: list[np.ndarray], queries: np.ndarray, own: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs in range, by range-expanding greedy search.

    x: unit vectors of the graph's rows; own: each query's own row, or -1.  Pairs are verified in double.
    """
    n, empty = len(x), np.empty(0, np.int64)
    if not n or not len(queries):
        return empty, empty
    degree = np.fromiter(map(len, lists), np.int64, n)
    flat, start = np.concatenate([*lists, empty]).astype(np.int64), np.cumsum(degree) - degree
    part = _parts(np.repeat(np.arange(n), degree), flat, n)
    _, part = np.unique(part, return_inverse=True)
    mean = np.zeros((part.max() + 1, x.shape[1]))
    np.add.at(mean, part, x)
    closeness = np.einsum("ij,ij->i", x, mean[part])
    by = np.lexsort((-closeness, part))
    medoids = by[np.r_[True, part[by][1:] != part[by][:-1]]]
    x32, q32 = x.astype(np.float32), queries.astype(np.float32)
    slack = threshold - 1e-5
    hits = []
    for at in range(0, len(queries), 512):
        q = q32[at : at + 512]
        sim = np.full((len(q), n), -np.inf, np.float32)
        open_ = np.zeros(sim.shape, bool)

        def visit(i, j):
            new = np.unique(i[np.isneginf(sim[i, j])] * n + j[np.isneginf(sim[i, j])])  # noqa: B023
            i, j = new // n, new % n
            for s in range(0, len(i), 200_000):
                a, b = i[s : s + 200_000], j[s : s + 200_000]
                sim[a, b] = np.einsum("ij,ij->i", q[a], x32[b])  # noqa: B023
            open_[i, j] = True  # noqa: B023

        def expand(i, j):
            open_[i, j] = False  # noqa: B023
            size = degree[j]
            inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            visit(np.repeat(i, size), flat[np.repeat(start[j], size) + inside])

        rows = np.arange(len(q))
        visit(np.repeat(rows, len(medoids)), np.tile(medoids, len(q)))
        mine = own[at : at + 512]
        visit(rows[mine >= 0], mine[mine >= 0])
        active = rows
        beam = min(BEAM, n)
        while len(active):
            best = np.argpartition(-sim[active], beam - 1, axis=1)[:, :beam]
            todo = open_[active[:, None], best]
            score = np.where(todo, np.take_along_axis(sim[active], best, 1), -np.inf)
            pick = np.argsort(-score, axis=1)[:, :WIDTH]
            i, k = np.nonzero(np.take_along_axis(todo, pick, 1))
            expand(active[i], best[i, pick[i, k]])
            active = active[todo.any(1)]
        while True:  # through all nodes in range
            i, j = np.nonzero(open_ & (sim >= slack))
            if not len(i):
                break
            expand(i, j)
        i, j = np.nonzero(sim >= slack)
        keep = j != mine[i]
        i, j = i[keep] + at, j[keep]
        sure = np.concatenate([np.einsum("ij,ij->i", queries[i[s : s + 100_000]], x[j[s : s + 100_000]]) >= threshold for s in range(0, len(i), 100_000)] or [np.empty(0, bool)])
        hits.append((i[sure], j[sure]))
    return np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])


def _cells(nodes: DataFrame, margin: float) -> DataFrame:
    """Rows (cell, node, role, x): every node in the cells where it is at home, member or visitor."""
    rows = nodes.select(F.col("class").alias("cell"), "node", F.lit(HOME).alias("role"), "x")
    while True:
        sizes = rows.filter(F.col("role") != VISITOR).groupBy("cell").agg(F.count_if(F.col("role") == HOME).alias("n"), F.count("*").alias("all"))
        large = materialise(sizes.filter(F.col("n") > CELL).withColumn("k", F.least(F.lit(FAN), F.ceil(F.col("n") / (CELL / 2))).cast("int")), "large-cells")
        if large.isEmpty():
            return rows

        def centres(pdf):
            pdf = pdf.sort_values("node")
            found = k_means(_unit(np.stack(pdf["x"].to_numpy())), int(pdf["k"].iloc[0]))
            return pd.DataFrame({"cell": pdf["cell"].iloc[:1], "centres": [found.ravel()]})

        def assign(key, left, right):
            if not len(left) or not len(right):
                return pd.DataFrame({"cell": [], "node": [], "role": [], "x": []})
            x = np.stack(left["x"].to_numpy())
            i, j, role = places(_unit(x), left["node"].to_numpy(), left["role"].to_numpy(), right["centres"].iloc[0].reshape(-1, x.shape[1]), margin)
            return pd.DataFrame({"cell": [f"{key[0]}.{k}" for k in j], "node": left["node"].to_numpy()[i], "role": role, "x": list(x[i])})

        place = F.pmod(F.xxhash64("node", F.lit(31)), F.lit(1 << 30))
        drawn = rows.filter(F.col("role") == HOME).join(large, "cell").filter(place < F.least(F.lit(1.0), F.col("k") * PER_CENTRE / F.col("n")) * (1 << 30))
        means = materialise(drawn.select("cell", "node", "k", "x").groupBy("cell").applyInPandas(centres, "cell string, centres array<double>"), "centres")
        chunks = rows.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))  # visitors too
        known = materialise(means.join(chunks, "cell"), "cell-chunks")
        inside = rows.join(known.select("cell", "chunks"), "cell").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(32)), F.col("chunks")).cast("int")).drop("chunks")
        copies = known.select(F.col("cell").alias("of"), F.col("centres").alias("centres"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("part"))
        split = inside.groupBy("cell", "chunk").cogroup(copies.groupBy("of", "part")).applyInPandas(assign, ROWS)
        rows = materialise(rows.join(known.select("cell"), "cell", "left_anti").unionByName(split), "cells")


def _search_cells(rows: DataFrame, counts: DataFrame, threshold: float) -> DataFrame:
    """(node, n, low): links found by each node in a cell, and the smallest node it is connected with there."""

    def build(pdf):
        lists = build_graph(_unit(np.stack(pdf["x"].to_numpy())))
        node = pdf["node"].to_numpy()
        return pd.DataFrame({"node": node, "near": [node[k] for k in lists]})

    inside = rows.filter(F.col("role") != VISITOR)
    graph = inside.groupBy("cell").applyInPandas(build, "node long, near array<long>")
    united = graph.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    base = inside.join(united, "node").join(counts, "node").select("cell", "node", "role", "x", "near", "times")
    blocks = rows.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
    base = base.join(blocks, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    asking = rows.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("node", F.lit(33)), F.col("blocks")).cast("int")).select(F.col("cell").alias("of"), F.col("block").alias("part"), F.col("node").alias("asks"), F.col("x").alias("y"))

    def meet(left, right):
        if not len(left) or not len(right):
            return pd.DataFrame({"node": [], "n": [], "low": []}).astype("int64")
        left = left.sort_values("node")
        node, asks = left["node"].to_numpy(), right["asks"].to_numpy()
        lists = []
        for near in left["near"]:
            at = np.minimum(np.searchsorted(node, near), len(node) - 1)
            lists.append(at[node[at] == near])
        own = np.minimum(np.searchsorted(node, asks), len(node) - 1)
        own = np.where(node[own] == asks, own, -1)
        i, j = search(_unit(np.stack(left["x"].to_numpy())), lists, _unit(np.stack(right["y"].to_numpy())), own, threshold)
        weight = np.where(left["role"].to_numpy() == HOME, left["times"].to_numpy(), 0)
        found = np.bincount(i, weight[j], len(asks)).astype(np.int64)
        # rows of the graph first, then the queries
        everyone = np.concatenate([node, asks])
        low = _parts(np.concatenate([i + len(node), np.flatnonzero(own >= 0) + len(node)]), np.concatenate([j, own[own >= 0]]), len(everyone))
        least = np.full(len(everyone), np.iinfo(np.int64).max)
        np.minimum.at(least, low, everyone)
        out = pd.DataFrame({"node": np.concatenate([asks, node]), "n": np.concatenate([found, np.zeros(len(node), np.int64)]), "low": least[np.concatenate([low[len(node) :], low[: len(node)]])]})
        return out[(out["n"] > 0) | (out["low"] != out["node"])]

    return base.groupBy("cell", "block").cogroup(asking.groupBy("of", "part")).applyInPandas(meet, "node long, n long, low long")


def audit_recall(nodes: DataFrame, found: DataFrame, threshold: float, audit: int = AUDIT) -> float:
    """Mean over nodes of the share of their links, found by brute force against all nodes, that ``found`` (node, n) has.

    A node with few links counts like one in a group of copies.  About ``audit`` nodes are drawn, and four times as many
    up to three times if fewer than WITH_LINKS of them have a link; 1.0 if none has any.
    """
    total = nodes.count()
    place = F.pmod(F.xxhash64("node", F.lit(34)), F.lit(1 << 30))
    for _ in range(4):
        asked = nodes.filter(place < min(1.0, audit / max(1, total)) * (1 << 30)).select("node", "class", "x").toPandas()  # about ``audit`` rows
        if not len(asked):
            return 1.0
        groups = {c: (g["node"].to_numpy(), _unit(np.stack(g["x"].to_numpy()))) for c, g in asked.groupby("class")}

        def count(batches, groups=groups):
            for pdf in batches:
                for c, part in pdf.groupby("class"):
                    if c in groups:
                        ids, q = groups[c]
                        near = (q @ _unit(np.stack(part["x"].to_numpy())).T >= threshold) & (ids[:, None] != part["node"].to_numpy()[None, :])
                        yield pd.DataFrame({"node": ids, "n": (near * part["times"].to_numpy()).sum(1)})

        truth = nodes.mapInPandas(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("truth")).filter("truth > 0")
        share = F.least(F.coalesce("n", F.lit(0)), F.col("truth")) / F.col("truth")
        got = truth.join(found, "node", "left").agg(F.avg(share).alias("recall"), F.count("*").alias("n")).first()
        if got["n"] >= WITH_LINKS or audit >= total:
            break
        audit *= 4
    return got["recall"] if got["n"] else 1.0


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN, least_recall: float = LEAST_RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("string").alias("label"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    good = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine, F.lit(False))
    # equal vectors have equal text; grouping by text keeps large arrays out of the shuffle's keys
    rows = rows.withColumns({"good": good, "class": F.concat_ws("/", F.size("x"), "label"), "print": F.when(good, F.md5(F.concat_ws("/", F.size("x"), "label", F.array_join(F.transform("x", lambda v: (v + 0.0).cast("string")), " "))))})
    usable = rows.filter("good")
    ids = usable.groupBy("print", "vec_id").agg(F.first("class").alias("class"), F.first("x").alias("x"))
    nodes = materialise(ids.groupBy("print").agg(F.min("vec_id").alias("node"), F.count("*").alias("times"), F.first("class").alias("class"), F.first("x").alias("x")), "vectors")
    counts = nodes.select("node", "times")
    while True:
        met = materialise(_search_cells(_cells(nodes.select("node", "class", "x"), margin), counts, threshold), "met")
        found = met.groupBy("node").agg(F.sum("n").alias("n"))
        recall = audit_recall(nodes, found, threshold)
        if recall >= least_recall:
            break
        if margin > math.pi:  # every cell has met every other
            raise ValueError(f"recall of {recall:.3f} in the audit is below {least_recall}")
        margin = margin * 1.5
    parts = connected_components(met.filter("low <> node").select(F.col("node").alias("a"), F.col("low").alias("b")))
    per_node = nodes.select("print", "node", "times").join(found, "node", "left").join(parts.withColumnRenamed("id", "node"), "node", "left")
    per_node = per_node.select("print", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    linked = usable.select("vec_id", "print").join(per_node, "print").select("vec_id", "n_links", "component_id")
    alone = rows.filter("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


SPARK = {"op3_embedding_dedup": op3_embedding_dedup}
SQL = {
    "op3_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
r(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, e.b FROM r JOIN e ON r.root = e.a),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id),
k AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, id = component_id AS kept FROM c LEFT JOIN k ON k.a = c.id"""
}
