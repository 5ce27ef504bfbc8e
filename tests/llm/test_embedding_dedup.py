"""Embedding links against brute force, over several levels of cells, and the graph's parts."""

import numpy as np

from churnscope.llm import embedding_dedup as D

SCHEMA = "vec_id long, embedding array<float>, label int, node string, kept string"


def brute(rows, threshold):
    good = {}
    for i, v, label, *_ in rows:
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = (label, np.array(v, np.float32).astype(float))
    ids = sorted(good)
    up = {i: i for i in [r[0] for r in rows if r[0] is not None]}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    n = dict.fromkeys(up, 0)
    for a in ids:
        for b in ids:
            (la, va), (lb, vb) = good[a], good[b]
            if a < b and la == lb and len(va) == len(vb) and va @ vb / np.linalg.norm(va) / np.linalg.norm(vb) >= threshold:
                n[a], n[b] = n[a] + 1, n[b] + 1
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (n[i], find(i)) for i in up}


def make(rng, n, groups, hot):
    out = [(rng.normal(size=16), int(rng.integers(3))) for _ in range(n)]
    for k in range(groups):
        base, label = rng.normal(size=16), int(rng.integers(3))
        out += [(base + rng.normal(size=16) * 0.05 * (1 + k % 3), label) for _ in range(rng.integers(2, 9))]
    base = rng.normal(size=16)
    out += [(base + rng.normal(size=16) * 0.08, 1) for _ in range(hot)]
    out += [(base, 1)] * 9 + [(2 * base, 1)] * 5 + [(base, 2)]
    order = rng.permutation(len(out))
    return [(int(order[k]), v.astype(np.float32).tolist(), label, "", "") for k, (v, label) in enumerate(out)]


def test_links_and_components(spark, monkeypatch):
    monkeypatch.setattr(D, "CELL", 60)
    monkeypatch.setattr(D, "FAN", 4)
    monkeypatch.setattr(D, "CHUNK", 100)
    monkeypatch.setattr(D, "QUERIES", 50)
    rows = make(np.random.default_rng(4), 350, 20, 130)
    rows += [(5000, None, 1, "", ""), (5001, [], 1, "", ""), (5002, [0.0] * 16, 1, "", ""), (5003, [float("nan")] * 16, 1, "", ""), (5004, [1.0] * 15 + [None], 1, "", "")]
    rows += [(5005, [1.0] * 16, None, "", ""), (5006, [1.0] * 16, None, "", ""), (None, rows[0][1], rows[0][2], "", ""), (5007, [1.0] * 8, 1, "", ""), (5008, [1e-38] * 16, 7, "", ""), (5009, [3e38] * 16, 7, "", "")]
    rows += [rows[3]]
    got = D.near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA), least_recall=0.999).collect()
    want = brute(rows, 0.93)
    assert len(got) == len(rows)
    links = sum(n for n, _ in want.values())
    own = {r.vec_id: r for r in got if r.vec_id is not None}
    assert all(own[i].n_links <= n for i, (n, _) in want.items())  # none below the threshold
    assert sum(r.n_links for r in own.values()) >= 0.99 * links
    assert np.mean([own[i].component_id == c for i, (_, c) in want.items()]) > 0.99
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)]
    assert own[5008].n_links == own[5009].n_links == 1


def test_empty(spark):
    assert D.near_duplicate_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [r.n_links for r in D.near_duplicate_vectors(spark.createDataFrame([(1, None, 1, "", "")], SCHEMA)).collect()] == [0]


def test_graph_search_finds_what_is_in_range():
    rng = np.random.default_rng(9)
    x = D._unit(np.vstack([rng.normal(size=(400, 24)), rng.normal(size=24) + 0.05 * rng.normal(size=(150, 24))]))
    lists = D.build_graph(x)
    assert max(map(len, lists)) < len(x) / 2
    i, j = D.search(x, lists, x, np.full(len(x), -1), 0.93)
    found = set(zip(i.tolist(), j.tolist()))
    truth = set(zip(*(a.tolist() for a in np.nonzero(x @ x.T >= 0.93))))
    assert found <= truth and len(found) > 0.97 * len(truth)


def test_audit_counts_nodes_alike(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 16))
    rows = [(2 * i + k, "a", (base[i] + 0.02 * k * rng.normal(size=16)).tolist(), 1) for i in range(40) for k in range(2)]
    rows += [(1000 + i, "a", (np.ones(16) + 0.01 * rng.normal(size=16)).tolist(), 1) for i in range(60)]
    nodes = spark.createDataFrame(rows, "node long, class string, x array<double>, times int")
    whole = [(i, 1) for i in range(80)] + [(1000 + i, 59) for i in range(60)]
    recall = lambda found: D.audit_recall(nodes, spark.createDataFrame(found, "node long, n long"), 0.93)
    assert recall(whole) == 1.0
    # the large group's 3,540 links don't hide that the pairs are lost
    assert abs(recall(whole[80:]) - 60 / 140) < 0.01
    assert recall(whole[:80]) < 0.6


def test_recall_of_planted_pairs(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(1500, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.normal(size=base.shape)
    other -= (other * base).sum(1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    near = 0.94 * base + np.sqrt(1 - 0.94**2) * other
    docs = spark.createDataFrame([(i, x.tolist(), "k") for i, x in enumerate(np.concatenate([base, near]))], "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: r for r in D.near_duplicate_vectors(docs).collect()}
    both = np.concatenate([base, near])
    truth = ((both @ both.T) >= 0.93).sum(1) - 1
    assert sum(got[i].n_links for i in got) >= 0.97 * truth.sum() and all(got[i].n_links <= truth[i] for i in got)
