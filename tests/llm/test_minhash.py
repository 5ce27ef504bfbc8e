"""Near duplicates against all pairs, components against a union-find, and the sketch's properties."""

import numpy as np

from churnscope.llm import minhash as M
from churnscope.llm.components import connected_components

SCHEMA = "doc_id long, text string, kept string, n_shingles string, component_id string"


def shingles(text, words):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}


def roots(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute(rows, words, percent):
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            sets[i] = shingles(t, words)
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), r, r == i) for i, r in roots(sets, links).items()}


def near_copies(rng, base, n, edits):
    for _ in range(n):
        w = list(base)
        for _ in range(rng.integers(0, edits + 1)):
            w[rng.integers(len(w))] = f"x{rng.integers(10**6)}"
        yield " ".join(w)


def make(rng):
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(12):  # groups with links both sides of the threshold, and chains
        base = rng.choice(vocab, rng.integers(20, 150))
        rows += near_copies(rng, base, rng.integers(2, 15), 8)
    passage = list(rng.choice(vocab, 60))
    rows += [" ".join(passage + list(rng.choice(vocab, rng.integers(5, 60)))) for _ in range(40)]
    rows += near_copies(rng, rng.choice(vocab, 100), 80, 6)  # a large group
    rows += ["Exact  copy of a text here"] * 30 + ["exact copy OF a\ntext here", "É é", "é é", "short", "short", None, "", " \t ", "a b c", "a b c d"]
    rows += ["long " + " ".join(rng.choice(vocab, 20_000))]
    order = rng.permutation(len(rows))
    return [(int(order[k]) + 2**55, t, "k", "n", "c") for k, t in enumerate(rows)]


def test_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(M, "SMALL", 3)  # so that larger buckets, in several blocks, occur
    monkeypatch.setattr(M, "SIDE", 7)
    rows = make(np.random.default_rng(5))
    for words in (4, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(spark.createDataFrame(rows, SCHEMA), words).collect()}
        assert got == brute(rows, words, 80)


def test_odd_rows(spark):
    rows = [(1, "one two three four five", "", "", ""), (1, "one two three four five", "", "", ""), (None, "one two three four five", "", "", ""), (2, "One two three four five", "", "", ""), (3, None, "", "", "")]
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert got == [(0, 2, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]
    assert M.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_texts_that_share_an_id_are_told_apart(spark):
    rng = np.random.default_rng(8)
    one, two = ([f"{x}{i}" for i in rng.integers(0, 10**6, 60)] for x in "ab")
    near = lambda ws: " ".join(ws[:-1] + ["other"])
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, near(one)), (3, near(two)), (4, near(two) + " more")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 57, 1), (1, 57, 1), (2, 57, 1), (3, 57, 1), (4, 58, 1)]


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(0)
    size = 240
    one = rng.integers(0, 2**63, 1, dtype=np.uint64)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    errors = []
    for k in range(60):
        b = np.concatenate([a[: 100 + 5 * k], rng.integers(0, 2**63, 50, dtype=np.uint64)])
        s = M.sketches([a, b, one], size)
        assert (s != M.EMPTY).all()
        errors.append((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 600)] + [(700, 700)]
    want = roots({x for ab in links[:-1] for x in ab if ab[0] != ab[1]}, [ab for ab in links if ab[0] != ab[1]])
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_group_just_below_the_similarity_gives_few_rows(spark, monkeypatch):
    """Texts that mostly meet in the same buckets without being similar enough: only joining links leave the tasks."""
    monkeypatch.setattr(M, "SIDE", 20)
    made = []
    keep = M._joining
    monkeypatch.setattr(M, "_joining", lambda *a: made.append(keep(*a)) or made[-1])
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(300)]
    rows = [(k, t) for k, t in enumerate(near_copies(rng, base, 150, 14))]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 4, 80)
    assert made[0].distinct().count() < 150 * 149 / 20


def test_blocks_by_shingles(spark, monkeypatch):
    monkeypatch.setattr(M, "SMALL", 3)
    monkeypatch.setattr(M, "ELEMENTS", 500)
    rows = make(np.random.default_rng(9))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows, 4, 80)
