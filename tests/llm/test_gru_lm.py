"""Language model: gradients, probabilities that sum to one, carried state, counts by brute force, held-out gain."""

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from churnscope.llm import gru_lm as G

DIR = "/root/testdata/sf0.01"
TAIL = 90  # nine classes of ten words, the end token among them
SCHEMA = "doc_id long, text string, score string, n_tokens string, word string"


def weights(seed=0):
    rng = np.random.default_rng(seed)
    return {k: v.astype(np.float64) + rng.normal(0, 0.3, v.shape) for k, v in G.initial(np.ones(TAIL), 100.0).items()}


def test_gradients():
    rng = np.random.default_rng(1)
    w, steps, n = weights(), 6, 5
    tokens, target = rng.integers(0, TAIL + 1, (2, steps, n))
    target[0, 0] = TAIL
    keep, mask, h = (rng.random((steps, n)) > 0.2).astype(float), rng.random((steps, n)) > 0.2, rng.normal(size=(n, G.HIDDEN))
    scale = mask.sum() / max(mask.sum(), G.WINDOW * G.TRAIN_STREAMS // G.EVERY)

    def loss(w):
        states, _, _ = G.run_window(w, tokens, keep, h)
        return -scale * G.log_probabilities(w, states.reshape(-1, G.HIDDEN).astype(float), target.ravel())[mask.ravel()].mean()

    states, _, kept = G.run_window(w, tokens, keep, h, trace=True)
    value, grads = G.Trainer(w).gradients(states, kept, tokens, keep, target, mask)
    assert abs(value - loss(w)) < 1e-5
    ids, rows = grads["input"]
    checks = [(k, tuple(rng.integers(0, s) for s in w[k].shape), None) for k in ("class", "class_bias", "state", "bias") for _ in range(5)]
    checks = [(k, i, grads[k][i]) for k, i, _ in checks]
    checks += [("input", (ids[j], 3), rows[j, 3]) for j in range(5)]
    checks += [("word", (c, 5, 2), g[5, 2]) for c, g, _ in grads["word"][:5]] + [("word_bias", (c, 7), b[7]) for c, _, b in grads["word"][:5]]
    for name, at, got in checks:
        up, down = ({**w, name: w[name].copy()} for _ in range(2))
        up[name][at] += 1e-3
        down[name][at] -= 1e-3
        assert abs((loss(up) - loss(down)) / 2e-3 - got) < 1e-5 + 0.01 * abs(got)


def test_probabilities_sum_to_one():
    w, h = weights(3), np.random.default_rng(0).normal(size=(1, G.HIDDEN))
    every = np.arange(TAIL + 1)
    assert abs(np.exp(G.log_probabilities(w, np.repeat(h, len(every), 0), every)).sum() - 1) < 1e-6


def test_state_is_carried_over_windows_and_streams():
    rng = np.random.default_rng(5)
    w = {k: v.astype(np.float32) for k, v in weights(4).items()}
    docs = [rng.integers(1, TAIL + 1, n).astype(np.uint16) for n in (0, 1, 5, 31, 32, 33, 200, 1000, 3)]
    got = G.score_documents(w, docs)
    for doc, value in zip(docs, got):
        h, total = np.zeros((1, G.HIDDEN), np.float32), 0.0
        for source, target in zip([G.END, *doc], [*doc, G.END]):
            states, h, _ = G.run_window(w, np.array([[source]]), np.ones((1, 1), np.float32), h)
            total += G.log_probabilities(w, states[0], np.array([target]))[0]
        assert abs(total - value) < 1e-3 * max(1, abs(total))


def test_every_training_token_is_a_target_once(monkeypatch):
    rng = np.random.default_rng(6)
    docs = [rng.integers(1, TAIL + 1, n).astype(np.uint16) for n in rng.integers(0, 700, 40)]
    seen = Counter()

    def learn(self, states, kept, tokens, keep, target, mask):
        assert kept.shape[1:3] == tokens.shape == mask.shape
        seen.update(target[mask].tolist())

    monkeypatch.setattr(G.Trainer, "learn", learn)
    G.train_documents(G.Trainer(G.initial(np.ones(TAIL), 100.0)), docs)
    assert seen == Counter(np.concatenate(docs).tolist()) + Counter({G.END: len(docs)})


def brute(rows):
    split = [(i, (t or "").encode().lower().split()) for i, t in rows]
    learned = [ws for i, ws in split if i is not None and zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for ws in learned for w in ws)
    end = len(learned)
    n, v = sum(c.values()) + end, len(c) + (end > 0)
    log = lambda k: math.log10((k + 0.1) / (n + 0.1 * (v + 1)))
    return sorted(((-1 if i is None else i, len(ws) + 1, sum(c[w] > 0 for w in ws) + (end > 0), n, round(sum(log(c[w]) for w in ws) + log(end), 4)) for i, ws in split), key=repr)


def test_shortlist_grows_with_the_vocabulary():
    uses = np.array([50, 20, 10, 5, 5, 5, 5])
    assert G.shortlist_size(uses, 100) == 2 and G.shortlist_size(uses, 150) == 4
    assert G.shortlist_size(np.ones(10, int), 10**6) == 10 and G.shortlist_size(np.ones(10**5, int), 10**6) == G.MOST
    for n in (1, 2, 3, 1000, 32_768):
        classes, size, tail = G.shape(G.initial(np.ones(n), 1.0))
        assert tail >= n and classes <= size <= classes + 2 and tail < 2**16


def test_counts_and_gain(spark):
    from churnscope.llm.registry import queries

    got = queries()["op6_gru_lm"](spark, DIR).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    assert sorted(((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got), key=repr) == brute(rows)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in got)
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_coding_equals_plain_split():
    import pyarrow as pa

    texts = ["The  cat", None, "", " \t lead and trail \x0b\x0c\r\n", "a\x1cb\x85c\u00a0É d", "the THE É é", "\n"]
    codes, sizes, words = G.code_texts(pa.array(texts, pa.string()))
    got = [[words[int(i)].as_py().encode() for i in part] for part in np.split(codes, np.cumsum(sizes)[:-1])]
    assert got == [(t or "").encode().lower().split() for t in texts]
    many = np.array([0, 1, 65535, 65536, 2**31 - 1, 7], np.int32)
    assert (G.from_planes(G.planes(many)) == many).all()


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 300)
    monkeypatch.setattr(G, "TOGETHER", 50)
    rows = [(i, f"the cat {i} sat on the mat " * (i % 4), "s", "n", "w") for i in range(40)]
    rows += [(100, None, "", "", ""), (101, "", "", "", ""), (None, "the cat", "", "", ""), (7, rows[7][1], "", "", ""), (103, "word " * 30_000, "", "", "")]
    from churnscope.llm.common import crc32_mod

    learned = crc32_mod(F.col("doc_id"), 10) != 0
    got = G.score(spark.createDataFrame(rows, SCHEMA), learned).collect()
    assert sorted(((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got), key=repr) == brute([r[:2] for r in rows])
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    none = G.score(spark.createDataFrame(rows[:3], SCHEMA), F.lit(False)).collect()
    assert all(r.score == r.base_score == 0 for r in none)
    assert G.score(spark.createDataFrame([], SCHEMA), learned).collect() == []


def test_every_training_word_is_a_target(spark, monkeypatch):
    """The model learns all words, not only those that cover a share of the texts."""
    seen, plain = [], G.initial
    monkeypatch.setattr(G, "initial", lambda frequency, tail: seen.append(list(frequency)) or plain(frequency, tail))
    docs = spark.createDataFrame([(i, "the the the the rare" + str(i)) for i in range(5)] + [(9, "other words")], "doc_id long, text string")
    G.score(docs, F.col("doc_id") < 9).collect()
    assert seen == [[5.0, 20.0, 1.0, 1.0, 1.0, 1.0, 1.0]]


def test_large_sums_reach_the_driver_once_a_piece(spark):
    from churnscope.llm.common import tree_sum
    rows = spark.range(0, 40, 1, 5)
    make = lambda batches: np.full((7, 3), float(sum(b["id"].sum() for b in batches)))
    assert (tree_sum(rows, make, 4) == 780).all() and (tree_sum(rows, make) == 780).all()
    assert tree_sum(rows.limit(0), lambda batches: None, 4) is None


def test_windows_of_few_streams_are_settled_together(monkeypatch):
    """A long document alone costs few passes over the classes, and any cut of the work gives the same scores."""
    rng = np.random.default_rng(8)
    w = {k: v.astype(np.float32) for k, v in weights(2).items()}
    docs = [rng.integers(1, TAIL + 1, n).astype(np.uint16) for n in (5000, 40, 3)]
    calls, plain = [], G.log_probabilities
    monkeypatch.setattr(G, "log_probabilities", lambda *a: calls.append(1) or plain(*a))
    want = G.score_documents(w, docs)
    assert len(calls) == 1
    for cached, settled in ((1, 1), (200, 100)):
        monkeypatch.setattr(G, "CACHED", cached)
        monkeypatch.setattr(G, "SETTLED", settled)
        assert np.allclose(G.score_documents(w, docs), want, rtol=1e-5)


def test_large_logits_stay_finite():
    w = {k: v * 40 for k, v in weights(6).items()}
    h = np.random.default_rng(1).normal(size=(50, G.HIDDEN))
    every = np.arange(TAIL + 1)
    assert np.isfinite(G.log_probabilities(w, h, np.resize(every, 50))).all()
    assert abs(np.exp(G.log_probabilities(w, np.repeat(h[:1], len(every), 0), every)).sum() - 1) < 1e-6
