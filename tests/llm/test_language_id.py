"""Kneser-Ney models against their definition, held-out accuracy, and odd rows."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from churnscope.llm import language_id as L

SCHEMA = "doc_id long, text string, lang string, score string, rejected string"
DIR = "/root/testdata/sf0.01"


def grams(words):
    out = Counter()
    for w in words:
        p = L.BEGIN * (L.ORDER - 1) + w + L.END
        for i in range(len(p) - L.ORDER + 1):
            out[p[i : i + L.ORDER]] += 1
    return out


def by_definition(counts, alphabet):
    """P(c | context) straight from the formula, level by level."""
    levels = {L.ORDER: counts}
    for n in range(L.ORDER - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])

    def p(context, c):
        n = len(context) + 1
        own = levels[n]
        ones, twos = (sum(v == k for v in own.values()) for k in (1, 2))
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        after = {g[-1]: v for g, v in own.items() if g[:-1] == context}
        rest = p(context[1:], c) if context else 1 / alphabet
        if not after:
            return rest
        return max(0, after.get(c, 0) - d) * (c in after) / sum(after.values()) + d * len(after) / sum(after.values()) * rest

    return p


def test_scores_equal_definition():
    rng = np.random.default_rng(3)
    train = {k: ["".join(rng.choice(list(a), rng.integers(1, 7))) for _ in range(300)] for k, a in (("x", "abcd"), ("y", "abef"))}
    counts = {k: grams(w) for k, w in train.items()}
    model = L.build_model(counts)
    alphabet = 1 + len({g[-1] for c in counts.values() for g in c})
    words = ["ab", "zzq", "abcd", "efab", "a", "½", "éa"]
    sums, sizes = L.score_words(model, words)
    for k, lang in enumerate(model["langs"]):
        p = by_definition(counts[lang], alphabet)
        assert abs(sum(p("abc"[-3:], c) for c in "abcdef" + L.END) + p("abc", "?") - 1) < 1e-9
        for i, w in enumerate(words):
            s = L.BEGIN * (L.ORDER - 1) + w + L.END
            want = sum(math.log(p(s[j - L.ORDER + 1 : j], s[j])) for j in range(L.ORDER - 1, len(s))) if w != "½" else 0
            assert abs(sums[i, k] - want) < 1e-9
    assert sizes.tolist() == [3, 4, 5, 5, 2, 0, 3]


def test_held_out_accuracy(spark):
    from churnscope.llm.registry import queries

    got = queries()["op10_language_id"](spark, DIR)
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    assert got.count() == docs.count()


def test_odd_rows(spark):
    rows = [(i, "the cat sat on the mat " * 3, "en", "", "") for i in range(30)] + [(100 + i, "der hund und die katze", "de", "", "") for i in range(30)]
    rows += [(500, None, "en", "", ""), (501, "", "de", "", ""), (502, "123 ½ _ !", None, "", ""), (None, "the mat", "en", "", ""), (503, "DER HUND " * 9000, None, "", ""), (504, "ω" * 200, None, "", ""), (504, "ω" * 200, None, "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in L.identify(docs, L.learn(docs, F.col("doc_id") < 200)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [got[i][0].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and got[500][0].rejected and got[500][0].score == 0
    assert got[None][0].lang_pred == "en" and got[503][0].lang_pred == "de" and not got[503][0].rejected
    assert len(got[504]) == 2 and got[504][0].rejected and got[504][0].lang_pred in ("de", "en")
    assert not any(got[i][0].rejected for i in range(30))
    empty = spark.createDataFrame([], SCHEMA)
    assert L.identify(empty, L.learn(empty, F.lit(True))).collect() == []
    assert {r.lang_pred for r in L.identify(docs, L.learn(empty, F.lit(True))).collect()} == {"und"}
