"""PU learning: held-out accuracy, prior, the risk's slopes, and odd rows."""

import numpy as np
from pyspark.sql import functions as F

from churnscope.llm import quality as Q

DIR = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, score string, predicted string, quality string"


def test_held_out_accuracy(spark):
    from churnscope.llm.registry import queries

    got = queries()["op2_quality"](spark, DIR)
    assert got.count() == spark.read.parquet(f"{DIR}/documents.parquet").count()
    rows = got.join(spark.read.parquet(f"{DIR}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert np.mean([r.predicted for r in rows if r.quality == 1]) > 0.98


def test_slopes_are_the_risks_derivative():
    rng = np.random.default_rng(0)
    for shift in (-3, 3):  # the second term is positive in one case and negative in the other
        zp, zu, prior = rng.normal(2, 1, 5), rng.normal(shift, 1, 7), 0.6
        negative = lambda p, u: np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()  # noqa: E731, B023
        risk = lambda p, u: prior * np.logaddexp(0, -p).mean() + negative(p, u) if negative(zp, zu) >= 0 else -negative(p, u)  # noqa: E731, B023
        sp, su = Q.nonnegative_risk_slopes(zp, zu, prior)
        for k in range(5):
            step = np.eye(5)[k] * 1e-5
            assert abs((risk(zp + step, zu) - risk(zp - step, zu)) / 2e-5 - sp[k]) < 1e-6
        for k in range(7):
            step = np.eye(7)[k] * 1e-5
            assert abs((risk(zp, zu + step) - risk(zp, zu - step)) / 2e-5 - su[k]) < 1e-6


def test_prior_of_known_mixture():
    rng = np.random.default_rng(1)
    for prior in (0.3, 0.6, 0.9):
        pos = rng.normal(2, 1, 4000)
        unl = np.where(rng.random(8000) < prior, rng.normal(2, 1, 8000), rng.normal(-3, 1, 8000))
        assert abs(Q.estimate_prior(pos, unl) - prior) < 0.04


def test_odd_rows(spark):
    rows = [(i, "good clean words about things number %d and so on" % i, "x", "y", "z") for i in range(60)]
    rows += [(100 + i, "BAD!! JUNK!! " * 20, "x", "y", "z") for i in range(20)]
    rows += [(500, None, "", "", ""), (501, "", "", "", ""), (502, " \n ", "", "", ""), (None, "no id", "", "", ""), (503, "long text " * 60_000, "", "", ""), (7, "twice", "", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(100, 0), (3, 0), (None, 1), (500, None)], "doc_id long, quality int")
    model = Q.learn(docs, labels, F.lit(True))
    got = Q.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got if r.doc_id != 7}
    assert by[500] == by[501] and by[20] > by[110]
    none = labels.limit(0)
    assert Q.learn(docs, none, F.lit(True)) is None
    assert {r.score for r in Q.score(docs, None).collect()} == {0.5}
    empty = docs.limit(0)
    assert Q.learn(empty, labels, F.lit(True)) is None and Q.score(empty, None).collect() == []


def test_all_rows_set_prior_and_threshold(spark):
    """A plain version: every row's out-of-fold logit and score, one by one, give the same prior and intercept."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    model = Q.learn(docs, labels, F.lit(True))
    fold = {r.doc_id: r.k for r in docs.select("doc_id", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(23)), F.lit(Q.FOLDS)).alias("k")).collect()}

    def logit(weights, text):
        total = float(weights[-1])
        for j, value in enumerate(Q.features(text)):
            total += weights[j * (model["edges"].shape[1] + 1) + sum(e <= value for e in model["edges"][j])]
        return total

    marks = {}
    for r in labels.collect():
        marks.setdefault(r.doc_id, set()).add(r.quality)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    plain = {i: np.floor(logit(model["plain"][fold[i]], t) * Q.FINE) / Q.FINE for i, t in rows}
    prior = Q.estimate_prior(np.array([plain[i] for i, _ in rows if marks.get(i) == {1}]), np.array([plain[i] for i, _ in rows]))
    assert abs(prior - model["prior"]) < 1e-6
    scores = {i: logit(model["weights"], t) for i, t in rows}
    assert abs(np.mean([z >= 0 for z in scores.values()]) - prior) < 0.01
    for r in Q.score(docs, model).collect():
        assert abs(r.score - 1 / (1 + np.exp(-scores[r.doc_id]))) < 1e-6 and r.predicted == (r.score >= 0.5)


def test_features_count_whole_texts():
    text = "Two  WORDS two words\n\nand a line, 12 % of it!\tend"
    f = Q.features(text)
    words = text.encode().lower().split()
    for k, letters in enumerate(Q.CLASSES):
        assert abs(f[k] - sum(b in letters for b in text.encode()) / len(text)) < 1e-12
    n, distinct = len(words), set(words)
    at = len(Q.CLASSES)
    assert np.allclose(f[at : at + 3], [np.log1p(n), len(distinct) / n, max(words.count(w) for w in distinct) / n])
    assert np.allclose(f[at + 5 : at + 8], [np.mean([len(w) for w in words]), np.std([len(w) for w in words]), np.mean([len(w) == 1 for w in words])])
