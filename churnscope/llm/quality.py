"""Quality classifier by positive-unlabelled learning (operator 2).

Trusted positives are rows marked good; everything else is unlabelled web text, good and bad, and a mark
"bad" is never used.  An additive logistic model over counts of characters, words and lines of the whole
text is fitted by minimising the non-negative unbiased risk

    prior * R_pos(+1)  +  max(0, R_unl(-1) - prior * R_pos(-1)),

where ``prior`` is the share of positives among the unlabelled.  It is estimated first: a plain model that tells
positives from unlabelled texts ranks both, and prior is the least ratio of unlabelled to positive shares over
the regions above a rank, widened by half the sampling error (where a region holds no bad text that
ratio is the prior itself).  When a mini-batch makes the second term negative, its gradient is
reversed, so that the model stops fitting the unlabelled texts as if they were all bad.  Finally the intercept is
set so that a share ``prior`` of the unlabelled texts scores 0.5 or more.

The weights are fitted on a bounded sample (documented parameters): about SAMPLE_POSITIVE trusted rows and SAMPLE_UNLABELLED others, chosen
by a hash of the id; only their feature vectors come to the driver.  The unlabelled shares that make the prior, and the quantile
that sets the intercept, come from histograms of the scores of all usable rows, made on Spark.  The plain model scores each row with
weights fitted without the row's own hash fold.  All rows are scored from whole texts.

Cases: null and empty texts have zero counts and get a score too; without any trusted positive every score is
0.5; a row with contradicting marks is no trusted positive; a null id is neither held out nor learned from; repeated rows
are all scored; empty tables give empty results; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_mod, materialise, table, words_of

SAMPLE_POSITIVE = 8_000
SAMPLE_UNLABELLED = 16_000
STEPS, BATCH, RATE, FOLDS = 600, 2048, 0.02, 3
#: Steps of a score histogram for each unit of a logit.
FINE = 256

#: Bytes of each class that is counted, in the order of the features.
CLASSES = [
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c", b".", b",", b";:", b"!", b"?", b"'\"",
    b"()[]", b"{}<>", b"|", b"*#", b"$%&", b"@/\\", b"-_", b"=+~^`", bytes(range(128, 256)),
]
_CLASS_OF = np.full(256, len(CLASSES))
for _k, _c in enumerate(CLASSES):
    _CLASS_OF[list(_c)] = _k
FEATURES = len(CLASSES) + 12


def features(text: str | None) -> np.ndarray:
    """Counts of a whole text, as shares and ratios; zeros for a null or empty one."""
    out = np.zeros(FEATURES)
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return out
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    per_class = np.bincount(_CLASS_OF, hist, len(CLASSES) + 1)[: len(CLASSES)]
    out[: len(CLASSES)] = per_class / len(raw)
    words = words_of(text)
    n = len(words)
    if n:
        distinct = set(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        number = dict(zip(distinct, range(len(distinct))))
        codes = np.fromiter(map(number.__getitem__, words), np.int64, n)
        uses = np.bincount(codes)
        lines = raw.split(b"\n")
        letters = hist[97:123].sum() + hist[65:91].sum() + hist[128:].sum()
        out[len(CLASSES) :] = [
            np.log1p(n), len(distinct) / n, uses.max() / n, np.sqrt((uses.astype(float) ** 2).sum()) / n, (codes[1:] == codes[:-1]).mean() if n > 1 else 0.0,
            sizes.mean(), sizes.std(), (sizes == 1).mean(), len(set(lines)) / len(lines), np.log1p(len(raw) / len(lines)),
            letters / len(raw), per_class[0] / max(1, per_class[0] + per_class[1]),
        ]
    return out


def _binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Column numbers of the one-hot bins: one for each feature."""
    at = np.stack([np.searchsorted(edges[j], x[:, j], side="right") for j in range(x.shape[1])], axis=1)
    return at + np.arange(x.shape[1]) * (edges.shape[1] + 1)


def _logits(weights: np.ndarray, bins: np.ndarray) -> np.ndarray:
    return weights[bins].sum(1) + weights[-1]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class _Adam:
    def __init__(self, size: int, decay: float):
        self.decay = decay
        self.w, self.m, self.v, self.t = np.zeros(size), np.zeros(size), np.zeros(size), 0

    def step(self, bins: np.ndarray, slope: np.ndarray) -> None:
        """slope: derivative of the risk by each row's logit."""
        grad = np.bincount(bins.ravel(), np.repeat(slope, bins.shape[1]), len(self.w))
        grad[-1] = slope.sum()
        grad += self.decay * np.r_[self.w[:-1], 0]
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * grad
        self.v = 0.999 * self.v + 0.001 * grad**2
        self.w -= RATE * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def _batches(rng, n_pos: int, n_unl: int, steps: int):
    """Row numbers of positives and unlabelled rows for each step; small sets are used whole."""
    for _ in range(steps):
        yield tuple(np.arange(n) if n <= BATCH else rng.integers(0, n, BATCH) for n in (n_pos, n_unl))


def estimate_prior(pos: np.ndarray, unl: np.ndarray, uses: np.ndarray | None = None) -> float:
    """Share of positives among the unlabelled, from scores that rank positives high.  uses: how often each of ``unl`` occurs."""
    uses = np.ones(len(unl)) if uses is None else uses
    order = np.argsort(unl)
    above = np.append(np.cumsum(uses[order][::-1])[::-1], 0.0)
    cuts = np.unique(np.quantile(pos, np.linspace(0, 0.5, 51)))
    p = np.array([(pos >= c).mean() for c in cuts])
    u = above[np.searchsorted(unl[order], cuts)] / above[0]
    error = np.sqrt(u * (1 - u) / above[0]) / 2
    return float(np.clip(((u + error) / p).min(), 0.01, 0.99))


def nonnegative_risk_slopes(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives by the logits of positives and unlabelled rows, of the logistic loss' non-negative PU risk."""
    up, uu = _sigmoid(zp), _sigmoid(zu)
    loss = lambda z: np.logaddexp(0, z)  # of label -1
    negative = loss(zu).mean() - prior * loss(zp).mean()
    sp, su = prior * (up - 1) / len(zp), uu / len(zu)
    if negative >= 0:
        return sp - prior * up / len(zp), su
    return prior * up / len(zp), -su


def fit_plain(pos: np.ndarray, unl: np.ndarray, fold_p: np.ndarray, fold_u: np.ndarray, seed: int = 7) -> dict:
    """Bin edges, and plain models that tell positives from unlabelled rows, each fitted without the rows of one fold."""
    both = np.vstack([pos, unl])
    bins = int(np.clip(1.5 * len(both) ** 0.25, 4, 16))  # finer, and with less decay, the more rows there are
    edges = np.quantile(both, np.linspace(0, 1, bins + 1)[1:-1], axis=0).T
    bp, bu = _binned(pos, edges), _binned(unl, edges)
    rng = np.random.default_rng(seed)
    plain = []
    for k in range(FOLDS):
        own_p, own_u = fold_p != k, fold_u != k
        if min(own_p.sum(), own_u.sum()) < 10:  # too few rows to leave some out
            own_p, own_u = np.ones(len(pos), bool), np.ones(len(unl), bool)
        model = _Adam(pos.shape[1] * bins + 1, 5 / len(pos))
        for i, j in _batches(rng, own_p.sum(), own_u.sum(), STEPS // 4):
            a, b = bp[own_p][i], bu[own_u][j]
            model.step(np.vstack([a, b]), np.r_[(_sigmoid(_logits(model.w, a)) - 1) / len(a), _sigmoid(_logits(model.w, b)) / len(b)] / 2)
        plain.append(model.w)
    return {"edges": edges, "plain": plain, "bins": bins}


def fit(pos: np.ndarray, unl: np.ndarray, edges: np.ndarray, prior: float, seed: int = 8) -> np.ndarray:
    """Weights that minimise the non-negative risk."""
    bp, bu = _binned(pos, edges), _binned(unl, edges)
    model = _Adam(pos.shape[1] * (edges.shape[1] + 1) + 1, 5 / len(pos))
    for i, j in _batches(np.random.default_rng(seed), len(bp), len(bu), STEPS):
        a, b = bp[i], bu[j]
        model.step(np.vstack([a, b]), np.concatenate(nonnegative_risk_slopes(_logits(model.w, a), _logits(model.w, b), prior)))
    return model.w


def _histogram(coded: DataFrame, weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Logits of all rows (fold, bins) by the weights of their fold, as steps of 1 / FINE, and how often each occurs."""

    def run(batches):
        for pdf in batches:
            bins = np.frombuffer(b"".join(pdf["bins"]), np.uint16).reshape(len(pdf), -1)
            fold = pdf["fold"].to_numpy() % len(weights)
            z = np.zeros(len(pdf))
            for k, w in enumerate(weights):
                z[fold == k] = _logits(w, bins[fold == k])
            step, n = np.unique(np.floor(np.clip(z, -60, 60) * FINE).astype(np.int64), return_counts=True)
            yield pd.DataFrame({"step": step, "n": n})

    found = coded.mapInPandas(run, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).orderBy("step").toPandas()  # 120 * FINE rows at most
    return found["step"].to_numpy() / FINE, found["n"].to_numpy(np.float64)


def learn(docs: DataFrame, labels: DataFrame, usable: Column, positives: int = SAMPLE_POSITIVE, unlabelled: int = SAMPLE_UNLABELLED) -> dict | None:
    """Fit on the ``usable`` rows of (doc_id, text); ``labels``: (doc_id, quality).  None without positives."""
    marks = labels.filter(usable & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    good = marks.filter("low = 1 and high = 1").select("doc_id")
    rows = docs.filter(usable & F.col("doc_id").isNotNull()).select("doc_id", "text")
    n_good, n_rows = good.count(), rows.count()
    if not n_good or not n_rows:
        return None
    fold = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(23)), F.lit(FOLDS)).cast("int")
    place = lambda seed: F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed)), F.lit(1 << 30))
    chosen = good.filter(place(21) < min(1.0, positives / n_good) * (1 << 30)).withColumn("trusted", F.lit(True))
    drawn = rows.join(F.broadcast(chosen), "doc_id", "left")  # about ``positives`` ids, however large the table is
    drawn = drawn.withColumn("drawn", place(22) < min(1.0, unlabelled / n_rows) * (1 << 30)).filter("trusted or drawn")

    def count(batches):
        for pdf in batches:
            yield pd.DataFrame({"trusted": pdf["trusted"].notna(), "drawn": pdf["drawn"], "fold": pdf["fold"], "x": [features(t) for t in pdf["text"]]})

    got = drawn.select("text", "trusted", "drawn", fold.alias("fold")).mapInPandas(count, "trusted boolean, drawn boolean, fold int, x array<double>").toPandas()
    if not got["trusted"].any() or not got["drawn"].any():
        return None
    x = np.stack(got["x"].to_numpy())
    order = np.lexsort(x.T)  # an order of their own, so that a fit can be repeated
    x, trusted, taken, folds = (v[order] for v in (x, got["trusted"].to_numpy(), got["drawn"].to_numpy(), got["fold"].to_numpy()))
    pos, unl = x[trusted], x[taken]
    model = fit_plain(pos, unl, folds[trusted], folds[taken])
    edges, plain = model["edges"], model["plain"]

    def code(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                bins = _binned(np.stack([features(t) for t in part["text"]]), edges).astype(np.uint16)
                yield pd.DataFrame({"fold": part["fold"], "bins": [b.tobytes() for b in bins]})

    coded = materialise(rows.select("text", fold.alias("fold")).mapInPandas(code, "fold int, bins binary"), "binned")
    at_pos = np.array([_logits(plain[k], b) for k, b in zip(folds[trusted], _binned(pos, edges)[:, None, :])]).ravel()
    model["prior"] = estimate_prior(np.floor(at_pos * FINE) / FINE, *_histogram(coded, plain))
    weights = fit(pos, unl, edges, model["prior"])
    # the share of unlabelled texts that count as good is to be the prior
    step, n = _histogram(coded, [weights])
    weights[-1] -= step[np.searchsorted(np.cumsum(n), (1 - model["prior"]) * n.sum()).clip(0, len(step) - 1)]
    return model | {"weights": weights}


def scorer(spark: SparkSession, model: dict | None):
    """A column function: text -> score."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(text: pd.Series) -> pd.Series:
        m = shared.value
        if m is None or not len(text):
            return pd.Series(np.full(len(text), 0.5))
        return pd.Series(_sigmoid(_logits(m["weights"], _binned(np.stack([features(t) for t in text]), m["edges"]))))

    return lambda text: run(F.col(text).cast("string"))


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, score, predicted for every row of (doc_id, text)."""
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), scorer(docs.sparkSession, model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    rest = crc32_mod(F.col("doc_id"), 3)
    model = learn(docs.select("doc_id", "text"), labels.select("doc_id", "quality"), rest != 1)
    return score(docs, model).select("doc_id", F.coalesce(rest == 1, F.lit(False)).alias("held_out"), "score", "predicted")


SPARK = {"op2_quality": op2_quality}
SQL: dict[str, str] = {}
