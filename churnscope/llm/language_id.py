"""Language identification by character language models (operator 10).

Each language gets an interpolated Kneser-Ney model of order ORDER over the characters of lower-cased words, with
contexts that start afresh at each word.  For every n-gram seen, the interpolated log probability is stored,
and for every context its back-off weight, in arrays sorted by a 64-bit hash of the n-gram.  A text's language is
that of the lowest cross-entropy per character.  ``score`` is the softmax over languages of minus the
cross-entropies, sharpened by a factor that is fitted to calibration texts.

Calibration is cross-fitted: for each of PARTS hash parts of the sample, models of the other parts score its texts, so that every
language, however rare, is calibrated on texts that its model hasn't seen.  For rejection a text is cut into segments of SEGMENT words, each
of which takes its own best language (so texts that mix languages pass), and their mean cross-entropy is the text's
``cross_entropy``.  A language's limit lies SLACK times as far above the median of its calibration texts as their 99 % quantile (which
counts as a tenth above the median at least).  A text that lies above the limit of its language by a total of more than EXCESS nats is marked ``rejected``.

The models are fitted on a bounded sample of the labelled rows: about SAMPLE_DOCS whole texts for each language,
chosen by a hash of the id (documented parameter).  All rows are predicted, from whole texts.  A word's score
depends on the word alone, so each distinct word of a batch is scored once, and each distinct n-gram of
those words is looked up once.

Cases: a null text or one without a letter is ``und`` with score 0 and rejected; with no row to learn from every
text is ``und``; equal cross-entropies go to the language that sorts first; a null id is neither held out nor learned
from; repeated rows are all kept; empty tables give empty results; other columns don't matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_mod, mix64, table

ORDER = 4
SAMPLE_DOCS = 1500
EXCESS, SLACK, SEGMENT, PARTS = 40.0, 4.0, 25, 5
TOGETHER = 2000
BEGIN, END = "\x02", "\x03"
WORD = re.compile(r"[^\W\d_]+")
UNDECIDED = "und"


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters.  A run may hold other numerals; without any letter it is no word."""
    return WORD.findall(text.lower()) if text else []


def _hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """For each predicted character of each word (its letters and END): the word's number, and the hashes of
    the n-grams of order 1 to ORDER that end there."""
    pad = BEGIN * (ORDER - 1)
    codes = np.frombuffer("".join([pad + w + END for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + ORDER for w in words], np.int64)
    word = np.repeat(np.arange(len(words)), sizes)
    inside = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.flatnonzero(inside >= ORDER - 1)
    orders = [mix64(codes[at] + np.uint64(1))]
    for n in range(1, ORDER):
        orders.append(mix64(orders[-1] + np.uint64(0x9E3779B97F4A7C15) * (codes[at - n] + np.uint64(1))))
    return word[at], at, orders


def _hash_of(gram: str) -> np.uint64:
    h = mix64(np.array([ord(gram[-1]) + 1], np.uint64))
    for c in reversed(gram[:-1]):
        h = mix64(h + np.uint64(0x9E3779B97F4A7C15) * np.array([ord(c) + 1], np.uint64))
    return h[0]


def kneser_ney(counts: dict[str, int], alphabet: int) -> tuple[list[dict[str, float]], list[dict[str, float]]]:
    """Log probabilities of n-grams and log back-off weights of contexts, by order, from counts of order ORDER.

    Lower orders count in how many ways an n-gram continues to the left.  ``alphabet``: characters that
    share what the lowest order leaves, seen ones included.
    """
    levels = [counts]
    for _ in range(ORDER - 1):
        levels.append(Counter(g[1:] for g in levels[-1]))
    levels.reverse()
    probs: list[dict[str, float]] = []
    backs: list[dict[str, float]] = []
    lower: dict[str, float] = {}
    for level in levels:
        ones, twos = (sum(n == k for n in level.values()) for k in (1, 2))
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        total: Counter = Counter()
        kinds: Counter = Counter()
        for g, n in level.items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        weight = {h: discount * kinds[h] / total[h] for h in total}
        now = {}
        for g, n in level.items():
            rest = lower[g[1:]] if len(g) > 1 else 1 / alphabet
            now[g] = (n - discount) / total[g[:-1]] + weight[g[:-1]] * rest
        probs.append({g: math.log(p) for g, p in now.items()})
        backs.append({h: math.log(w) for h, w in weight.items()})
        lower = now
    return probs, backs


def _sorted_arrays(values: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.array([_hash_of(g) for g in values], np.uint64)
    by = np.argsort(keys)
    return keys[by], np.array(list(values.values()))[by]


def build_model(counts: dict[str, dict[str, int]]) -> dict:
    """Models of all languages from their n-gram counts: plain lists and arrays."""
    langs = sorted(counts)
    alphabet = 1 + len({g[-1] for c in counts.values() for g in c})
    tables = []
    for lang in langs:
        probs, backs = kneser_ney(counts[lang], alphabet)
        empty = backs[0].get("", math.log(1.0))
        tables.append({"probs": [_sorted_arrays(p) for p in probs], "backs": [_sorted_arrays(b) for b in backs[1:]], "unseen": empty - math.log(alphabet)})
    return {"alphabet": alphabet, "langs": langs, "tables": tables, "sharp": 1.0, "limit": [math.inf] * len(langs)}


def _find(arrays: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    stored, values = arrays
    if not len(stored):
        return np.zeros(len(keys), bool), np.zeros(len(keys))
    at = np.minimum(np.searchsorted(stored, keys), len(stored) - 1)
    return stored[at] == keys, values[at]


def score_words(model: dict, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihood of each word in each language (words x languages), and its number of predictions.

    Words without a letter count nothing.
    """
    words = [w if any(map(str.isalpha, w)) else "" for w in words]
    word, at, orders = _hashes(words)
    # the context of a prediction is the n-gram that ends one character earlier; at a word's start that is all BEGIN
    _, first, number = np.unique(orders[-1], return_index=True, return_inverse=True)
    grams = [h[first] for h in orders]
    contexts = _context_hashes(words, at[first])
    out = np.empty((len(first), len(model["langs"])))
    for k, t in enumerate(model["tables"]):
        hit, value = _find(t["probs"][0], grams[0])
        log = np.where(hit, value, t["unseen"])
        for n in range(1, ORDER):
            hit, value = _find(t["probs"][n], grams[n])
            known, weight = _find(t["backs"][n - 1], contexts[n - 1])
            log = np.where(hit, value, log + np.where(known, weight, 0.0))
        out[:, k] = log
    per = out[number]
    sizes = np.array([len(w) + 1 if w else 0 for w in words])
    per[~(sizes > 0)[word]] = 0.0
    sums = np.add.reduceat(per, np.flatnonzero(np.r_[True, word[1:] != word[:-1]]), axis=0) if len(word) else np.zeros((0, len(model["langs"])))
    return sums, sizes


def _context_hashes(words: list[str], at: np.ndarray) -> list[np.ndarray]:
    """Hashes of the contexts of 1 to ORDER - 1 characters before the places ``at`` of the padded words."""
    codes = np.frombuffer("".join([BEGIN * (ORDER - 1) + w + END for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    hashes = [mix64(codes[at - 1] + np.uint64(1))]
    for n in range(2, ORDER):
        hashes.append(mix64(hashes[-1] + np.uint64(0x9E3779B97F4A7C15) * (codes[at - n] + np.uint64(1))))
    return hashes


def score_texts(model: dict, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cross-entropy of each text in each language, its number of predicted characters (0: no letter), and its cross-entropy
    when each segment of SEGMENT words takes its best language."""
    split = [words_of(t) for t in texts]
    number: dict[str, int] = {}
    for ws in split:
        for w in ws:
            number.setdefault(w, len(number))
    ce, chars, mixed = np.zeros((len(texts), len(model["langs"]))), np.zeros(len(texts), np.int64), np.zeros(len(texts))
    if not number or not model["langs"]:
        return ce, chars, mixed
    sums, sizes = score_words(model, list(number))
    for i, ws in enumerate(split):
        if ws:
            own = np.fromiter(map(number.__getitem__, ws), np.int64, len(ws))
            chars[i] = sizes[own].sum()
            parts = np.add.reduceat(sums[own], np.arange(0, len(own), SEGMENT), axis=0)
            ce[i] = -parts.sum(0) / max(1, chars[i])
            mixed[i] = -parts.max(1).sum() / max(1, chars[i])
    return ce, chars, mixed


def decide(model: dict, ce: np.ndarray, chars: np.ndarray, mixed: np.ndarray) -> pd.DataFrame:
    """lang_pred, score, cross_entropy, rejected for texts scored by ``score_texts``."""
    n = len(chars)
    if not model["langs"]:
        return pd.DataFrame({"lang_pred": [UNDECIDED] * n, "score": np.zeros(n), "cross_entropy": [None] * n, "rejected": [True] * n})
    best = ce.argmin(1)
    low = ce[np.arange(n), best]
    share = 1 / np.exp(np.minimum(700, -model["sharp"] * (ce - low[:, None]))).sum(1)
    lang = np.array(model["langs"], object)[best]
    none = chars == 0
    lang[none] = UNDECIDED
    limit = np.array(model["limit"])[best]
    over = np.where(np.isfinite(limit), (mixed - np.where(np.isfinite(limit), limit, 0)) * chars, -1.0)
    return pd.DataFrame({"lang_pred": lang, "score": np.where(none, 0.0, share), "cross_entropy": np.where(none, None, mixed), "rejected": none | (over > EXCESS)})


def learn(docs: DataFrame, usable: Column, sample_docs: int = SAMPLE_DOCS) -> dict:
    """Fit models on about ``sample_docs`` rows of each language among the ``usable`` rows of (doc_id, text, lang).

    The models count all of the sample; sharpness and limits come from models that leave a part out.
    """
    rows = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return build_model({})
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, sample_docs / n)))])
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(11)), F.lit(1 << 30))
    sample = rows.filter(place < F.get(F.array(share), F.lit(0))[F.col("lang")] * float(1 << 30))
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(12)), F.lit(5))

    sample = sample.withColumn("part", part.cast("int"))

    def count(batches):
        for pdf in batches:
            for (lang, k), own in pdf.groupby(["lang", "part"]):
                words = Counter(w for t in own["text"] for w in words_of(t))
                grams: Counter = Counter()
                for w, n in words.items():
                    if any(map(str.isalpha, w)):
                        p = BEGIN * (ORDER - 1) + w + END
                        for i in range(len(p) - ORDER + 1):
                            grams[p[i : i + ORDER]] += n
                yield pd.DataFrame({"lang": lang, "part": k, "gram": list(grams), "n": list(grams.values())})

    found = sample.select("lang", "part", "text").mapInPandas(count, "lang string, part int, gram string, n long").groupBy("lang", "gram", "part").agg(F.sum("n").alias("n"))
    whole: dict[str, Counter] = {}
    parts: list[dict[str, Counter]] = [{} for _ in range(PARTS)]
    for lang, gram, k, n in found.toPandas().itertuples(index=False):  # bounded by the sample
        whole.setdefault(lang, Counter())[gram] += n
        parts[k].setdefault(lang, Counter())[gram] = n
    model = build_model(whole)
    others = []
    for own in parts:
        rest = {}
        for lang, grams in whole.items():
            left = {g: n - own.get(lang, {}).get(g, 0) for g, n in grams.items()}
            rest[lang] = {g: n for g, n in left.items() if n}
        others.append(build_model({lang: grams for lang, grams in rest.items() if grams}))
    shared = docs.sparkSession.sparkContext.broadcast((others, model["langs"]))

    def measure(batches):
        models, langs = shared.value
        for pdf in batches:
            for k, own in pdf.groupby("part"):
                ce, chars, mixed = score_texts(models[k], own["text"].tolist())
                at = [models[k]["langs"].index(x) if x in models[k]["langs"] else -1 for x in langs]
                every = np.where(np.array(at) < 0, np.inf, ce[:, at]) if len(ce.T) else np.full((len(own), len(langs)), np.inf)
                yield pd.DataFrame({"lang": own["lang"], "chars": chars, "mixed": mixed, "ce": list(every)})

    # a few numbers for each row of the sample
    checked = sample.select("lang", "part", "text").mapInPandas(measure, "lang string, chars long, mixed double, ce array<double>").filter("chars > 0").toPandas()
    checked = checked[checked["lang"].isin(model["langs"])]
    if len(checked):
        ce = np.stack(checked["ce"].to_numpy())
        truth = checked["lang"].map({x: k for k, x in enumerate(model["langs"])}).to_numpy()
        seen = np.isfinite(ce[np.arange(len(ce)), truth])  # a model that leaves the part out knows the language
        ce, truth, mixed = ce[seen], truth[seen], checked["mixed"].to_numpy()[seen]
    if len(checked) and len(ce):
        gap = ce - ce.min(1, keepdims=True)

        def loss(sharp):
            z = -sharp * gap
            return np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), truth])

        model["sharp"] = float(min(2.0 ** np.arange(0, 6.5, 0.5), key=loss))
        for k in range(len(model["langs"])):
            own = mixed[(truth == k) & (ce.argmin(1) == k)]
            if len(own):
                middle, high = np.quantile(own, [0.5, 0.99])
                model["limit"][k] = float(middle + SLACK * max(high - middle, middle / 10))
    return model


def identifier(spark: SparkSession, model: dict):
    """A column function: text -> struct of lang_pred, score, cross_entropy, rejected."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, cross_entropy double, rejected boolean")
    def run(text: pd.Series) -> pd.DataFrame:
        parts = [decide(shared.value, *score_texts(shared.value, text.iloc[at : at + TOGETHER].tolist())) for at in range(0, max(1, len(text)), TOGETHER)]
        return pd.concat(parts, ignore_index=True).astype({"cross_entropy": "float64"})

    return lambda text: run(F.col(text).cast("string"))


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy, rejected for every row of (doc_id, text)."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), identifier(docs.sparkSession, model)("text").alias("found"))
    return found.select("doc_id", "found.lang_pred", "found.score", "found.cross_entropy", "found.rejected")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs, crc32_mod(F.col("doc_id"), 5) != 0)
    held_out = F.coalesce(crc32_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return identify(docs, model).withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")


SPARK = {"op10_language_id": op10_language_id}
SQL: dict[str, str] = {}
