"""URL rules judged through a Bloom filter cascade (operator 1).

A rule is a host and a path prefix.  It fits its host and all subdomains when the url's path starts with the
rule's path, and the longest fitting rule wins.  Every url therefore has a short list of candidate keys
(host suffix + path prefix), and the question is which of them are listed.

A cascade answers that exactly without a join.  Level 0 is a Bloom filter of the listed keys; level 1 one of
those other keys *of the corpus* that level 0 lets through by mistake; level 2 one of the listed keys that
level 1 lets through; and so on, until nobody passes by mistake.  As the levels are built over the complete
universe of keys that the corpus can ask for, the answers are exact for each of them.  The first level's
false positive rate is about listed / others and the later ones' is one half, so the whole cascade takes a
few bits for each *listed* key, times the logarithm of the universe's size.  A second cascade over the listed
keys alone tells blocked from allowed ones.

Cases: a null url or one without ``://`` has an empty host and path, no key and no rule; a url that no rule
fits gets the method's own verdict, ``allow``; repeated rows are judged alike and all kept; empty tables give
empty results; columns of the input named like those made here are replaced only in the result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialise, mix64, table

#: (action, host, path) of the registered query.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Largest filter that is sent to the executors.
MAX_FILTER_BYTES = 256 << 20


#: A level: number of bits, number of hashes, the bits as uint64 words.  A plain tuple, as Spark's broadcast
#: pickles classes by name only.
Level = tuple[int, int, np.ndarray]


def _places(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, hashes: int) -> np.ndarray:
    """Bit positions (keys x hashes) on a level, independent of those on other levels."""
    a = mix64(h1.astype(np.uint64) + np.uint64((level * 0x9E3779B97F4A7C15) % 2**64))
    b = mix64(h2.astype(np.uint64) ^ np.uint64((level * 0xD1B54A32D192ED03) % 2**64)) | np.uint64(1)
    return (a[:, None] + np.arange(hashes, dtype=np.uint64)[None, :] * b[:, None]) % np.uint64(bits)


def _passes(level: Level, number: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    bits, hashes, words = level
    at = _places(h1, h2, number, bits, hashes)
    return ((words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


def contains(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether keys are listed.  Exact for the keys of the universe that the cascade was built over."""
    found = np.zeros(len(h1), bool)
    left = np.arange(len(h1))
    for k, level in enumerate(levels):
        left = left[_passes(level, k, h1[left], h2[left])]
        found[left] = k % 2 == 0  # stopped by the next level: encoded there, so of the other kind than that one
    return found


def _encode(keys: DataFrame, number: int, count: int, rate: float) -> Level:
    """One level's filter of ``count`` keys (h1, h2)."""
    hashes = max(1, round(-math.log2(rate)))
    bits = max(64, math.ceil(count * hashes / math.log(2)))
    if bits > MAX_FILTER_BYTES * 8:
        raise ValueError(f"a filter of {count} listed keys needs {bits >> 23} MB, more than MAX_FILTER_BYTES; split the list")

    def local(batches):
        for pdf in batches:
            if len(pdf):
                at = _places(pdf["h1"].to_numpy().astype(np.uint64), pdf["h2"].to_numpy().astype(np.uint64), number, bits, hashes).ravel()
                at = np.unique(at)
                words, start = np.unique(at >> np.uint64(6), return_index=True)
                ors = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), start)
                yield pd.DataFrame({"word": words.astype(np.int64), "ors": ors.view(np.int64)})

    words = np.zeros((bits + 63) // 64, np.uint64)
    rows = keys.mapInPandas(local, "word long, ors long").groupBy("word").agg(F.bit_or("ors").alias("ors"))
    for r in rows.toLocalIterator():
        words[r["word"]] = np.int64(r["ors"]).astype(np.uint64)
    return bits, hashes, words


def _only_passing(keys: DataFrame, level: Level, number: int) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def test(batches):
        for pdf in batches:
            ok = _passes(shared.value, number, pdf["h1"].to_numpy().astype(np.uint64), pdf["h2"].to_numpy().astype(np.uint64))
            yield pdf[ok]

    return keys.mapInPandas(test, keys.schema)


def build_cascade(universe: DataFrame) -> list[Level]:
    """The cascade for ``universe``: distinct keys (h1 long, h2 long, listed boolean)."""
    inside = materialise(universe.filter("listed").select("h1", "h2"), "listed")
    n_in = inside.count()
    if not n_in:
        return []
    outside = universe.filter("not listed").select("h1", "h2")
    n_out = outside.count()
    levels: list[Level] = []
    rate = min(0.5, max(2.0**-40, math.sqrt(0.5) * n_in / max(1, n_out)))
    while True:
        k = len(levels)
        levels.append(_encode(inside, k, n_in, rate if k == 0 else 0.5))
        wrong = materialise(_only_passing(outside, levels[k], k), "passing")
        n_wrong = wrong.count()
        if not n_wrong:
            return levels
        inside, outside, n_in = wrong, inside, n_wrong  # now these are encoded, and the last ones tested


def _of_lists(fn: Callable[[np.ndarray, np.ndarray], np.ndarray], h1: pd.Series, h2: pd.Series) -> list[np.ndarray]:
    """``fn`` over the concatenated lists of a batch, cut up as the lists are."""
    sizes = h1.map(len).to_numpy()
    flat = [np.concatenate([*s, np.empty(0, np.int64)]).astype(np.int64).view(np.uint64) for s in (h1, h2)]
    return np.split(fn(*flat), np.cumsum(sizes)[:-1])


def _host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    host = ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1))
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """``pages`` (with a column ``url``) plus host, path, rule and verdict.

    ``rules``: (allow or block, host, path prefix), at most one action for each host and path.  Hosts are
    lower case; the lists are the operator's parameter and so live on the driver.
    """
    spark = pages.sparkSession
    rules = sorted(set(rules))
    keys = {h + p: a for a, h, p in rules}
    if len(keys) != len(rules) or any(a not in ("allow", "block") or not h for a, h, _ in rules):
        raise ValueError("each rule needs a host, a path and one action: allow or block")
    host, path = _host_and_path(F.col("url"))
    own = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    if not rules:
        return own.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    # a rule with n labels or a path of n characters can only equal a suffix or prefix of that size
    labels = sorted({h.count(".") + 1 for _, h, _ in rules})
    prefixes = sorted({len(p) for _, _, p in rules})
    suffix = F.transform(
        F.filter(F.array(*map(F.lit, labels)), lambda n: (F.length("host") > 0) & (n <= F.size(F.split("host", "\\.")))),
        lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n),
    )
    prefix = F.transform(F.filter(F.array(*map(F.lit, prefixes)), lambda n: n <= F.length("path")), lambda n: F.call_function("left", F.col("path"), n))
    pairs = F.flatten(F.transform(suffix, lambda s: F.transform(prefix, lambda p: F.struct((-F.length(s) - F.length(p)).alias("size"), (-F.length(s)).alias("host_size"), F.concat(s, p).alias("key")))))
    longest_first = F.transform(F.array_sort(pairs), lambda x: x["key"])
    hashes = {"h1": F.transform("_keys", lambda k: F.xxhash64(k)), "h2": F.transform("_keys", lambda k: F.xxhash64(k, F.lit(1)))}
    asked = own.withColumn("_keys", longest_first).withColumns({"_h1": hashes["h1"], "_h2": hashes["h2"]})

    listed = spark.createDataFrame([(k, a == "block") for k, a in keys.items()], "key string, block boolean")
    listed = listed.select(F.xxhash64("key").alias("h1"), F.xxhash64("key", F.lit(1)).alias("h2"), "block")
    corpus = asked.select(F.explode(F.arrays_zip("_h1", "_h2")).alias("k")).select("k._h1", "k._h2").distinct().toDF("h1", "h2")
    universe = (
        corpus.withColumn("listed", F.lit(False)).unionByName(listed.select("h1", "h2", F.lit(True).alias("listed")))
        .groupBy("h1", "h2").agg(F.max("listed").alias("listed"))
    )
    member = build_cascade(materialise(universe, "universe"))
    blocked = build_cascade(materialise(listed.select("h1", "h2", F.col("block").alias("listed")), "rules"))
    filters = spark.sparkContext.broadcast((member, blocked))

    @F.pandas_udf("struct<at: int, block: boolean>")
    def judge(h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
        first, second = filters.value

        def both(a, b):
            inside = contains(first, a, b)
            return inside.astype(np.int8) + (inside & contains(second, a, b))

        found = _of_lists(both, h1, h2)
        at = [int(np.argmax(f > 0)) if len(f) and f.any() else -1 for f in found]
        return pd.DataFrame({"at": np.array(at, np.int32), "block": [k >= 0 and bool(f[k] == 2) for k, f in zip(at, found)]})

    judged = asked.withColumn("_judged", judge("_h1", "_h2"))
    fits = F.col("_judged.at") >= 0
    return judged.withColumns({
        "rule": F.when(fits, F.get("_keys", F.greatest(F.col("_judged.at"), F.lit(0)))),
        "verdict": F.when(~fits, F.lit(default)).when(F.col("_judged.block"), "block").otherwise("allow"),
    }).drop("_keys", "_h1", "_h2", "_judged")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).drop("url")


_VALUES = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)
SPARK = {"op1_url_filter": op1_url_filter}
SQL = {
    "op1_url_filter": f"""
WITH rules(action, rhost, rpath) AS (VALUES {_VALUES}),
cut AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest,
         row_number() OVER () AS n
  FROM pages),
parts AS (
  SELECT n, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
fits AS (
  SELECT n, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY n)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM parts LEFT JOIN fits USING (n)"""
}
