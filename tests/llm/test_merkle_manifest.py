"""Merkle manifest: a plain tree in Python as oracle; nulls, lone leaves, wide and many sources, repeated rows."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from churnscope.llm import merkle_manifest as m

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    paths = []
    for k in range(len(digests)):
        path, j = [], k
        for level in levels[:-1]:
            run, at = level[j // 3 * 3 : j // 3 * 3 + 3], j % 3
            path += ["".join(run[:at]), "".join(run[at + 1 :])]
            j //= 3
        paths.append(path)
    return levels[-1][0], paths


def plain(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for own in by.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    made = {s: tree([leaf(r) for r in by[s]]) for s in names}
    if not names:
        return []
    root, tops = tree([made[s][0] for s in names])
    out = []
    for s, top in zip(names, tops):
        for r, path in zip(by[s], made[s][1]):
            path, own = path + top, leaf(r)
            folded = own
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                folded = leaf((*r[:4], r[4].replace("\n", "")))
            for a, b in zip(path[::2], path[1::2]):
                folded = h(a, folded, b)
            out.append((r[0], own, made[s][0], root, h(*path), folded, folded == root))
    return out


def spark_rows(docs):
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = m.manifest(docs, F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    return sorted(map(tuple, found.collect()), key=repr)


def check(spark, rows):
    assert spark_rows(spark.createDataFrame(rows, SCHEMA)) == sorted(plain(rows), key=repr)


def test_one_wide_source_crosses_tiers(spark):
    # 2,300 leaves: seven levels and more, in two tiers; the other sources end within the first
    rows = [(i, "big", "en", i, f"line {i}\nmore") for i in range(2300)]
    rows += [(10_000 + i, f"s{i % 7}", None, None, "a\nb" if i % 2 else "ab") for i in range(100)]
    rows += [(20_000, None, None, None, None), (20_001, "", "", 0, ""), (20_002, "lone", "ü", 1, "é\n" * 5000), (-5, "ümlaut", "x", -1, "neg")]
    check(spark, rows)


def test_more_sources_than_a_bucket_holds(spark):
    check(spark, [(i, f"host{i}", "en", 1, f"t\n{i}") for i in range(1500)])


def test_nulls_and_repeated_rows(spark):
    check(spark, [(None, "a", None, None, "x\ny"), (None, "a", None, None, None), (1, "a", "l", 2, "r\ns"), (1, "a", "l", 2, "r\ns"), (1, "a", "l", 2, "other"), (2, "s1", None, None, "p"), (2, "s", None, None, "p")])


@pytest.mark.parametrize("rows", [[], [(0, "a", "b", 1, "one\nleaf")]])
def test_empty_table_and_lone_leaf(spark, rows):
    check(spark, rows)


def test_other_columns_and_proofs(spark):
    docs = spark.createDataFrame([(i, "a" if i % 3 else None, "en", i, f"t{i}") for i in range(20)], SCHEMA)
    clash = docs.selectExpr("*", "1 as tree", "2 as lo", "3 as n", "4 as digest", "5 as window", "6 as part")
    found = m.manifest(clash, with_proofs=True).collect()
    assert sorted(tuple(r[:5]) for r in found) == sorted(r[:5] for r in spark_rows(docs))
    for r in found:
        assert r["verified"] and m.fold(r["leaf"], r["proof"]) == r["root"]
        assert h(*r["proof"]) == r["proof_sha256"]
    assert {(r["source"], r["n"]) for r in found} == {(None, 7), ("a", 13)}
