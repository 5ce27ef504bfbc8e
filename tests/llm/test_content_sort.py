"""Exact duplicates by content sort against a plain grouping: nulls, white space, common heads, one group across all partitions."""

import hashlib
import re
from collections import defaultdict

import pytest

from churnscope.llm import content_sort as c


def plain(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub("[\x20\x09-\x0d]+", " ", text or "")].append(doc_id)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, ids[0], len(ids), k == 0, digest) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


def found(spark, rows, schema="doc_id long, text string"):
    return sorted(map(tuple, c.deduplicate(spark.createDataFrame(rows, schema)).collect()), key=repr)


def test_one_group_spans_all_partitions(spark):
    rows = [(i, "the same text") for i in range(3000)] + [(10_000 + i, f"text {i % 900}") for i in range(2000)]
    assert found(spark, rows) == plain(rows)


def test_common_heads_and_long_texts(spark):
    opening = "a common opening line that is longer than the head of a range key, by far " * 3
    rows = [(i, opening + str(i % 400)) for i in range(1200)] + [(5000 + i, "x y" * 60_000 + str(i // 2)) for i in range(6)]
    assert found(spark, rows) == plain(rows)


def test_white_space_nulls_and_ties(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "\t\r\n"), (5, "a b"), (6, "a \x0b b"), (7, "a\nb "), (8, "a b "), (9, "a\x85b"), (10, "a\x1cb"), (11, "a b"),
            (None, "a b"), (None, "only null"), (None, "only null"), (12, "again"), (12, "again"), (13, "A B")]
    assert found(spark, rows) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(None, None)], [(3, "x")]])
def test_tiny_tables(spark, rows):
    assert found(spark, rows) == plain(rows)


def test_rows_that_stay_keep_their_columns(spark):
    rows = [(i, f"t  {i % 5}", i, "p", 0.5) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, print long, head string, part double")
    kept = c.unique_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == rows[:5]
    assert sorted(map(tuple, c.deduplicate(docs).collect()), key=repr) == plain([r[:2] for r in rows])


def test_runs_cross_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(i, f"t{i % 37}") for i in range(400)] + [(1000 + i, "hot") for i in range(100)]
        assert found(spark, rows) == plain(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
