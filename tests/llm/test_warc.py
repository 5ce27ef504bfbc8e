"""Archives: exact round trip, order of the merged index, and the loser tree against a plain sort."""

import base64
import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from churnscope.llm import warc

SCHEMA = "page_id long, url string, html string, sha string, _key int, refers_to string"


@given(st.lists(st.lists(st.integers(0, 30), max_size=12), max_size=9))
@settings(deadline=None)
def test_loser_tree_equals_sort(runs):
    runs = [sorted(r) for r in runs]
    assert list(warc.loser_tree_merge(runs, key=lambda x: x)) == sorted(x for r in runs for x in r)


def test_round_trip(spark, monkeypatch):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # else a small table makes one archive
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    monkeypatch.setattr(warc, "RANGE_ROWS", 50)
    monkeypatch.setattr(warc, "RUN_BYTES", 600)
    rows = [(i, f"http://h{i % 5}.example.org/p?{i}\n", f"<p>é {i // 7}</p>" * (1 + i % 3), None, 1, "x") for i in range(200)]
    rows += [(500, None, None, None, 1, "x"), (501, "", "", None, 1, "x"), (502, "no scheme", "long " * 300_000, None, 1, "x")]
    rows += [(7, rows[7][1], rows[7][2], None, 1, "x"), (None, "http://same.org/", "<p>é 0</p>", None, 1, "x")]
    rows += [(600 + i, "http://hot.org/", "hot", None, 1, "x") for i in range(150)]
    got = warc.round_trip(spark.createDataFrame(rows, SCHEMA)).collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    first = {}
    for i, _, html, *_ in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    want = []
    for i, url, html, *_ in rows:
        data = (html or "").encode()
        ref = first.get(html or "")
        revisit = ref is not None and i != ref
        key = warc.url_key((url or "").replace("\n", "%0A"))
        want.append((key, i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", ref if revisit else None))
    assert sorted(map(repr, want)) == sorted(repr((r.url_key, r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    keys = [(r.url_key, r.capture_ts, -1 if r.page_id is None else r.page_id) for r in got]
    assert keys == sorted(keys)
    assert len({r.archive for r in got}) > 3


def test_small_payloads_and_empty_table(spark):
    rows = [(2, "http://a.org/", "ab", None, 1, None), (1, "http://a.org/", "ab", None, 1, None), (3, "http://b.org/", "abcd", None, 1, None), (4, "http://b.org/", "abcd", None, 1, None)]
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(spark.createDataFrame(rows, SCHEMA), min_bytes=3).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []
