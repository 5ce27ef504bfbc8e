"""Best-fit packing against a plain scan over all bins."""

from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from churnscope.llm.packing import best_fit, pack

PIECE = st.tuples(st.integers(1, 20), st.sampled_from([None, "a", "a", "a", "b", "c", "d"]), st.sampled_from([None, 1, 1, 2, 3]))
SCHEMA = "doc_id long, text string, source string, bin string"


def scan(pieces, capacity):
    bins, out = [], []
    for size, s, c in pieces:
        fits = [
            (room, k) for k, (room, held) in enumerate(bins)
            if room >= size and all((s is None or s != hs) and (c is None or c != hc) for hs, hc in held)
        ]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([capacity, []])
        out.append((k, capacity - bins[k][0]))
        bins[k][0] -= size
        bins[k][1].append((s, c))
    return out


@given(st.lists(PIECE, max_size=80))
@settings(deadline=None, max_examples=200)
def test_equals_plain_best_fit(pieces):
    pieces = sorted(pieces, key=lambda p: -p[0])
    into, offset = best_fit(pieces, 20)
    assert list(zip(into, offset)) == scan(pieces, 20)


def test_pack_table(spark):
    rows = [(i, "w " * (i % 37 + 1) + str(i), "hot" if i % 3 == 0 else f"s{i % 7}", "clash") for i in range(400)]
    rows += [(1000 + i, "Same  copy", f"t{i}", None) for i in range(50)] + [(2000, None, "x", None), (2001, "", None, None), (2002, " \n", "x", None)]
    rows += [(None, "no id", None, None), (3000, "long " * 170, "x", "y"), (3001, "twice", "q", None), (3001, "twice", "q", None)]
    got = pack(spark.createDataFrame(rows, SCHEMA), capacity=50, shard=100).collect()
    words = {2000: 0, 2001: 0, 2002: 0}
    per_doc, per_bin = Counter(), {}
    for r in got:
        per_doc[r.doc_id] += r.n_words
        if r.bin is not None:
            per_bin.setdefault(r.bin, []).append(r)
    for i, text, _, _ in rows:
        words[i] = words.get(i, 0) + len((text or "").split())
    assert per_doc == Counter(words)
    assert [r.bin for r in got if r.doc_id in (2000, 2001, 2002)] == [None] * 3
    for held in per_bin.values():
        at = 0
        for r in sorted(held, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.n_words
        assert at <= 50
        sources = [r.source for r in held if r.source is not None]
        assert len(sources) == len(set(sources))
        assert sum(1000 <= (r.doc_id or 0) < 1050 for r in held) <= 1


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], SCHEMA)).collect() == []
