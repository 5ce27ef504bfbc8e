"""Encoding and decoding against the sentencepiece library."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from churnscope.llm import piece_bpe as B

SF_SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(B.MODEL)
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
MODEL = B.load_model(PATH)
ODD = ["", " ", "   ", " a", "a ", "  Hello   wörld\t\n x  ", "Åﬁ①▁x ▁", "日本語のテキスト。" * 30, "aaaaaaaaaaaaaaaaaaaaa", "\x00\x01 <s> </s> <unk> <0x41>", "😀👍🏽 é", " " * 700, ("ab " + " " * 37) * 9, "x" * 3000, "abcabc" * 400]


def same(texts):
    ours = B.encode(MODEL, texts)
    assert ours == [LIB.encode(t) for t in texts]
    assert [B.decode(MODEL, i) for i in ours] == [LIB.decode(i) for i in ours]


def test_odd_texts():
    same(ODD)


@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" ▁aeinorst.,\n"), st.characters(exclude_categories=["Cs"]))), max_size=5))
@settings(deadline=None, max_examples=300)
def test_random_texts(texts):
    same(texts)


@given(st.lists(st.integers(0, 31_999).flatmap(lambda i: st.sampled_from([i, i % 300])), max_size=12))
@settings(deadline=None, max_examples=300)
def test_decode_any_ids(ids):
    assert B.decode(MODEL, ids) == LIB.decode(ids)


def test_heap_equals_rounds(monkeypatch):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("aeinst▁"), 60)) for _ in range(200)]
    want = B.merge_words(MODEL, words)
    monkeypatch.setattr(B, "MAX_ROUNDS", 2)
    assert B.merge_words(MODEL, words) == want


def test_query(spark):
    from churnscope.llm.registry import queries

    got = {r.doc_id: r for r in queries()["op7_piece_bpe"](spark, SF_SMALL).collect()}
    for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect():
        ids = LIB.encode(r.text or "")
        own = got[r.doc_id]
        assert own.n_tokens == len(ids)
        assert own.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert own.decoded_sha256 == hashlib.sha256(LIB.decode(ids).encode()).hexdigest()


def test_odd_rows(spark):
    schema = "doc_id long, text string, ids string, n_tokens string"
    rows = [(1, None, "x", None), (1, "", None, "y"), (None, "a b", None, None), (2**60 + 1, "a  b", None, None), (5, "é" * 20_000, None, None)]
    got = B.encode_documents(spark.createDataFrame(rows, schema), PATH, with_ids=True).collect()
    assert sorted(map(repr, [(i, t and LIB.encode(t) or []) for i, t, *_ in rows])) == sorted(repr((r.doc_id, r.ids)) for r in got)
    assert B.encode_documents(spark.createDataFrame([], schema), PATH).collect() == []


def test_other_models_are_refused(tmp_path):
    bad = tmp_path / "m"
    bad.write_bytes(b"\x12\x02\x18\x01\x1a\x00")
    with pytest.raises(ValueError):
        B.load_model(str(bad))
