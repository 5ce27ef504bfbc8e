"""Cross-tokenizer alignment against nested loops over the public libraries' tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from churnscope.llm import token_align as t

A, B = public_tokenizers.path(t.A_FILE), public_tokenizers.path(t.B_FILE)


@pytest.fixture(scope="module")
def libraries():
    a = tokenizers.Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def intervals(sizes):
    out, at = [], 0
    for n in sizes:
        out.append((at, at + n))
        at += n
    return out


def one(libraries, text):
    """(a ids, b ids, groups as text, number of groups, links) of a text."""
    a_model, b_model = libraries
    letters, words = t._byte_letters(), {i: w for w, i in a_model.get_vocab().items()}
    a, b = (a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)) if text else ([], [])
    a_bytes = [bytes(letters[c] for c in words[i]) for i in a]
    b_bytes = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not text or not (b"".join(a_bytes) == (" " + text).encode() == b"".join(b_bytes)):
        return [], [], "", 0, []
    x, y = intervals(map(len, a_bytes)), intervals(map(len, b_bytes))
    cuts = sorted({e for _, e in x} & {e for _, e in y})
    written, i, j = [], 0, 0
    for cut in cuts:
        i2, j2 = i, j
        while i2 < len(x) and x[i2][1] <= cut:
            i2 += 1
        while j2 < len(y) and y[j2][1] <= cut:
            j2 += 1
        written.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
        i, j = i2, j2
    links = [(p, q) for p in range(len(x)) for q in range(len(y)) if x[p][0] < y[q][1] and y[q][0] < x[p][1]]
    return a, b, ";".join(written), len(cuts), links


def plain(libraries, rows):
    made = [one(libraries, text) for _, text in rows]
    pairs = [[(a[p], b[q]) for p, q in links] for a, b, _, _, links in made]
    count = Counter(p for own in pairs for p in set(own))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = [(doc_id, len(a), len(b), n, len(links), sum(count[p] == best[p[0]] for p in own), sum(count[p] for p in own), hashlib.sha256(g.encode()).hexdigest() if g else "")
           for (doc_id, _), (a, b, g, n, links), own in zip(rows, made, pairs)]
    return sorted(out, key=repr)


def found(spark, rows):
    return sorted(map(tuple, t.link_counts(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()), key=repr)


TEXTS = [None, "", " ", "  two  spaces ", "plain words here", "plain words here", "naïve café – “quotes” ", "日本語のテキスト と english", "emoji 👩‍👩‍👧‍👦 zwj", "a▁b has the space symbol",
         "<|endoftext|> <s> </s> <unk> <0x41>", "tabs\tand\nlines\r\n\n\n", "\x00\x01 control", "don't we'll 1234567 x1y2", "antidisestablishmentarianism" * 20, "é", "﻿bom", "﷽ ﬁ ligature Å Å"]


def test_texts_of_all_kinds(spark, libraries):
    rows = [(i, text) for i, text in enumerate(TEXTS)] + [(None, "plain words here"), (4, "plain other words")]
    assert found(spark, rows) == plain(libraries, rows)


def test_random_texts(spark, libraries):
    rng = random.Random(5)
    letters = "ab  cdeéß\n1.,'日👍"
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(80)))) for i in range(300)]
    assert found(spark, rows) == plain(libraries, rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, ""), (2, "▁")]])
def test_tables_without_tokens(spark, libraries, rows):
    assert found(spark, rows) == plain(libraries, rows)


def test_many_small_blocks(spark, libraries, monkeypatch):
    monkeypatch.setattr(t, "BLOCK", 400)
    monkeypatch.setattr(t, "TOGETHER", 150)
    rows = [(i, f"the common passage {i % 9} " * (i % 4)) for i in range(60)]
    assert found(spark, rows) == plain(libraries, rows)


def test_long_texts_use_the_plain_library(spark, libraries):
    with open(A, "rb") as a, open(B, "rb") as b:
        c = t.Coder(a.read(), b.read())
    assert c.a_fast is not None
    long = "word and\n\n" * 12_000 + "\n" * 5000
    assert len(long) > t.LONG
    assert c.encode([long])[0] == [libraries[0].encode(" " + long, add_special_tokens=False).ids]


def test_spans_and_links(spark, libraries):
    docs = spark.createDataFrame([(i, x, 1, 2) for i, x in enumerate(TEXTS)], "doc_id long, text string, block int, keys int")
    for r in t.align_documents(docs, A, B).collect():
        a, b, written, n, links = one(libraries, TEXTS[r["doc_id"]])
        assert (r["a_ids"], r["b_ids"], len(r["group_ends"])) == (a, b, n)
        assert [(x["a"], x["b"]) for x in r["links"]] == links
        assert not a or r["group_ends"][-1] == len((" " + TEXTS[r["doc_id"]]).encode())


def test_align_of_series():
    got = t.align(np.array([2, 3, 7]), np.array([3, 5, 7]))
    assert got["order"].tolist() == [0, 3, 1, 2, 4, 5]
    assert got["group"].tolist() == [0, 0, 0, 1, 1, 1]
    assert list(zip(got["a"].tolist(), got["b"].tolist())) == [(0, 0), (1, 0), (2, 1), (2, 2)]
