"""The n-gram vocabulary against plain counting."""

import math
from collections import Counter

from churnscope.operators import tfidf as T


def test_vocabulary_equals_plain_counting(spark):
    texts = ["Banana bandana", "an", "", "éÉ naïve\nlines", "a", "banana " * 50, "日本語日本"]
    rows = list(enumerate(texts))
    counts = T.ngram_counts(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    tf, df = Counter(), Counter()
    for _, text in rows:
        own = Counter(text.lower()[i : i + n] for n in (2, 3, 4) for i in range(len(text) - n + 1))
        tf.update(own)
        df.update(own.keys())
    want = sorted(tf, key=lambda t: (-tf[t], t.encode()))[:40]
    got = T.vocabulary(counts, 40).orderBy("rank").collect()
    assert [(r.term, r.tf, r.df, r["rank"]) for r in got] == [(t, tf[t], df[t], k) for k, t in enumerate(want, 1)]


def _rows(spark):
    """Repeated and null ids, a null text, characters beyond 16 bits, a literal question mark."""
    rows = [(1, "Banana bandana", 1), (1, "banana", 1), (2, "a😀b ?b 😀", 1), (None, "an", 1), (None, "anan", 1), (3, None, 1), (4, "", 1), (5, "x", 1),
            (6, "日本語日本" * 40, 3)]
    return spark.createDataFrame(rows, "id long, text string, mult int")


def test_totals_equal_counts_by_id(spark):
    texts = _rows(spark)
    want = T.vocabulary(T.ngram_counts(texts, "id", "text", "mult"), 10**6).collect()
    assert T.vocabulary(T.term_totals(texts, "id", "text", "mult"), 10**6).collect() == want and len(want) > 50


def test_totals_are_handed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(T, "TOGETHER", 5)
    monkeypatch.setattr(T, "HELD", 10)
    texts = _rows(spark).coalesce(1)
    want = T.vocabulary(T.ngram_counts(texts, "id", "text"), 10**6).collect()
    assert T.vocabulary(T.term_totals(texts, "id", "text"), 10**6).collect() == want


def test_vectors_hold_the_vocabulary_only(spark):
    texts = _rows(spark)
    vocab = T.held(T.vocabulary(T.term_totals(texts, "id", "text"), 30))
    counts = T.ngram_counts(texts, "id", "text").join(vocab, "term").select("id", "rank", "cnt").collect()
    got = T.term_vectors(texts, vocab, "id", "text")
    assert sorted(((r.id, x.rank, x.cnt) for r in got.collect() for x in r.v), key=repr) == sorted(map(tuple, counts), key=repr)
    df = {r.term: r.df for r in vocab.collect()}
    raw = {}
    for r in T.ngram_counts(texts, "id", "text").collect():
        if r.term in df:
            raw.setdefault(r.id, {})[r.term] = r.cnt * (math.log(7 / (1 + df[r.term])) + 1)
    for r in T.tfidf_vectors(got, vocab, 6).collect():
        norm = math.sqrt(sum(w * w for w in raw.get(r.id, {}).values()))
        assert {x.term: round(x.w, 12) for x in r.v} == {t: round(w / norm, 12) for t, w in raw.get(r.id, {}).items()}
        assert [x.rank for x in r.v] == sorted(x.rank for x in r.v)


def test_one_vocabulary_for_texts_of_any_alphabet(spark):
    """A task's characters may outnumber what a key tells apart."""
    texts = spark.createDataFrame([(i, "".join(map(chr, range(0x4E00 + 300 * i, 0x4E00 + 300 * i + 300)))) for i in (0, 1, 1, 2)], "id long, text string").coalesce(1)
    bits, T.BITS = T.BITS, 9
    try:
        got = T.vocabulary(T.term_totals(texts, "id", "text"), 10**6).collect()
    finally:
        T.BITS = bits
    assert got == T.vocabulary(T.ngram_counts(texts, "id", "text"), 10**6).collect()


def test_one_pass_gives_sums_and_first_vectors(spark):
    texts = _rows(spark)
    vocab = T.held(T.vocabulary(T.term_totals(texts, "id", "text"), 30))
    counts = T.term_vectors(texts, vocab, "id", "text")
    sums = {r.id: r.s for r in T.row_sums(T.tfidf_vectors(counts, vocab, 6)).collect()}
    first = {r.id: [(x.rank, x.term, round(x.w, 12)) for x in r.v] for r in T.tfidf_vectors(counts, vocab.where("rank <= 7"), 6).collect()}
    got = T.sums_and_vectors(texts, vocab, 6, 7, "id", "text").collect()
    assert {r.id: round(r.s, 12) for r in got} == {k: round(s, 12) for k, s in sums.items()} and len(got) == len(sums)
    assert {r.id: [(x.rank, x.term, round(x.w, 12)) for x in r.v] for r in got} == first


def test_centroid_similarity_equals_plain_cosine(spark):
    rows = {1: {1: 0.6, 3: 0.8}, 2: {2: 1.0}, 3: {}, None: {1: 1.0}}
    vectors = spark.createDataFrame([(k, [(r, f"t{r}", w) for r, w in v.items()]) for k, v in rows.items()], "id long, v array<struct<rank: int, term: string, w: double>>")
    ids = spark.createDataFrame([(1,), (2,), (2,), (3,), (4,), (None,)], "id long")
    mean = {r: sum(v.get(r, 0.0) for v in rows.values()) / 6 for r in (1, 2, 3)}
    cn = math.sqrt(sum(c * c for c in mean.values()))

    def score(v):
        return (sum(w * mean[r] for r, w in v.items()) / ((math.sqrt(sum(w * w for w in v.values())) + 1e-8) * (cn + 1e-8)) + 1) / 2

    want = sorted((str(k), round(score(rows.get(k, {}) if k else {}), 12)) for k in (1, 2, 2, 3, 4, None))
    assert sorted((str(r.id), round(r.semantic_score, 12)) for r in T.centroid_similarity(ids, vectors).collect()) == want
    assert T.centroid_similarity(ids.limit(1), vectors).first().semantic_score == 1.0


def test_policy_texts_joined_of_clean_parts_are_clean(spark):
    from churnscope.operators import policy as PO

    rows = [(1, "  a title", "Some\n text  here", "", ""), (2, "nan", "none", "x", ""), (3, None, "null", "", "b  c"), (4, "t", None, "Manager", None)]
    df = spark.createDataFrame(rows, "policy_id long, title string, content string, roles string, source string")
    columns = {"title": "title", "content": "content", "role": "roles", "source": "source"}
    base = PO.policy_base(df, columns)
    got = {r.policy_id: (r.full_text, r.semantic_text.split()[: len(r.full_text.split())]) for r in base.collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "a title Some text here", 2: "", 3: "", 4: "t"}
    assert {k: " ".join(v[1]) for k, v in got.items() if v[0]} == {1: "a title a title Some", 4: "t"}
