"""The pipeline against a plain version of its stages."""

from collections import Counter

import numpy as np

import corpus_pipeline as P
from churnscope.llm import language_id, quality
from churnscope.llm.packing import best_fit, cluster_of

DIR = "/root/testdata/sf0.01"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < P.WORDS else {tuple(w[i : i + P.WORDS]) for i in range(len(w) - P.WORDS + 1)}


def test_stages_in_order_equal_plain_version(spark):
    assert [n for n, _ in P.STAGES] == ["quality", "language", "near_duplicates", "packing"]
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    model = quality.learn(docs.select("doc_id", "text"), labels.select("doc_id", "quality"), P.F.lit(True))
    x = np.stack([quality.features(r.text) for r in rows])
    score = quality._logits(model["weights"], quality._binned(x, model["edges"]))
    rows = [r for r, s in zip(rows, score) if s >= 0]
    good = spark.createDataFrame(rows, docs.schema)
    assert sorted(good.collect()) == sorted(P.keep_good(spark, docs, DIR).collect())

    model = language_id.learn(good.select("doc_id", "text", "lang"), P.F.lit(True))
    told = language_id.decide(model, *language_id.score_texts(model, [r.text for r in rows]))
    rows = [r for r, bad in zip(rows, told["rejected"]) if not bad]
    spoken = spark.createDataFrame(rows, docs.schema)
    assert sorted(spoken.collect()) == sorted(P.keep_language(spark, good, DIR).collect())

    sets = [shingles(r.text) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    rows = [r for i, r in enumerate(rows) if group[i] == i]
    single = spark.createDataFrame(rows, docs.schema)
    assert sorted(single.collect()) == sorted(P.drop_near_duplicates(spark, spoken, DIR).collect())

    packed = P.pack_sequences(spark, single, DIR).collect()
    words = Counter({r.doc_id: len((r.text or "").encode().split()) for r in rows})
    got = Counter()
    for r in packed:
        got[r.doc_id] += r.n_words
    assert got == words and packed[0].__fields__ == ["doc_id", "piece", "n_words", "bin", "bin_offset", "source"]
    copies = {r.doc_id: r.c for r in single.select("doc_id", cluster_of(P.F.col("text")).alias("c")).collect()}
    pieces = sorted((-r.n_words, r.doc_id, r.piece, r.source, r.bin, r.bin_offset) for r in packed if r.bin is not None)
    into, offset = best_fit([(-n, s, copies[d]) for n, d, _, s, _, _ in pieces], 2048)
    assert [(b, o) for *_, b, o in pieces] == list(zip(into, offset))  # one shard: bins are numbered from 0

    whole = sorted(map(tuple, P.run(spark, DIR).collect()), key=repr)
    assert whole == sorted(map(tuple, packed), key=repr)


def test_near_duplicates_go_by_row(spark):
    rng = np.random.default_rng(3)
    a, b, c = (" ".join(f"{x}{i}" for i in rng.integers(0, 10**6, 80)) for x in "abc")
    rows = [(5, a)] * 4 + [(None, c)] * 3 + [(2, b), (7, b + " end"), (7, a.upper()), (7, "a clean text of its own here"), (9, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    got = P.drop_near_duplicates(spark, docs.repartition(3), DIR)
    assert got.columns == docs.columns
    want = [(5, a), (None, c), (2, b), (7, "a clean text of its own here"), (9, None), (9, "")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns and out.collect() == []
    assert P.pack_sequences(spark, docs, DIR).collect() == []


def test_odd_rows_and_clashing_columns(spark):
    base = spark.read.parquet(f"{DIR}/documents.parquet").limit(300).withColumn("kept", P.F.lit("k")).withColumn("score", P.F.lit(1)).withColumn("predicted", P.F.lit("p"))
    odd = [(9001, None, None, None, None, "a", 1, "b"), (None, "the text without an id of the table", "en", None, 3, "a", 1, "b"), (9002, "", "en", "s", 0, "a", 2, "b")]
    docs = base.unionByName(spark.createDataFrame(odd, base.schema)).union(base.limit(1))
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert P.pack_sequences(spark, docs, DIR).count() >= docs.count() > 200
