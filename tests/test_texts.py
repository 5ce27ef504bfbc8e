"""The pass over long texts against the expressions of functions.text, and n-grams counted many documents at a time."""

import random

from pyspark.sql import functions as F

from churnscope.functions import text as T
from churnscope.operators import policy as PO
from churnscope.operators import texts as X
from churnscope.operators import tfidf as TF

ODD = [None, "", "  nan ", "NaT", "none of these", "a　b  c\x1c\x85d ", "​zero width", "ÉÀ 日本 語\U00020000x-Y_9", "aaaa the aa", "der die und  the\tthe", "null\n", " \x00x "]
GROUPS = [["the", "aa"], ["und"], ["日本", "é", "É"]]


def test_facts_equal_expressions(spark):
    rows = [(i, title, text, i % 3 == 0) for i, (title, text) in enumerate((a, b) for a in ("", "a title") for b in ODD)]
    df = spark.createDataFrame(rows, "id int, title string, content string, asked boolean")
    for given in (False, True):
        full = T.clean_text("content") if given else F.trim(F.concat_ws(" ", "title", "body"))
        want = df.withColumn("body", T.clean_text("content")).withColumn("own", full)
        want = want.select("id", "body", F.when(F.lit(given), F.col("own")).alias("full"), F.when(F.col("asked"), T.normalize_cleaned("own")).alias("norm"),
                           F.array(*[T.keyword_count(F.col("own"), g) for g in GROUPS]).alias("counts"))
        got = df.withColumn("f", X.text_facts(F.col("title"), F.col("content"), F.col("content") if given else None, F.col("asked"), GROUPS)).select("id", "f.*")
        assert sorted(got.collect()) == sorted(want.collect())


def test_base_reads_long_texts_once(spark):
    df = spark.createDataFrame([(1, "t", "some text", "")], "policy_id long, title string, content string, roles string")
    plan = PO.policy_base(df, {"title": "title", "content": "content", "role": "roles"})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "replace(full_text" not in plan and "regexp_replace(full_text" not in plan


def test_many_documents_are_counted_together(spark, monkeypatch):
    """Batches of documents, long documents of several texts among them, with an alphabet that leaves few bits for their numbers."""
    rng = random.Random(4)
    letters = [chr(c) for c in (*range(97, 110), 0x1F600, ord("?"), 0x65E5, 0)] + [chr(0x4E00 + i) for i in range(400)]
    rows = [(rng.choice([None, *range(40)]), "".join(rng.choices(letters[: rng.choice([6, 17, 400])], k=rng.choice([0, 1, 3, 30, 300])))) for _ in range(200)]
    texts = spark.createDataFrame(rows, "id int, text string").withColumn("mult", F.coalesce(F.col("id") % 3 + 1, F.lit(1)).cast("int")).coalesce(1)
    want = TF.vocabulary(TF.ngram_counts(texts, "id", "text", "mult"), 10**6).collect()
    for together, bits in ((400, 16), (5000, 16), (10**6, 16), (5000, 9)):
        monkeypatch.setattr(TF, "TOGETHER", together)
        monkeypatch.setattr(TF, "BITS", bits)
        assert TF.vocabulary(TF.term_totals(texts, "id", "text", "mult"), 10**6).collect() == want
        vocab = TF.held(spark.createDataFrame(want[:300]))
        counts = TF.ngram_counts(texts, "id", "text").join(vocab, "term").select("id", "rank", "cnt").collect()
        got = TF.term_vectors(texts, vocab, "id", "text")
        assert sorted(((r.id, x.rank, x.cnt) for r in got.collect() for x in r.v), key=repr) == sorted(map(tuple, counts), key=repr)


def test_clean_and_norm_equal_plain_forms():
    rng = random.Random(7)
    chars = [chr(c) for c in range(0x110000) if chr(c).isspace()] + list("ab Z09_é^一龥A\x00​İ\U00020000\xad \n")
    for text in ["".join(rng.choices(chars, k=rng.choice([0, 1, 3, 30]))) for _ in range(3000)] + [*filter(None, ODD), "a  b   c    d ", "\n\na \n b\n"]:
        want = " ".join(text.split())
        assert X._clean(text) == ("" if want.lower() in X._NULLS else want)
        assert X._norm(text) == X._NON_IDENT.sub("", text).lower()


def test_prepared_columns_that_are_kept_alone(spark):
    """The prepared table holds what the caller reads, with the same values; texts that nobody reads are not even cached."""
    from churnscope.plans import policy_queries as Q

    every = ["policy_id", "title", "content", "full_text", "semantic_text", "policy_body", "policy_hotness", "semantic_score", "embedding", "policy_score", "target_role_labels"]
    key = lambda r: repr([str(x) for x in r])
    rows = Q.prepared(spark, "/root/testdata/sf0.001").select(*every).collect()
    for keep in (["policy_id", "policy_hotness"], [*Q.ROLE_SCORES[:1], "policy_score"], ["semantic_text", "policy_id"], ["content", "embedding"]):
        got = Q.prepared(spark, "/root/testdata/sf0.001", *keep)
        assert got.columns == keep
        short = lambda r: key([round(x, 9) if isinstance(x, float) else [(e.rank, e.term, round(e.w, 9)) for e in x] if c == "embedding" and x else x for c, x in zip(keep, r)])
        assert sorted(map(short, got.collect())) == sorted(short([r[c] for c in keep]) for r in rows)


def test_held_vocabulary_needs_no_worker(spark):
    vocab = TF.held(spark.createDataFrame([("an", 3, 2, 1)], "term string, tf long, df long, rank int"))
    assert vocab.collect() == [("an", 3, 2, 1)] and "LocalTableScan" in vocab._jdf.queryExecution().executedPlan().toString()
    assert vocab.columns == ["term", "tf", "df", "rank"] and TF.held(vocab.limit(0)).collect() == []
