"""Scalar text expressions on literal cases (unicode, CJK, separators)."""

from churnscope.functions import text as T


def _one(spark, expr, value):
    return spark.createDataFrame([(value,)], "s string").select(expr("s").alias("o")).first()["o"]


def test_normalize_identifier_cjk(spark):
    assert _one(spark, T.normalize_identifier, "Research & Dev 研发-部") == "researchdev研发部"
    assert T.normalize_identifier_py("Research & Dev 研发-部") == "researchdev研发部"


def test_clean_text_null_tokens_and_whitespace(spark):
    assert _one(spark, T.clean_text, "  a \t\n b  ") == "a b"
    assert _one(spark, T.clean_text, None) == ""


def test_split_multi_value_separators(spark):
    # whitespace (newline included) is collapsed BEFORE splitting, so "\n" never separates
    got = _one(spark, T.split_multi_value, "a，b,c、d/e|f；g;h\ni")
    assert got == ["a", "b", "c", "d", "e", "f", "g", "h i"]
    assert _one(spark, T.split_multi_value, " ,, ") == [",,"]


def test_char_ngrams_whole_text(spark):
    got = _one(spark, lambda c: T.char_ngrams(c, 2, 3), "abcd")
    assert got == ["ab", "bc", "cd", "abc", "bcd"]
    assert _one(spark, lambda c: T.char_ngrams(c, 2, 4), "a") == []


def test_normalize_identifier_over_all_characters(spark):
    from pyspark.sql import functions as F
    rows = [(k, "".join(map(chr, [c for c in range(k, k + 4096) if not 0xD800 <= c < 0xE000]))) for k in range(0, 0x30000, 4096)]
    d = spark.createDataFrame(rows, "k int, t string")
    plain = F.lower(F.regexp_replace(T.clean_text("t"), T.NON_IDENT_JAVA, ""))
    assert d.where(T.normalize_identifier("t") != plain).count() == 0
    pattern = "".join(T.NON_IDENT_PARTS)
    assert "[^" not in pattern  # negated classes cost about ten times as much


def test_clean_text_over_all_characters(spark):
    """Two quick steps for whitespace give what one class of all whitespace gives."""
    rows = [(k, "".join(f" {chr(c)}x{chr(c)}{chr(c)} " for c in range(k, k + 4096) if not 0xD800 <= c < 0xE000)) for k in range(0, 0x20000, 4096)]
    got = spark.createDataFrame(rows, "k int, t string").select("t", T.clean_text("t").alias("c"), T.normalize_identifier("t").alias("n"),
                                                                T.normalize_cleaned(T.clean_text("t")).alias("m")).collect()
    assert all(r.c == " ".join(r.t.split()) and r.n == r.m for r in got)
    pattern = T.WS_NARROW_RUN_JAVA
    assert "x{" not in pattern  # only characters of 8 bits: a plain bit set in the regex engine
