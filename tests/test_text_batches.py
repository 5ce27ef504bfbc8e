"""Long texts reach Python workers in small batches, also where a session allows large ones."""

from pyspark.sql import functions as F

from churnscope.operators import policy as PO
from churnscope.session import TEXT_BATCHES, text_batches


def _sizes(df):
    def run(batches):
        for b in batches:
            yield b.slice(0, 1).select([0]).from_pydict({"n": [b.num_rows], "size": [b.nbytes]})

    return df.mapInArrow(run, "n long, size long").collect()


def test_batches_are_bounded_by_rows_and_bytes(spark):
    short = spark.range(5000, numPartitions=1)
    long = spark.range(400, numPartitions=1).select(F.repeat(F.lit("x"), 50_000).alias("t"))
    before = {k: spark.conf.get(k, None) for k in TEXT_BATCHES}
    with text_batches(spark):
        assert max(r.n for r in _sizes(short)) <= 1000
        sizes = _sizes(long)
    assert sum(r.n for r in sizes) == 400 and max(r["size"] for r in sizes) <= 3 << 20
    assert {k: spark.conf.get(k, None) for k in TEXT_BATCHES} == before


def test_policies_are_prepared_in_small_batches(spark, monkeypatch):
    seen, totals = [], PO.TF.term_totals

    def spied(*a, **b):
        seen.append({k: spark.conf.get(k) for k in TEXT_BATCHES})
        return totals(*a, **b)

    monkeypatch.setattr(PO.TF, "term_totals", spied)
    df = spark.createDataFrame([(i, f"policy {i}", f"text {i} about pay") for i in range(5)], "policy_id long, title string, content string")
    got = PO.prepare_policies(df, {"title": "title", "content": "content"}, keep=("policy_id", "policy_score")).collect()
    assert sorted(r.policy_id for r in got) == list(range(5)) and seen == [TEXT_BATCHES]
