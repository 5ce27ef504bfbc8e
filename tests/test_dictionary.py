"""Dictionary tables against the literal maps and against a plain scan of 50,000 aliases."""

import random

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from churnscope.functions import params as P
from churnscope.functions import text as T
from churnscope.operators import dictionary as D
from churnscope.operators import matching as MT
from churnscope.operators import policy as PO
from churnscope.sources import fixtures as FX

GROUPS = {"Research & Dev": ["R&D", "rd", "laboratory work"], "Sales": ["sales", "Vertrieb", "key account manager of the region north"],
          "研发部": ["研发"], "Human Resources": ["HR", "people team", "sales"], "Lab": ["laboratory"], "Ops": []}
TEXTS = ["the laboratory works", "HR", "hr and sales", "", None, "研发部门", "rd", "key account manager of the region", "people  TEAM; ops",
         "we have a Key-Account manager, of the region: north", "hr", "nan", "sales", "sales", "x" * 5000 + "laboratory work"]
FIELDS = ["R&D, hr / Unknown role", "", None, "研发", "***", "Sales", "sales;Sales", "  ", "ops|Lab", "", "", "", "", None, ""]


def _table(spark, groups):
    rows = [(c, a, i) for i, (c, a) in enumerate(groups.items())]
    return D.alias_table(spark.createDataFrame(rows, "canonical string, aliases array<string>, ord long"))


@pytest.fixture(scope="module")
def rows(spark):
    data = [(None if i == 3 else i % 7, f, t) for i, (f, t) in enumerate(zip(FIELDS, TEXTS))]  # ids repeat, one is null
    return spark.createDataFrame(data, "id int, field string, text string").repartition(3)


def _sorted(df):
    return sorted(map(repr, df.collect()))


def test_table_equals_mapping(spark):
    got = _table(spark, GROUPS).orderBy("place").collect()
    assert [(r.alias, r.canonical) for r in got] == list(T.alias_dictionary(GROUPS).items())


def test_names_matches_and_targets_equal_the_literal_maps(spark, rows):
    table = _table(spark, GROUPS)
    norm = T.normalize_identifier("text")
    for f in (lambda d: D.with_canonical(rows, F.col("field"), d, "o"), lambda d: D.with_canonical_key(rows, F.col("field"), d, "o"),
              lambda d: D.with_matches(rows, norm, d, "o"), lambda d: D.with_targets(rows, T.clean_text("field"), norm, d, "o")):
        got, want = f(table), f(GROUPS)
        assert got.columns == want.columns and _sorted(got) == _sorted(want)
    found = {r.text: r.o for r in D.with_matches(rows, norm, table, "o").collect()}
    assert found["the laboratory works"] == ["Research & Dev", "Lab"]
    assert found["hr and sales"] == ["Human Resources"]  # the last entry names "sales"; "hr" must equal the whole text
    assert found[None] == [] and found["HR"] == ["Human Resources"]


def test_empty_dictionary_and_empty_table(spark, rows):
    none = _table(spark, {"x": []}).where("false")
    assert all(r.o == [] for r in D.with_matches(rows, T.normalize_identifier("text"), none, "o").collect())
    assert D.with_targets(rows.limit(0), F.col("field"), F.col("text"), _table(spark, GROUPS), "o").collect() == []


@pytest.mark.parametrize("threshold", ["-1", str(10 << 20)])
def test_fifty_thousand_aliases(spark, threshold):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choices("abcdefgh", k=rnd.randrange(3, 40)))
    names = list(dict.fromkeys(word() for _ in range(55_000)))[:50_000]
    texts = ["".join(rnd.choices("abcdefgh", k=60)) + "".join(rnd.sample(names, 3)) for _ in range(40)]
    groups = spark.createDataFrame([(x, None, i) for i, x in enumerate(names)], "canonical string, aliases array<string>, ord long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)  # with and without a broadcast
    try:
        got = D.with_matches(spark.createDataFrame([(t,) for t in texts], "t string"), F.col("t"), D.alias_table(groups), "o").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {r.t: r.o for r in got} == {t: [x for x in names if x in t] for t in texts}


def test_operators_take_tables_and_mappings(spark):
    names = FX.table(spark, SF_SMALL, "nation").select(F.col("n_name").alias("canonical"), F.lit(None).cast("array<string>").alias("aliases"), F.lit(0).alias("ord"))
    small, large = D.load(names), D.load(names, literal=10)
    assert isinstance(small, dict) and not isinstance(large, dict)
    base = lambda d: PO.policy_base(FX.policies(spark, SF_SMALL), FX.POLICY_FIXTURE_COLUMNS, role_aliases=d, dept_aliases=d)
    wanted = ["policy_id", "target_role_labels", "target_role_keys", "target_department_labels", "target_department_keys", "semantic_text"]
    assert _sorted(base(large).select(wanted)) == _sorted(base(small).select(wanted))
    staff = FX.workforce(spark, SF_SMALL)
    keys = lambda d: MT.employee_profiles(staff, P.FIXTURE_TOPICS, d, d).select("id", "JobRoleKey", "DepartmentKey")
    assert _sorted(keys(large)) == _sorted(keys(small))
