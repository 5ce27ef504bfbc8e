"""Driver queries for policy text analytics, macro index and employee-policy matching
(SURVEY §2.B text operators, §2.J, §2.K, E18-E19, D2-D5)."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from ..functions import params as P
from ..functions import text as T
from ..operators import dictionary as D
from ..operators import features as FE
from ..operators import matching as MT
from ..operators import policy as PO
from ..operators import tfidf as TF
from ..session import cut_lineage
from ..sources import fixtures as FX

SPARK: dict = {}
SQL: dict[str, str] = {}
#: What the role statistics read of the prepared policies.
ROLE_SCORES = ("target_role_labels", "target_role_keys", "policy_score")


def q(name: str, sql: str | None = None):
    def deco(fn):
        SPARK[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def _dicts(spark, sf):
    return FX.fixture_role_aliases(spark, sf), FX.fixture_department_aliases(spark, sf)


def _kw(spark, sf):
    ra, da = _dicts(spark, sf)
    return dict(topics=P.FIXTURE_TOPICS, positive=P.FIXTURE_POSITIVE, negative=P.FIXTURE_NEGATIVE,
                role_aliases=ra, dept_aliases=da)


def base_policies(spark, sf):
    return PO.policy_base(FX.policies(spark, sf), FX.POLICY_FIXTURE_COLUMNS, **_kw(spark, sf))


def prepared(spark, sf, *keep):
    """The prepared policies, those columns only that a query reads."""
    return PO.prepare_policies(FX.policies(spark, sf), FX.POLICY_FIXTURE_COLUMNS, keep=keep or None, **_kw(spark, sf))


def employees(spark, sf):
    from ..operators import normalize as N
    return FE.add_interaction_features(N.normalize_workforce(FX.workforce(spark, sf)))


# ------------------------------------------------------------------- A2 ----

@q("scan_policies", f"SELECT * FROM ({FX.POLICIES_SQL}) AS policies")
def scan_policies(spark, sf):
    """A2: the policy table (every document, whole text) with its explicit schema."""
    return FX.policies(spark, sf)


# ------------------------------------------------------------ text operators

_CLEAN_SQL = f"""(SELECT doc_id, CASE WHEN regexp_matches(t, '^(?i:nan|none|null|nat)$') THEN '' ELSE t END AS clean
  FROM (SELECT doc_id, trim(regexp_replace(COALESCE(text, ''), '{T.WS_RUN_RE2}', ' ', 'g')) AS t FROM documents))"""


@q("clean_text", f"SELECT doc_id, clean FROM {_CLEAN_SQL} AS c")
def clean_text(spark, sf):
    d = FX.table(spark, sf, "documents")
    return d.select("doc_id", T.clean_text("text").alias("clean"))


@q("normalize_identifier",
   f"SELECT doc_id, lower(regexp_replace(clean, '{T.NON_IDENT_RE2}', '', 'g')) AS ident FROM {_CLEAN_SQL} AS c")
def normalize_identifier(spark, sf):
    d = FX.table(spark, sf, "documents")
    return d.select("doc_id", T.normalize_identifier("text").alias("ident"))


def _clean_sql(x: str) -> str:
    t = f"trim(regexp_replace(COALESCE({x}, ''), '{T.WS_RUN_RE2}', ' ', 'g'))"
    return f"(CASE WHEN regexp_matches({t}, '^(?i:nan|none|null|nat)$') THEN '' ELSE {t} END)"


def _split_sql(col: str) -> str:
    v = _clean_sql(col)
    parts = (f"list_filter(list_transform(regexp_split_to_array({v}, '{T.MULTI_VALUE_SPLIT}'), lambda x: {_clean_sql('x')}),"
             f" lambda x: x <> '')")
    return (f"(CASE WHEN {v} = '' THEN CAST([] AS VARCHAR[]) WHEN len({parts}) = 0 THEN [{v}] ELSE {parts} END)")


@q("split_multi_value", f"""WITH p AS ({FX.POLICIES_SQL})
SELECT policy_id, {_split_sql('roles')} AS role_parts, {_split_sql('departments')} AS department_parts FROM p""")
def split_multi_value(spark, sf):
    p = FX.policies(spark, sf)
    return p.select("policy_id", T.split_multi_value("roles").alias("role_parts"),
                    T.split_multi_value("departments").alias("department_parts"))


def _dedupe_sql(arr: str) -> str:
    c = f"list_filter(list_transform({arr}, lambda x: {_clean_sql('x')}), lambda x: x <> '')"
    return f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"  # first occurrence only


@q("dedupe_keep_order", f"""WITH p AS ({FX.POLICIES_SQL})
SELECT policy_id, {_dedupe_sql(f"list_concat({_split_sql('roles')}, {_split_sql('departments')}, {_split_sql('roles')})")} AS "values"
FROM p""")
def dedupe_keep_order(spark, sf):
    p = FX.policies(spark, sf)
    parts = F.concat(T.split_multi_value("roles"), T.split_multi_value("departments"), T.split_multi_value("roles"))
    return p.select("policy_id", T.dedupe_keep_order(parts).alias("values"))


def _norm_sql(x: str) -> str:
    return f"lower(regexp_replace({_clean_sql(x)}, '{T.NON_IDENT_RE2}', '', 'g'))"


@q("canonical_role", f"""WITH p AS ({FX.POLICIES_SQL}),
parts AS (SELECT policy_id, unnest({_split_sql('roles')}) AS part FROM p),
dict AS (SELECT {_norm_sql('n_name')} AS k, MAX(n_name) AS canonical FROM nation GROUP BY 1),
c AS (SELECT policy_id, part, CASE WHEN {_clean_sql('part')} = '' THEN ''
                                   ELSE COALESCE(d.canonical, {_clean_sql('part')}) END AS canonical
      FROM parts LEFT JOIN dict d ON d.k = {_norm_sql('part')})
SELECT policy_id, part, canonical, {_norm_sql('canonical')} AS role_key FROM c""")
def canonical_role(spark, sf):
    ra, _ = _dicts(spark, sf)
    p = FX.policies(spark, sf).select("policy_id", F.explode(T.split_multi_value("roles")).alias("part"))
    p = D.with_canonical(p, F.col("part"), ra, "canonical")
    return p.withColumn("role_key", T.normalize_identifier("canonical"))


def _dict_sql(name: str, source: str, column: str) -> str:
    """CTE of one row: the alias dictionary as a list of (normalised alias, canonical) in the canonical names' order."""
    return f"""{name} AS (SELECT list({{'k': k, 'v': v}} ORDER BY v) AS l FROM (SELECT DISTINCT {_norm_sql(column)} AS k, {column} AS v FROM {source}))"""


_DICTS_SQL = _dict_sql("ra", "nation", "n_name") + ",\n" + _dict_sql("da", "customer", "c_mktsegment")


def _matches_sql(norm: str, d: str) -> str:
    hit = f"CASE WHEN length(e.k) <= 2 THEN {norm} = e.k ELSE contains({norm}, e.k) END"
    return f"list_transform(list_filter({d}.l, lambda e: e.k <> '' AND {hit}), lambda e: e.v)"


@q("alias_text_match", f"""WITH {_DICTS_SQL},
t AS (SELECT doc_id, {_norm_sql('text')} AS n FROM documents)
SELECT doc_id, {_matches_sql('n', 'ra')} AS roles, {_matches_sql('n', 'da')} AS departments FROM t, ra, da""")
def alias_text_match(spark, sf):
    ra, da = _dicts(spark, sf)
    d = FX.table(spark, sf, "documents").select("doc_id", T.normalize_identifier("text").alias("_n"))
    return D.with_matches(D.with_matches(d, F.col("_n"), ra, "roles"), F.col("_n"), da, "departments").drop("_n")


def _field_sql(column: str, d: str) -> str:
    """Canonical labels of a multi-value field, in order."""
    own = f"list_filter({d}.l, lambda e: e.k = {_norm_sql('x')})[1].v"
    return f"list_filter(list_transform({_split_sql(column)}, lambda x: COALESCE({own}, {_clean_sql('x')})), lambda y: y <> '')"


def _distinct_sql(arr: str) -> str:
    return f"list_filter({arr}, lambda x, i: list_position({arr}, x) = i)"


def _keys_sql(labels: str) -> str:
    return f"list_filter(list_transform({labels}, lambda x: {_norm_sql('x')}), lambda x: x <> '')"


# policies with their full text and the labels that they aim at: the field's, else those found in the text
_TARGETS_SQL = f"""{_DICTS_SQL},
tp AS ({FX.POLICIES_SQL}),
tf AS (SELECT *, {_clean_sql("concat_ws(' ', " + _clean_sql("title") + ", " + _clean_sql("content") + ")")} AS full_text FROM tp),
tn AS (SELECT tf.*, {_norm_sql('full_text')} AS n, {_field_sql('roles', 'ra')} AS rf, {_field_sql('departments', 'da')} AS df FROM tf, ra, da),
tl AS (SELECT tn.*, CASE WHEN len(rf) > 0 THEN rf ELSE {_matches_sql('n', 'ra')} END AS r0, CASE WHEN len(df) > 0 THEN df ELSE {_matches_sql('n', 'da')} END AS d0
       FROM tn, ra, da),
tt AS (SELECT *, {_distinct_sql('r0')} AS role_labels, {_distinct_sql('d0')} AS department_labels FROM tl),
tk AS (SELECT *, {_keys_sql('role_labels')} AS rk, {_keys_sql('department_labels')} AS dk FROM tt)"""


@q("policy_targets", f"""WITH {_TARGETS_SQL}
SELECT policy_id, role_labels AS target_role_labels, {_distinct_sql('rk')} AS target_role_keys, department_labels AS target_department_labels,
       {_distinct_sql('dk')} AS target_department_keys FROM tk""")
def policy_targets(spark, sf):
    return base_policies(spark, sf).select("policy_id", "target_role_labels", "target_role_keys",
                                           "target_department_labels", "target_department_keys")


def _kw_count_sql(t: str, words) -> str:
    return " + ".join(f"FLOOR((length({t}) - length(replace({t}, '{w}', ''))) / {len(w)})" for w in words)


_FULL_SQL = _clean_sql("concat_ws(' ', " + _clean_sql("title") + ", " + _clean_sql("content") + ")")


_TOPIC_COUNTS_SQL = f"""WITH p AS ({FX.POLICIES_SQL}),
f AS (SELECT policy_id, {_FULL_SQL} AS full_text FROM p),
s AS (SELECT policy_id, {", ".join(f"CAST({_kw_count_sql('full_text', words)} AS DOUBLE) AS score_{k}"
                                   for k, (_, words) in P.FIXTURE_TOPICS.items())} FROM f),
t AS (SELECT *, {" + ".join(f"score_{k}" for k in P.FIXTURE_TOPICS)} AS total FROM s)"""


@q("topic_scores", f"""{_TOPIC_COUNTS_SQL}
SELECT policy_id, {", ".join(f"score_{k}" for k in P.FIXTURE_TOPICS)} FROM t""")
def topic_scores(spark, sf):
    b = base_policies(spark, sf)
    return b.select("policy_id", *[F.col("topic_scores")[k].alias(f"score_{k}") for k in P.FIXTURE_TOPICS])


def _topic_tags_sql() -> str:
    parts = ", ".join(f"CASE WHEN score_{k} > 0 THEN '{lab}' END" for k, (lab, _) in P.FIXTURE_TOPICS.items())
    j = f"concat_ws('{P.TOPIC_LABEL_SEP}', {parts})"
    return f"CASE WHEN {j} = '' THEN '{P.DEFAULT_TOPIC_LABEL}' ELSE {j} END"


@q("topic_tags", f"""{_TOPIC_COUNTS_SQL}
SELECT policy_id, {_topic_tags_sql()} AS policy_tags FROM t""")
def topic_tags(spark, sf):
    return base_policies(spark, sf).select("policy_id", "policy_tags")


_PIECES_SQL = ", ".join(f"CASE WHEN {_clean_sql(x)} <> '' THEN {x} END" for x in (
    "pt", "full_text", "tags", "array_to_string(role_labels, ' ')", "array_to_string(department_labels, ' ')", "ps"))
_SEMANTIC_SQL = f"""{_TOPIC_COUNTS_SQL},
{_TARGETS_SQL},
g AS (SELECT policy_id, {_topic_tags_sql()} AS tags FROM t),
sp AS (SELECT tk.policy_id, full_text, role_labels, department_labels, tags, {_clean_sql('title')} AS pt, {_clean_sql('source')} AS ps FROM tk JOIN g USING (policy_id)),
sj AS (SELECT policy_id, full_text, concat_ws(' ', {_PIECES_SQL}) AS j FROM sp),
st AS (SELECT policy_id, full_text, {_clean_sql('j')} AS semantic_text FROM sj)"""


@q("semantic_text", f"{_SEMANTIC_SQL} SELECT policy_id, full_text, semantic_text FROM st")
def semantic_text(spark, sf):
    return base_policies(spark, sf).select("policy_id", "full_text", "semantic_text")


def micro(c):
    """Whole millionths, rounded down: shares such as k/128 lie on ties of decimal rounding."""
    return F.floor(c * 1e6).cast("bigint")


@q("topic_vector", f"""{_TOPIC_COUNTS_SQL}
SELECT policy_id, {", ".join(f"CAST(FLOOR((CASE WHEN total > 0 THEN score_{k} / total ELSE score_{k} END) * 1e6) AS BIGINT) AS v_{k}" for k in P.FIXTURE_TOPICS)}
FROM t""")
def topic_vector(spark, sf):
    b = base_policies(spark, sf)
    return b.select("policy_id", *[micro(F.col("topic_vector")[i]).alias(f"v_{k}") for i, k in enumerate(P.FIXTURE_TOPICS)])


@q("topic_strength", f"""{_TOPIC_COUNTS_SQL},
m AS (SELECT policy_id, CAST({" + ".join(f"CASE WHEN score_{k} > 0 THEN 1 ELSE 0 END" for k in P.FIXTURE_TOPICS)} AS INTEGER)
               AS matched_topic_count, total AS topic_hit_total FROM t)
SELECT policy_id, matched_topic_count, topic_hit_total,
       LEAST(GREATEST((matched_topic_count * CAST(0.6 AS DOUBLE) + topic_hit_total * CAST(0.4 AS DOUBLE)) / 4.0, 0.0), 1.0)
         AS topic_strength
FROM m""")
def topic_strength(spark, sf):
    return base_policies(spark, sf).select("policy_id", "matched_topic_count", "topic_hit_total", "topic_strength")


@q("policy_sentiment", f"""WITH p AS ({FX.POLICIES_SQL}),
f AS (SELECT policy_id, {_FULL_SQL} AS full_text FROM p),
c AS (SELECT policy_id, CAST({_kw_count_sql('full_text', P.FIXTURE_POSITIVE)} AS DOUBLE) AS pos,
             CAST({_kw_count_sql('full_text', P.FIXTURE_NEGATIVE)} AS DOUBLE) AS neg FROM f)
SELECT policy_id, CASE WHEN pos = 0 AND neg = 0 THEN CAST(0.0 AS DOUBLE)
                       ELSE LEAST(GREATEST((pos - neg) / (pos + neg + 1e-8), -1.0), 1.0) END AS policy_sentiment
FROM c""")
def policy_sentiment(spark, sf):
    return base_policies(spark, sf).select("policy_id", "policy_sentiment")


@q("policy_time_weight", f"""WITH p AS ({FX.POLICIES_SQL})
SELECT policy_id, publish_date,
       CASE WHEN publish_date IS NULL THEN CAST(0.5 AS DOUBLE)
            ELSE POWER(CAST(0.5 AS DOUBLE), CAST(GREATEST(date_diff('day', publish_date, (SELECT MAX(publish_date) FROM p)), 0) AS DOUBLE)
                       / {float(max(P.TIME_DECAY_HALF_LIFE_DAYS, 1))!r}) END AS time_weight
FROM p""")
def policy_time_weight(spark, sf):
    return base_policies(spark, sf).select("policy_id", F.col("publish_time").cast("date").alias("publish_date"),
                                           "time_weight")


def _semantic_corpus(spark, sf):
    b = base_policies(spark, sf)
    return b.select(F.col("policy_id").alias("id"),
                    F.when(F.col("semantic_text") == "", P.EMPTY_TEXT).otherwise(F.col("semantic_text")).alias("text"))


@q("tfidf_vocab")
def tfidf_vocab(spark, sf):
    totals = TF.term_totals(_semantic_corpus(spark, sf), "id", "text")
    return TF.vocabulary(totals, P.HOTNESS_MAX_FEATURES).select("term", "tf", "df", "rank")


@q("tfidf_weights")
def tfidf_weights(spark, sf):
    corpus = cut_lineage(_semantic_corpus(spark, sf))  # read by both passes over the texts
    n = corpus.count()
    vocab = TF.held(TF.vocabulary(TF.term_totals(corpus, "id", "text"), P.HOTNESS_MAX_FEATURES))
    vectors = TF.tfidf_vectors(TF.term_vectors(corpus, vocab, "id", "text"), vocab, n)
    return TF.tfidf_weights(vectors).select(F.col("id").alias("policy_id"), "term", "w")


@q("policy_hotness")
def policy_hotness(spark, sf):
    return prepared(spark, sf, "policy_id", "policy_hotness")


@q("centroid_similarity_policies")
def centroid_similarity_policies(spark, sf):
    return prepared(spark, sf, "policy_id", "semantic_score")


@q("policy_score")
def policy_score(spark, sf):
    return prepared(spark, sf, "policy_id", "policy_hotness", "semantic_score", "time_weight", "topic_strength", "policy_sentiment",
                    "policy_score")


@q("prepare_policies")
def prepare_policies(spark, sf):
    return prepared(spark, sf, "policy_id", "full_text", "semantic_text", "time_weight", "target_role_keys", "target_department_keys",
                    "policy_tags", "policy_hotness", "semantic_score", "policy_score")


# ------------------------------------------------------------ embeddings

_NORM_SQL = "sqrt(list_sum(list_transform({0}, lambda v: v * v)))"


def _cosine_sql(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b}) / (({_NORM_SQL.format(a)} + 1e-8) * ({_NORM_SQL.format(b)} + 1e-8))"


def _mean_sql(by: str) -> str:
    sel, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (SELECT {sel}unnest(x) AS v, unnest(range(1, len(x) + 1)) AS pos FROM e),
m AS (SELECT {sel}pos, AVG(v) AS m FROM u GROUP BY {sel}pos),
cen AS (SELECT {sel}list(m ORDER BY pos) AS c FROM m {group})"""


@q("cosine_similarity", f"""WITH {_mean_sql('label')}
SELECT vec_id, label, ROUND({_cosine_sql('x', 'c')}, 6) AS cosine FROM e JOIN cen USING (label)""")
def cosine_similarity(spark, sf):
    e = FX.table(spark, sf, "embeddings")
    cen = TF.mean_vector(e, "embedding", ["label"])
    return (e.join(cen, "label").select("vec_id", "label",
                                        TF.cosine(F.col("embedding").cast("array<double>"), F.col("centroid"))
                                        .alias("cosine")))


@q("centroid_similarity", f"""WITH {_mean_sql('')}
SELECT vec_id, ROUND(CASE WHEN (SELECT COUNT(*) FROM e) = 1 THEN 1.0 ELSE LEAST(GREATEST(({_cosine_sql('x', 'c')} + 1.0) / 2.0, 0.0), 1.0) END, 6)
         AS semantic_score
FROM e, cen""")
def centroid_similarity(spark, sf):
    from ..functions.numeric import with_scalars
    e = FX.table(spark, sf, "embeddings")
    cen = TF.mean_vector(e, "embedding")
    n = e.select(F.count(F.lit(1))).scalar()
    j = with_scalars(e, cen)
    s = TF.cosine(F.col("embedding").cast("array<double>"), F.col("centroid"))
    score = F.when(n == 1, 1.0).otherwise(F.least(F.greatest((s + 1.0) / 2.0, F.lit(0.0)), F.lit(1.0)))
    return j.select("vec_id", score.alias("semantic_score"))


# ------------------------------------------------------------ macro index

@q("macro_index")
def macro_index(spark, sf):
    return PO.macro_index(prepared(spark, sf, *ROLE_SCORES))


@q("policy_impact_by_role")
def policy_impact_by_role(spark, sf):
    return PO.policy_impact_by_role(prepared(spark, sf, *ROLE_SCORES))


@q("macro_index_join")
def macro_index_join(spark, sf):
    ra, _ = _dicts(spark, sf)
    e = PO.join_macro_index(employees(spark, sf), prepared(spark, sf, *ROLE_SCORES), ra)
    return e.select("EmployeeNumber", "JobRoleKey", "macro_index")


@q("policy_gap")
def policy_gap(spark, sf):
    ra, _ = _dicts(spark, sf)
    e = PO.join_macro_index(employees(spark, sf), prepared(spark, sf, *ROLE_SCORES), ra)
    return PO.policy_gap(e)


# ------------------------------------------------------------ employee side

_FEAT_SQL = f"""workforce AS ({FX.WORKFORCE_SQL}),
f AS (
  SELECT *, CAST(CASE WHEN OverTime = 'Yes' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS OverTimeFlag,
         CAST(CASE BusinessTravel WHEN 'Travel_Rarely' THEN 1.0 WHEN 'Travel_Frequently' THEN 2.0 ELSE 0.0 END AS DOUBLE) AS TravelRisk,
         CAST(CASE WHEN StockOptionLevel <= 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS LowStockOptionFlag,
         CAST(CASE WHEN WorkLifeBalance <= 2 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS LowWorkLifeFlag,
         CAST(CASE WHEN JobSatisfaction <= 2 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS LowJobSatisfactionFlag,
         CAST(CASE WHEN EnvironmentSatisfaction <= 2 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS LowEnvironmentSatisfactionFlag
  FROM workforce)"""
_RATIOS = {  # column -> (numerator, denominator less one)
    "Income_per_YearAtCompany": ("MonthlyIncome", "YearsAtCompany"), "Income_per_WorkYear": ("MonthlyIncome", "TotalWorkingYears"),
    "Income_per_JobLevel": ("MonthlyIncome", "JobLevel"), "PromotionWaitRatio": ("YearsSinceLastPromotion", "YearsAtCompany"),
    "RoleStagnationRatio": ("YearsInCurrentRole", "YearsAtCompany"), "ManagerTenureRatio": ("YearsWithCurrManager", "YearsAtCompany"),
    "ExternalMobilityRatio": ("NumCompaniesWorked", "TotalWorkingYears"),
}


@q("features_flags", f"""WITH {_FEAT_SQL}
SELECT EmployeeNumber, OverTimeFlag, TravelRisk, LowStockOptionFlag, LowWorkLifeFlag, LowJobSatisfactionFlag,
       LowEnvironmentSatisfactionFlag FROM f""")
def features_flags(spark, sf):
    return employees(spark, sf).select("EmployeeNumber", "OverTimeFlag", "TravelRisk", "LowStockOptionFlag",
                                       "LowWorkLifeFlag", "LowJobSatisfactionFlag", "LowEnvironmentSatisfactionFlag")


@q("features_ratios", f"""WITH {_FEAT_SQL}
SELECT EmployeeNumber, {", ".join(f"CAST(FLOOR({a} / ({b} + 1) * 1e6) AS BIGINT) AS {k}" for k, (a, b) in _RATIOS.items())} FROM f""")
def features_ratios(spark, sf):
    return employees(spark, sf).select("EmployeeNumber", *[micro(F.col(k)).alias(k) for k in _RATIOS])


@q("features_products", f"""WITH {_FEAT_SQL}
SELECT EmployeeNumber, Age * WorkLifeBalance AS Age_WorkBalance, JobInvolvement * WorkLifeBalance AS EngagementBalanceScore,
       GREATEST(YearsInCurrentRole - YearsSinceLastPromotion, 0.0) AS PromotionRoleGap,
       DistanceFromHome * (1 + OverTimeFlag) AS DistanceOverTimePressure, TravelRisk * (1 + OverTimeFlag) AS TravelOverTimeRisk,
       LowStockOptionFlag * OverTimeFlag AS LowStockOverTimeRisk FROM f""")
def features_products(spark, sf):
    return employees(spark, sf).select("EmployeeNumber", "Age_WorkBalance", "EngagementBalanceScore",
                                       "PromotionRoleGap", "DistanceOverTimePressure", "TravelOverTimeRisk",
                                       "LowStockOverTimeRisk")


_SAT_SQL = ", ".join(FE.SATISFACTION_SET)


@q("features_rowwise", f"""WITH {_FEAT_SQL}
SELECT EmployeeNumber, ({" + ".join(FE.SATISFACTION_SET)}) / {len(FE.SATISFACTION_SET)}.0 AS SatisfactionIndex,
       GREATEST({_SAT_SQL}) - LEAST({_SAT_SQL}) AS SatisfactionGap,
       LowWorkLifeFlag + LowJobSatisfactionFlag + LowEnvironmentSatisfactionFlag + OverTimeFlag AS StressLoadScore FROM f""")
def features_rowwise(spark, sf):
    return employees(spark, sf).select("EmployeeNumber", "SatisfactionIndex", "SatisfactionGap", "StressLoadScore")


# need rules of K6: condition and what it adds to each topic
_NEED_SQL = [
    ("OverTime = 'Yes'", {"worklife": 1.4, "care": 0.6}),
    ("BusinessTravel = 'Travel_Frequently'", {"worklife": 1.0, "compensation": 0.5}),
    ("BusinessTravel = 'Travel_Rarely'", {"worklife": 0.4}),
    ("WorkLifeBalance <= 2", {"worklife": 1.4, "care": 0.4}),
    ("MonthlyIncome <= (SELECT quantile_cont(MonthlyIncome, 0.5) FROM f)", {"compensation": 1.3}),
    ("YearsSinceLastPromotion >= 3", {"promotion": 1.3, "development": 0.7}),
    ("TrainingTimesLastYear <= 1", {"development": 1.1}),
    ("(EnvironmentSatisfaction <= 2 OR RelationshipSatisfaction <= 2)", {"environment": 1.2, "care": 0.5}),
    ("DistanceFromHome >= (SELECT quantile_cont(DistanceFromHome, 0.75) FROM f)", {"housing": 1.0}),
    ("(JobLevel <= 2 AND TotalWorkingYears <= 5)", {"development": 0.8, "promotion": 0.4}),
    ("JobSatisfaction <= 2", {"recognition": 0.8, "environment": 0.6}),
]


def _need_sql(topic: str) -> str:
    adds = [f"CASE WHEN {c} THEN CAST({a[topic]} AS DOUBLE) ELSE 0.0 END" for c, a in _NEED_SQL if topic in a]
    return " + ".join(adds) or "0.0"


def _need_tags_sql() -> str:
    parts = ", ".join(f"CASE WHEN need_{k} > 0 THEN '{lab}' END" for k, (lab, _) in P.FIXTURE_TOPICS.items())
    j = f"concat_ws('{P.TOPIC_LABEL_SEP}', {parts})"
    return f"CASE WHEN {j} = '' THEN '{P.DEFAULT_TOPIC_LABEL}' ELSE {j} END"


@q("employee_needs", f"""WITH {_FEAT_SQL},
n AS (SELECT EmployeeNumber, JobRole, Department, {", ".join(f"{_need_sql(k)} AS need_{k}" for k in P.FIXTURE_TOPICS)} FROM f)
SELECT EmployeeNumber, {_norm_sql('JobRole')} AS JobRoleKey, {_norm_sql('Department')} AS DepartmentKey,
       {", ".join(f"ROUND(need_{k}, 6) AS need_{k}" for k in P.FIXTURE_TOPICS)}, {_need_tags_sql()} AS employee_need_tags FROM n""")
def employee_needs(spark, sf):
    ra, da = _dicts(spark, sf)
    p = MT.employee_profiles(FX.workforce(spark, sf), P.FIXTURE_TOPICS, ra, da)
    return p.select(F.col("id").alias("EmployeeNumber"), "JobRoleKey", "DepartmentKey",
                    *[F.col("need_scores")[i].alias(f"need_{k}") for i, k in enumerate(P.FIXTURE_TOPICS)],
                    "employee_need_tags")


@q("employee_profile_text")
def employee_profile_text(spark, sf):
    ra, da = _dicts(spark, sf)
    p = MT.employee_profiles(FX.workforce(spark, sf), P.FIXTURE_TOPICS, ra, da)
    return p.select(F.col("id").alias("EmployeeNumber"), "employee_policy_text",
                    *[F.col("employee_need_vector")[i].alias(f"nv_{k}") for i, k in enumerate(P.FIXTURE_TOPICS)])


@q("policy_match_features")
def policy_match_features(spark, sf):
    ra, da = _dicts(spark, sf)
    pol = prepared(spark, sf, "policy_id", "semantic_text", "topic_vector", "policy_sentiment", "time_weight", "target_role_keys",
                   "target_department_keys", "policy_score")
    return MT.policy_match_features(FX.workforce(spark, sf), pol, P.FIXTURE_TOPICS, ra, da)
