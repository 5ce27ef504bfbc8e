"""Policy text analytics.

``prepare_policies`` turns a raw policy table into the prepared schema: full
text, targets, topic scores / vector / tags / strength, sentiment, time
weight, semantic text, TF-IDF hotness, centroid similarity and policy score.
Long texts are cleaned, normalised and searched by the batch jobs of ``texts``; everything else per row is a built-in expression; corpus statistics (newest date,
vocabulary, idf, centroid, min/max) are aggregates; the TF-IDF work is the
n-gram job of ``tfidf``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import params as P
from ..functions.text import clean_text, keyword_count, labels_to_keys, normalize_identifier_py
from ..session import cut_lineage, text_batches
from . import tfidf as TF
from .dictionary import Dictionary, with_canonical_key, with_field, with_found
from .texts import text_facts

PREPARED_COLUMNS = {"full_text", "semantic_text", "topic_vector", "time_weight", "target_role_keys",
                    "target_department_keys", "policy_score", "embedding"}

Topics = Mapping[str, tuple[str, Sequence[str]]]


def find_first_existing_column(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """Exact name first, else a normalised-name match (plan time)."""
    normalized = {normalize_identifier_py(c): c for c in columns}
    for cand in candidates:
        if cand in columns:
            return cand
        key = normalize_identifier_py(cand)
        if key in normalized:
            return normalized[key]
    return None


def resolve_policy_columns(columns: Sequence[str], overrides: Mapping[str, str] | None = None) -> dict[str, str | None]:
    """B7 for the six policy fields; ``overrides`` names columns explicitly."""
    out = {k: find_first_existing_column(columns, c) for k, c in P.POLICY_COLUMN_CANDIDATES.items()}
    for k, v in (overrides or {}).items():
        out[k] = v if v in columns else None
    return out


def topic_score_columns(text: Column, topics: Topics = P.POLICY_TOPICS) -> list[Column]:
    """One keyword-count column per topic, in topic order."""
    return [keyword_count(text, words) for _, (_, words) in topics.items()]


def topic_tags(scores: Sequence[Column], topics: Topics = P.POLICY_TOPICS) -> Column:
    """Labels of topics with a positive score joined by '、', default label when none."""
    labs = F.array_compact(F.array(*[F.when(s > 0, F.lit(lab)) for s, (_, (lab, _)) in zip(scores, topics.items())]))
    return F.when(F.size(labs) == 0, F.lit(P.DEFAULT_TOPIC_LABEL)).otherwise(F.array_join(labs, P.TOPIC_LABEL_SEP))


def l1_vector(scores: Sequence[Column]) -> Column:
    """Scores / sum (zero vector stays zero)."""
    arr = F.array(*[s.cast("double") for s in scores])
    total = F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform(arr, lambda x: x / total)).otherwise(arr)


def sentiment(text: Column, positive: Sequence[str] = P.POSITIVE_WORDS,
              negative: Sequence[str] = P.NEGATIVE_WORDS) -> Column:
    """(pos-neg)/(pos+neg+1e-8) clipped to [-1, 1]; 0 when neither occurs."""
    return tone(keyword_count(text, positive), keyword_count(text, negative))


def tone(pos: Column, neg: Column) -> Column:
    """J5 of the two counts."""
    s = F.least(F.greatest((pos - neg) / (pos + neg + 1e-8), F.lit(-1.0)), F.lit(1.0))
    return F.when((pos == 0) & (neg == 0), F.lit(0.0)).otherwise(s)


def time_weight(df: DataFrame, ts: Column, half_life_days: int = P.TIME_DECAY_HALF_LIFE_DAYS,
                fallback_newest=None) -> Column:
    """0.5 ** (whole days before the newest date / half-life); NULL date -> 0.5.

    The newest date is one aggregate (scalar subquery). Whole 24 h days (T13).
    """
    newest = df.select(F.max(ts)).scalar()
    if fallback_newest is not None:
        newest = F.coalesce(newest, F.lit(fallback_newest).cast("timestamp"))
    days = F.greatest(F.timestamp_diff("DAY", ts, newest), F.lit(0))
    hl = float(max(half_life_days, 1))
    return F.when(ts.isNull(), F.lit(0.5)).otherwise(F.pow(F.lit(0.5), days.cast("double") / hl))


def policy_base(df: DataFrame, columns: Mapping[str, str] | None = None, id_col: str = "policy_id",
                topics: Topics = P.POLICY_TOPICS, positive: Sequence[str] = P.POSITIVE_WORDS,
                negative: Sequence[str] = P.NEGATIVE_WORDS,
                role_aliases: Dictionary = P.JOB_ROLE_ALIAS_GROUPS, dept_aliases: Dictionary = P.DEPARTMENT_ALIAS_GROUPS,
                half_life_days: int = P.TIME_DECAY_HALF_LIFE_DAYS, fallback_time=None) -> DataFrame:
    """Row-level policy preparation (everything before the TF-IDF corpus statistics)."""
    cols = resolve_policy_columns(df.columns, columns)
    if cols["title"] is None and cols["content"] is None and "full_text" not in df.columns:
        raise ValueError("policy table has no usable text column (title / content / full_text)")

    # Per-document text work is CPU-bound and a document file is often one input
    # split: hash-spread the rows over tasks first.  Without a number of its own the
    # exchange is sized by AQE from the data.
    if id_col in df.columns:
        df = df.repartition(F.col(id_col))

    def text(key):
        c = cols[key]
        return clean_text(c) if c else F.lit("")
    # body and full text are raw until the pass over the long texts
    given = "full_text" in df.columns
    base = df.withColumns({"policy_title": text("title"), "policy_body": F.col(cols["content"]).cast("string") if cols["content"] else F.lit(""),
                           "policy_source": text("source"), "full_text": F.col("full_text").cast("string") if given else F.lit("")})
    if cols["time"]:
        ts = F.col(cols["time"]).cast("string").try_cast("timestamp")
    else:
        ts = F.lit(fallback_time).cast("timestamp")
    base = base.withColumn("publish_time", ts)
    base = base.withColumn("time_weight", time_weight(base, F.col("publish_time"), half_life_days, fallback_time))
    role_in = clean_text(cols["role"]) if cols["role"] else F.lit("")
    dept_in = clean_text(cols["department"]) if cols["department"] else F.lit("")
    base = base.withColumns({"_role_in": role_in, "_dept_in": dept_in})
    base = with_field(base, F.col("_role_in"), role_aliases, "_role_field")
    base = with_field(base, F.col("_dept_in"), dept_aliases, "_dept_field")
    # only texts that must name a target themselves are normalised
    asked = (F.size("_role_field") == 0) | (F.size("_dept_field") == 0)
    keys, groups = list(topics), [*(words for _, words in topics.values()), positive, negative]
    facts = text_facts(F.col("policy_title"), F.col("policy_body"), F.col("full_text") if given else None, asked, groups)
    base = base.withColumn("_facts", facts)
    base = base.withColumns({"policy_body": F.col("_facts.body"), "_norm_full": F.col("_facts.norm"), "_counts": F.col("_facts.counts")})
    base = base.withColumn("full_text", F.col("_facts.full") if given else full_text())
    base = with_found(base, "_role_field", F.col("_norm_full"), role_aliases, "target_role_labels")
    base = with_found(base, "_dept_field", F.col("_norm_full"), dept_aliases, "target_department_labels")
    base = base.withColumns({"target_role_keys": labels_to_keys(F.col("target_role_labels")),
                             "target_department_keys": labels_to_keys(F.col("target_department_labels"))})
    base = base.drop("_role_in", "_dept_in", "_norm_full", "_facts")
    base = base.withColumn("_ts", F.slice("_counts", 1, len(keys)))
    ts_ = [F.col("_ts")[i] for i in range(len(keys))]
    hits = F.aggregate(F.col("_ts"), F.lit(0.0), lambda a, x: a + x)
    count = F.size(F.filter("_ts", lambda x: x > 0))
    base = base.withColumns({
        "topic_scores": F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.col("_ts")),
        "topic_vector": l1_vector(ts_),
        "policy_tags": topic_tags(ts_, topics),
        "matched_topic_count": count,
        "topic_hit_total": hits,
        "topic_strength": F.least(F.greatest((count * 0.6 + hits * 0.4) / 4.0, F.lit(0.0)), F.lit(1.0)),
        "policy_sentiment": tone(F.col("_counts")[len(keys)], F.col("_counts")[len(keys) + 1]),
    }).drop("_ts", "_counts")
    return base.withColumn("semantic_text", semantic_text()).withColumn("_pid", F.col(id_col))


def full_text() -> Column:
    """Title and body, both clean: nothing but a space at an end is left to clean."""
    return F.trim(F.concat_ws(" ", "policy_title", "policy_body"))


def semantic_text() -> Column:
    """J7's text of a base row.  Clean pieces (labels are clean, and so are their lists) joined by single spaces are a
    clean text: the long ones are not cleaned again."""
    pieces = [F.col("policy_title"), F.col("full_text"), clean_text("policy_tags"),
              F.array_join(F.col("target_role_labels"), " "), F.array_join(F.col("target_department_labels"), " "),
              F.col("policy_source")]
    return F.concat_ws(" ", *[F.when(x != "", x) for x in pieces])


def embed_max_features(n_texts: int) -> int:
    """min(1024, max(128, 8 n))."""
    return min(P.EMBED_MAX_FEATURES, max(P.EMBED_MIN_FEATURES, n_texts * P.EMBED_FEATURES_PER_TEXT))


def prepare_policies(df: DataFrame, columns: Mapping[str, str] | None = None, id_col: str = "policy_id",
                     keep: Sequence[str] | None = None, **kw) -> DataFrame:
    """Prepared policy table; an already prepared table is returned unchanged.

    With ``keep`` the table holds these columns only.  Every statistic is computed just the same, but texts and vectors that
    the caller doesn't read are neither moved nor written.
    """
    if PREPARED_COLUMNS.issubset(df.columns):
        return df.select(*keep) if keep else df
    with text_batches(df.sparkSession):
        return _prepared(df, columns, id_col, keep, **kw)


def _prepared(df: DataFrame, columns: Mapping[str, str] | None, id_col: str, keep: Sequence[str] | None, **kw) -> DataFrame:
    # The base table feeds the corpus, several scalar statistics and the final join:
    # computed once (regex cleaning and topic scoring run once per document).
    # Texts that are made of others by joining them are made when they are read.
    base = policy_base(df, columns, id_col, **kw)
    names, made = base.columns, {"semantic_text": semantic_text()}
    if "full_text" not in df.columns:
        made = {"full_text": full_text()} | made
    # what the texts above and the score are made of
    wanted = {"policy_title", "policy_body", "policy_tags", "target_role_labels", "target_department_labels", "policy_source", "full_text",
              "policy_sentiment", "time_weight", "topic_strength", "_pid", *(keep or names)}
    # dealt by id once more, as the pass over the long texts loses track of it: none of the steps below moves texts again
    held = base.select(*[F.col(f"`{c}`") for c in names if c in wanted and c not in made]).repartition("_pid").persist()
    base = held
    for name, text in made.items():
        base = base.withColumn(name, text)
    base = base.select(*[F.col(f"`{c}`") for c in names if c in wanted or c in made])
    corpus = base.select(F.col("_pid").alias("id"),
                         F.when(F.col("semantic_text") == "", F.lit(P.EMPTY_TEXT)).otherwise(F.col("semantic_text"))
                         .alias("text"))
    n = corpus.count()
    # One vocabulary serves both caps: the first V_e terms of the 2000-term list
    # are exactly the V_e-term vocabulary (same ordering).
    vocab = TF.held(TF.vocabulary(TF.term_totals(corpus, "id", "text"), P.HOTNESS_MAX_FEATURES))
    # row sums over the whole vocabulary and vectors over the embedding's part of it, made in one pass over the texts
    v_e = embed_max_features(n)
    weights = TF.sums_and_ranks(corpus, vocab, n, v_e, "id", "text").persist()
    ids = corpus.select("id")
    hot = TF.minmax_hotness(ids, weights.select("id", "s"))
    sem = TF.centroid_similarity(ids, weights.select("id", "rank", "w"))
    emb = weights.select("id", "rank", "w").where(F.size("rank") > 0).select("id", F.col("rank").alias("_rank"), F.col("w").alias("_w"))
    out = (base.join(hot.withColumnRenamed("id", "_pid"), "_pid", "left")
           .join(sem.withColumnRenamed("id", "_pid"), "_pid", "left")
           .join(emb.withColumnRenamed("id", "_pid"), "_pid", "left")
           .withColumn("embedding", TF.named(vocab, F.col("_rank"), F.col("_w"), v_e)).drop("_rank", "_w"))
    wh, ws, wt, wst, wb = P.POLICY_SCORE_WEIGHTS
    bias = F.least(F.greatest((F.col("policy_sentiment") + 1.0) / 2.0, F.lit(0.0)), F.lit(1.0))
    score = 100.0 * (wh * F.col("policy_hotness") + ws * F.col("semantic_score") + wt * F.col("time_weight")
                     + wst * F.col("topic_strength") + wb * bias)
    # Downstream operators (macro index, gaps, matching) read it several times and
    # embed it in scalar subqueries: a reliable checkpoint (shared checkpoint dir)
    # computes it once and gives every later plan a small leaf instead of the
    # whole text-analytics lineage.
    out = (out.withColumnRenamed("hotness", "policy_hotness")
           .withColumn("policy_score", F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0)))
           .drop("_pid"))
    prepared = cut_lineage(out.select(*[F.col(f"`{c}`") for c in keep]) if keep else out)
    held.unpersist()
    weights.unpersist()
    return prepared


# ------------------------------------------------------------------ E18/E19 --

def role_pairs(prepared: DataFrame) -> DataFrame:
    """(label, key, score) per targeted role of each policy (labels and keys paired by position)."""
    z = F.arrays_zip(F.col("target_role_labels").alias("label"), F.col("target_role_keys").alias("key"))
    return (prepared.select(F.explode(z).alias("p"), F.col("policy_score"))
            .select(F.col("p.label").alias("JobRole"), F.col("p.key").alias("JobRoleKey"), "policy_score")
            .where(F.col("JobRole").isNotNull() & F.col("JobRoleKey").isNotNull() & (F.col("JobRoleKey") != "")))


def macro_index(prepared: DataFrame) -> DataFrame:
    """Per (role key, role) mean score and count -> 0.85*mean + 15*count/max(count), clipped.

    With no targeted role at all the result is one global row (mean policy score).
    The global max count is a scalar subquery over the grouped table.
    """
    g = role_pairs(prepared).groupBy("JobRoleKey", "JobRole").agg(
        F.avg("policy_score").alias("mean_score"), F.count(F.lit(1)).alias("policy_count"))
    mx = g.select(F.greatest(F.max("policy_count"), F.lit(1))).scalar()
    idx = F.least(F.greatest(F.col("mean_score") * P.MACRO_MEAN_WEIGHT
                             + F.col("policy_count") / mx * P.MACRO_COUNT_WEIGHT, F.lit(0.0)), F.lit(100.0))
    return g.select("JobRoleKey", "JobRole", idx.alias("macro_index"))


def macro_index_by_key(macro: DataFrame) -> DataFrame:
    """Defect R7 fixed: one row per role key (mean over its labels) before joining."""
    return macro.groupBy("JobRoleKey").agg(F.avg("macro_index").alias("macro_index"))


def join_macro_index(employees: DataFrame, prepared: DataFrame, role_aliases: Dictionary = P.JOB_ROLE_ALIAS_GROUPS) -> DataFrame:
    """Employees left-joined to the role macro index on JobRoleKey; a miss gets the mean
    over macro rows; no targeted role -> global mean policy score; no policy -> 50.

    The key table has one row per role key; AQE broadcasts it when small.
    """
    emp = with_canonical_key(employees, F.col("JobRole"), role_aliases, "JobRoleKey")
    macro = macro_index(prepared).persist()  # one row per (role key, role): bounded by the role dimension
    n_macro = macro.select(F.count(F.lit(1))).scalar()
    mean_macro = macro.select(F.avg("macro_index")).scalar()
    mean_score = prepared.select(F.avg("policy_score")).scalar()
    j = emp.join(macro_index_by_key(macro), "JobRoleKey", "left")
    fill = F.when(n_macro > 0, mean_macro).otherwise(F.coalesce(mean_score, F.lit(P.MACRO_EMPTY_DEFAULT)))
    return j.withColumn("macro_index", F.when(n_macro > 0, F.coalesce(F.col("macro_index"), fill)).otherwise(fill))


def policy_impact_by_role(prepared: DataFrame) -> DataFrame:
    """Mean policy score per targeted role label (+ overall mean as a column)."""
    overall = prepared.select(F.avg("policy_score")).scalar()
    r = prepared.select(F.explode(F.array_distinct("target_role_labels")).alias("role"), "policy_score")
    return r.groupBy("role").agg(F.avg("policy_score").alias("mean_score")).withColumn("overall_score", overall)


def policy_gap(employees_with_macro: DataFrame, limit: float = P.MACRO_GAP_LIMIT) -> DataFrame:
    """Distinct (role, department, macro_index) with macro_index < limit, ascending."""
    return (employees_with_macro.where(F.col("macro_index") < limit)
            .select("JobRole", "Department", "macro_index").distinct()
            .orderBy("macro_index", "JobRole", "Department"))
