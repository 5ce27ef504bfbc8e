"""Alias dictionaries of any size as tables.

A dictionary is a table (alias, canonical, place): a normalised alias, its canonical name, and the order of matches.
Lookups are equi-joins, so Spark broadcasts a small dictionary by its size and shuffles a large one.

* Names (B19) are looked up by their normalised form.  Each distinct array of names is asked for once and gets back a
  map of those of its names that the dictionary holds.
* Texts (B20) are cut into windows of a few fixed lengths (every position).  An alias is filed under its longest
  prefix of such a length, so an equi-join of windows with prefixes finds every alias that can occur, and a comparison
  with the whole text keeps those that do.  Aliases of at most SHORT characters must equal the whole text.

Rows are linked to their answers by a 64-bit hash of what was asked.  Two values with one hash would only see each
other's candidates too, which the lookup by name and the comparison with the text leave out: results stay exact.
Dictionaries of up to LITERAL entries, and fixed ones, are Python mappings and stay literals in the plan (``load`` decides by a
count; results are the same).  Nulls and empty texts match nothing; rows are never joined by an
id, so repeated rows and null ids keep their own results.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

Dictionary = Mapping[str, Sequence[str]] | DataFrame

SHORT = 2  # FIXED VALUE: longer aliases may occur anywhere in a text
WINDOWS = (3, 6, 12, 24)
LITERAL = 1000
_KEY, _HITS, _TEXT = "__dictionary_key", "__dictionary_hits", "__dictionary_text"


def alias_table(groups: DataFrame) -> DataFrame:
    """(alias, canonical, place) from rows (canonical, aliases, ord).

    Names are normalised; a canonical name is an alias of itself.  Of equal aliases the last one by (ord, position) names
    the canonical name, the first one gives the place, as in a mapping filled in that order.
    """
    names = F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))
    each = groups.where("canonical is not null").select("canonical", "ord", F.posexplode(names).alias("at", "name"))
    each = each.select(T.normalize_identifier("name").alias("alias"), F.struct("ord", "at", "canonical").alias("place"))
    return each.groupBy("alias").agg(F.max("place").getField("canonical").alias("canonical"), F.min("place").alias("place"))


def load(groups: DataFrame, literal: int = LITERAL) -> Dictionary:
    """The dictionary of rows (canonical, aliases, ord) with distinct canonical names: a mapping if it has at most
    ``literal`` names and aliases, else a table."""
    held = groups.where("canonical is not null")
    names = held.agg(F.sum(1 + F.size(F.coalesce("aliases", F.array().cast("array<string>"))))).first()[0] or 0
    if names > literal:
        return alias_table(groups)
    return {r.canonical: list(r.aliases or []) for r in held.orderBy("ord", "canonical").collect()}


def _with_known(df: DataFrame, names: Column, table: DataFrame, out: str) -> DataFrame:
    """``df`` with a map ``out``: normalised name -> canonical, for those of the array ``names`` that the dictionary holds."""
    df = df.withColumn(_KEY, F.xxhash64(names))
    asked = df.select(_KEY, F.explode(F.transform(names, lambda x: T.normalize_identifier(x))).alias("alias")).distinct()
    hits = asked.join(table.select("alias", "canonical"), "alias")
    hits = hits.groupBy(_KEY).agg(F.map_from_entries(F.collect_set(F.struct("alias", "canonical"))).alias(out))
    return df.join(hits, _KEY, "left").drop(_KEY)


def with_canonical(df: DataFrame, name: Column, dictionary: Dictionary, out: str) -> DataFrame:
    """``df`` with the canonical name of ``name`` in ``out``; unknown names are kept."""
    if not isinstance(dictionary, DataFrame):
        return df.withColumn(out, T.canonicalize(name, T.alias_dictionary(dictionary)))
    known = _with_known(df, F.array(name), dictionary, _HITS)
    return known.withColumn(out, T.canonicalize(name, F.col(_HITS))).drop(_HITS)


def with_canonical_key(df: DataFrame, name: Column, dictionary: Dictionary, out: str) -> DataFrame:
    """``df`` with the normalised canonical name (JobRoleKey / DepartmentKey) in ``out``."""
    return with_canonical(df, name, dictionary, out).withColumn(out, T.normalize_identifier(out))


def _windows(text: Column, size: int) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def with_matches(df: DataFrame, norm_text: Column, dictionary: Dictionary, out: str) -> DataFrame:
    """``df`` with the canonical names whose alias occurs in the normalised text, in the dictionary's order."""
    if not isinstance(dictionary, DataFrame):
        return df.withColumn(out, T.alias_matches(norm_text, T.alias_dictionary(dictionary)))
    n = F.length("alias")
    cut = F.when(n <= SHORT, n).otherwise(F.greatest(*[F.when(n >= w, w) for w in WINDOWS], F.lit(0)))
    entries = dictionary.where("alias <> ''").select("alias", "canonical", "place", F.substring("alias", F.lit(1), cut).alias("window"))
    # at most one row for each window length
    sizes = sorted(r.size for r in entries.select(F.length("window").alias("size")).distinct().collect() if r.size > SHORT)
    df = df.withColumn(_TEXT, norm_text).withColumn(_KEY, F.xxhash64(_TEXT))
    whole = df.where(F.length(_TEXT) <= SHORT).select(_KEY, F.col(_TEXT).alias("window"))
    parts = [df.where(F.length(_TEXT) >= w).select(_KEY, F.explode(_windows(F.col(_TEXT), w)).alias("window")) for w in sizes]
    for part in parts:
        whole = whole.unionByName(part)
    found = whole.join(entries, "window").groupBy(_KEY).agg(F.collect_set(F.struct("place", "alias", "canonical")).alias(_HITS))
    own = F.col(_TEXT)
    held = F.filter(F.array_sort(_HITS), lambda e: F.when(F.length(e["alias"]) <= SHORT, own == e["alias"]).otherwise(F.contains(own, e["alias"])))
    names = F.array_distinct(F.transform(held, lambda e: e["canonical"]))
    df = df.join(found, _KEY, "left").withColumn(out, F.coalesce(names, F.array().cast("array<string>")))
    return df.drop(_KEY, _TEXT, _HITS)


def with_field(df: DataFrame, explicit: Column, dictionary: Dictionary, out: str) -> DataFrame:
    """``df`` with the canonical labels that the field ``explicit`` names."""
    if isinstance(dictionary, DataFrame):
        df = _with_known(df, T.split_multi_value(explicit), dictionary, "__dictionary_known")
        return df.withColumn(out, T.field_labels(explicit, F.col("__dictionary_known"))).drop("__dictionary_known")
    return df.withColumn(out, T.field_labels(explicit, T.alias_dictionary(dictionary)))


def with_found(df: DataFrame, field: str, norm_text: Column, dictionary: Dictionary, out: str) -> DataFrame:
    """``df`` with the labels of ``field`` (dropped), else those that the normalised text names."""
    df = with_matches(df, F.when(F.size(field) == 0, norm_text), dictionary, out)
    return df.withColumn(out, T.dedupe_keep_order(F.when(F.size(field) > 0, F.col(field)).otherwise(F.col(out)))).drop(field)


def with_targets(df: DataFrame, explicit: Column, norm_text: Column, dictionary: Dictionary, out: str) -> DataFrame:
    """``df`` with the labels that a row aims at: those of its field, else those that its text names."""
    field = "__dictionary_field"
    return with_found(with_field(df, explicit, dictionary, field), field, norm_text, dictionary, out)
