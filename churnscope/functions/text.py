"""String column expressions.

All of these are plain Spark SQL expressions (``regexp_replace``, ``split``,
higher-order functions over arrays), so they stay inside whole-stage codegen.
Dictionaries are passed in as Python dicts and become literal maps/arrays.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import params as P

# Characters Python's ``str.isspace`` accepts; SQL ``trim`` and Java ``\s``
# miss most of them (trap T16).  Built from code points so the same class can
# be rendered for Java regex (Spark) and RE2 (DuckDB).
_WS_SINGLE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2028, 0x2029,
              0x202F, 0x205F, 0x3000]
_WS_RANGES = [(0x1C, 0x1F), (0x2000, 0x200A)]


def _ws_class(fmt) -> str:
    parts = [fmt(c) for c in _WS_SINGLE] + [f"{fmt(a)}-{fmt(b)}" for a, b in _WS_RANGES]
    return "[" + "".join(parts) + "]+"


WS_RUN_RE2 = _ws_class(lambda c: f"\\x{{{c:X}}}")
# The same runs in two steps, which the regex engine does several times faster: the characters beyond 8 bits become
# spaces (the outer range is tested first), then runs within 8 bits become one.
WS_WIDE_JAVA = "[\\x{1680}-\\x{3000}&&[\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]]"
WS_NARROW_RUN_JAVA = "[\\x09-\\x0D\\x1C-\\x20\\x85\\xA0]+"
NULL_TOKENS = ["nan", "none", "null", "nat"]
NULL_TOKEN_JAVA = "^(?i:nan|none|null|nat)$"
# Identifier characters kept by normalize_identifier: CJK block + ASCII alnum.
NON_IDENT_JAVA = "[^\\u4e00-\\u9fa5a-zA-Z0-9]+"
# The same set as ranges within 16 bits (without surrogates) and beyond: the regex engine
# tests such classes several times faster than a negated one.
NON_IDENT_PARTS = ("[\\x00-/:-@\\[-`{-\\x{4DFF}\\x{9FA6}-\\x{D7FF}\\x{E000}-\\x{FFFF}]+", "[\\x{10000}-\\x{10FFFF}]+")
NON_IDENT_RE2 = "[^\\x{4E00}-\\x{9FA5}a-zA-Z0-9]+"
MULTI_VALUE_SPLIT = "[，,、/|；;\\n]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c) -> Column:
    """Null / null-token -> '', whitespace runs -> one space, trimmed.

    The input is referenced once (nested cleaning must not grow the plan).
    """
    spaced = F.regexp_replace(F.coalesce(_col(c).cast("string"), F.lit("")), WS_WIDE_JAVA, " ")
    return F.regexp_replace(F.trim(F.regexp_replace(spaced, WS_NARROW_RUN_JAVA, " ")), NULL_TOKEN_JAVA, "")


def normalize_identifier(c) -> Column:
    """Keep CJK and ASCII alphanumerics, lower-cased."""
    return normalize_cleaned(clean_text(c))


def normalize_cleaned(c) -> Column:
    """``normalize_identifier`` of a text that ``clean_text`` gave (cleaning it again changes nothing)."""
    out = _col(c)
    for part in NON_IDENT_PARTS:
        out = F.regexp_replace(out, part, "")
    return F.lower(out)


def normalize_identifier_py(value) -> str:
    """Python twin used to build literal dictionaries at plan time."""
    import re
    if value is None:
        return ""
    text = re.sub(r"\s+", " ", str(value).strip())
    if text.lower() in NULL_TOKENS:
        return ""
    return re.sub(r"[^一-龥a-zA-Z0-9]+", "", text).lower()


def split_multi_value(c) -> Column:
    """Split on the separator set, clean parts, drop empty, fall back to the whole."""
    v = clean_text(c)
    parts = F.filter(F.transform(F.split(v, MULTI_VALUE_SPLIT), lambda x: clean_text(x)),
                     lambda x: x != "")
    return (F.when(v == "", F.array().cast("array<string>"))
            .when(F.size(parts) == 0, F.array(v))
            .otherwise(parts))


def dedupe_keep_order(arr) -> Column:
    """Clean, drop empty, first-seen order distinct."""
    return F.array_distinct(F.filter(F.transform(_col(arr), lambda x: clean_text(x)),
                                     lambda x: x != ""))


def alias_dictionary(groups: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """Normalised alias -> canonical, canonical names included, later entries win."""
    out: dict[str, str] = {}
    for canonical, aliases in groups.items():
        for alias in [canonical, *aliases]:
            out[normalize_identifier_py(alias)] = canonical
    return out


def _map_literal(d: Mapping[str, str] | Column) -> Column:
    if isinstance(d, Column):
        return d
    if not d:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def canonicalize(c, alias_map: Mapping[str, str] | Column) -> Column:
    """Canonical name through the alias dictionary (a mapping or a map column); unknown names kept as is."""
    t = clean_text(c)
    hit = F.try_element_at(_map_literal(alias_map), normalize_identifier(t))
    return F.when(t == "", F.lit("")).otherwise(F.coalesce(hit, t))


def alias_matches(norm_text, alias_map: Mapping[str, str]) -> Column:
    """Canonical names whose alias occurs in the NORMALISED text, dictionary order.

    ``norm_text`` must already be ``normalize_identifier(text)`` (a column), so
    the lambda below does not re-normalise the text per dictionary entry.
    Aliases of at most two characters must equal the whole normalised text.
    """
    entries = [(k, v) for k, v in alias_map.items() if k]
    if not entries:
        return F.array().cast("array<string>")
    norm = _col(norm_text)
    arr = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in entries])
    hits = F.filter(arr, lambda e: F.when(F.length(e["k"]) <= 2, norm == e["k"])
                    .otherwise(F.contains(norm, e["k"])))
    return F.array_distinct(F.transform(hits, lambda e: e["v"]))


def field_labels(explicit, alias_map: Mapping[str, str] | Column) -> Column:
    """B21 step 1: canonical labels from the structured field (split, canonicalise, drop empty)."""
    return F.filter(F.transform(split_multi_value(explicit), lambda x: canonicalize(x, alias_map)),
                    lambda x: x != "")


def labels_to_keys(labels) -> Column:
    """B21 keys: normalised canonical of each label, deduplicated (defect R6: one key per label)."""
    return F.array_distinct(F.filter(F.transform(_col(labels), lambda x: normalize_identifier(x)),
                                     lambda x: x != ""))


def keyword_count(text, words: Sequence[str]) -> Column:
    """Non-overlapping occurrences of each word, summed (length difference, T14; bytes, which need no count)."""
    t = _col(text)
    total = F.lit(0)
    for w in words:
        total = total + F.floor((F.octet_length(t) - F.octet_length(F.replace(t, F.lit(w), F.lit("")))) / len(w.encode()))
    return total.cast("double")


def char_ngrams(text, n_min: int = 2, n_max: int = 4) -> Column:
    """Character n-grams of a string for n in [n_min, n_max] (all positions, n-major order).

    A zero-width look-ahead regex yields every overlapping n-gram in one linear
    pass per n (``substring`` by code-point offset would rescan the UTF-8
    string for every position: quadratic on long documents).  Texts shorter
    than n yield nothing (trap T27).
    """
    t = _col(text)
    return F.flatten(F.array(*[F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
                               for n in range(n_min, n_max + 1)]))
