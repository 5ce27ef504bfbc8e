"""Long texts cleaned, normalised and searched (B15, B16, J1), batch by batch over Arrow arrays.

Results are those of ``functions.text``, whose expressions stay for short fields and nested use; its regular expressions
and one copy of the text per searched word took most of the time that policies took to prepare.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import NULL_TOKENS

#: Null tokens, and all but identifier characters, as ``functions.text`` has them.
_NULLS, _NON_IDENT = frozenset(NULL_TOKENS), re.compile("[^一-龥a-zA-Z0-9]+")
_OTHER_BYTES = bytes(c for c in range(256) if not (c < 128 and chr(c).isalnum()))


def _clean(text: str | None) -> str:
    """``clean_text``: runs of what str.isspace accepts are one space, none at the ends."""
    out = (text or "").replace("\n", " ")
    if out.isprintable():  # then the space is its only white space
        while "  " in out:
            out = out.replace("  ", " ")
        out = out.strip(" ")
    else:
        out = " ".join(out.split())
    return "" if len(out) <= 4 and out.lower() in _NULLS else out


def _norm(text: str) -> str:
    """``normalize_cleaned``: identifier characters only, lower-cased."""
    try:
        return text.encode("latin-1").translate(None, _OTHER_BYTES).lower().decode("ascii")
    except UnicodeEncodeError:  # a character beyond one byte, which may be one of the kept
        return _NON_IDENT.sub("", text).lower()


def text_facts(title: Column, content: Column, full: Column | None, asked: Column, groups: Sequence[Sequence[str]]) -> Column:
    """One pass over a row's long texts, a struct of

    body: ``clean_text`` of ``content``; full: that of ``full`` (null without it, as the full text is then the clean ``title`` and
    the body); norm: ``normalize_cleaned`` of the full text where ``asked``, else null; counts: ``keyword_count`` of each group of
    words in the full text."""
    groups, own = [list(g) for g in groups], full is not None

    def run(title: pa.Array, content: pa.Array, full: pa.Array, asked: pa.Array) -> pa.Array:
        bodies = [_clean(t) for t in content.to_pylist()]
        texts = [_clean(t) for t in full.to_pylist()] if own else [f"{t} {b}".strip(" ") for t, b in zip(title.to_pylist(), bodies)]
        norm = [_norm(t) if a else None for t, a in zip(texts, asked.to_pylist())]
        counts = [[float(sum(map(t.count, g))) for g in groups] for t in texts]
        return pa.StructArray.from_arrays([pa.array(bodies, pa.string()), pa.array(texts if own else [None] * len(texts), pa.string()), pa.array(norm, pa.string()),
                                           pa.array(counts, pa.list_(pa.float64()))], ["body", "full", "norm", "counts"])

    full = full.cast("string") if own else F.lit(None).cast("string")
    return F.arrow_udf(run, "body string, full string, norm string, counts array<double>")(title, content.cast("string"), full, asked)
