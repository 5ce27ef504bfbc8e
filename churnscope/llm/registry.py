"""Queries of this subpackage: key -> Spark builder, and key -> DuckDB SQL."""

from __future__ import annotations

from . import (
    content_sort, embedding_dedup, gru_lm, language_id, merkle_manifest, minhash, packing, piece_bpe, quality, token_align, topk_search,
    url_filter, warc,
)

MODULES = [url_filter, quality, embedding_dedup, topk_search, warc, gru_lm, piece_bpe, minhash, packing, language_id, merkle_manifest, content_sort, token_align]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.SPARK.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
