"""The queries of this package and the SQL that checks them."""

from __future__ import annotations

from docloom.llm import bpe_codec, decontamination, language_id, licenses, near_dedup, pii, sharding, substring_dedup, token_counts, topk

MODULES = [licenses, substring_dedup, near_dedup, decontamination, pii, topk, bpe_codec, language_id, sharding, token_counts]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
