"""Queries of the training-data operators, one for each, and their DuckDB SQL."""

from __future__ import annotations

from . import decontaminate, lexical_search, lm_score, mixing, periodic_runs, pii, quality, simhash, substring, token_counts, token_files, warc, weak_quality

MODULES = (mixing, simhash, token_files, decontaminate, lm_score, warc, quality, pii, substring, weak_quality, lexical_search, periodic_runs, token_counts)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: f for m in MODULES for k, f in m.SQL.items()}
