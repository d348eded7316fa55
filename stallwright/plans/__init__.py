"""Queries on the driver tables, each with its DuckDB SQL."""

from __future__ import annotations

from . import aggregations, answers, candidates, catalog_views, claims, classification, copy_texts, copywriting, evidence, lifecycle, landing, listing_lifecycle, lookups, quality, registry, review_depth, reviews, selection, streams, texts, validation

__all__ = ["aggregations", "answers", "candidates", "catalog_views", "claims", "classification", "copy_texts", "copywriting", "evidence", "landing", "lifecycle", "listing_lifecycle", "lookups", "quality", "review_depth", "reviews", "selection", "streams", "texts", "validation"]


def queries() -> dict:
    return registry.QUERIES


def oracle_sql() -> dict[str, str]:
    return registry.SQL
