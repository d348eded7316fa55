"""Listing states of the marketplaces in one vocabulary (fixed values)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

API_STATES = {"OPENED": "active", "ACTIVE": "active", "CLOSED": "inactive", "INACTIVE": "inactive", "SOLD_OUT": "sold_out", "DRAFT": "draft"}


def by_code(code: Column) -> Column:
    c = F.trim(code)
    return F.when(c == "2", "active").when(c == "1", "inactive").otherwise("unknown")


def by_flags(warehouse: Column, search: Column) -> Column:
    """Of the warehouse flag and the search flag, "0" or "1" each."""
    return F.when((warehouse == "0") & (search == "1"), "active").when(warehouse == "1", "inactive").when(search == "0", "inactive").otherwise("unknown")


def by_quantity(quantity: Column) -> Column:
    return F.when(quantity > 0, "active").when(quantity.isNotNull(), "sold_out").otherwise("unknown")


def by_api(state: Column) -> Column:
    out = F.lit("unknown")
    for name, known in API_STATES.items():
        out = F.when(F.upper(state) == name, known).otherwise(out)
    return out
