"""Registered queries: name -> (tables -> DataFrame) and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources.tables import Tables

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of Tables as a query; ``sql`` is its oracle."""

    def wrap(f: Callable[[Tables], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            SQL[key] = sql
        return f

    return wrap
