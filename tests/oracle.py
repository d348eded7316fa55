"""Compares a query with its SQL in DuckDB, order-insensitively."""

import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in sorted(os.listdir(folder)):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    return c


def plain(x) -> str:
    if x is None or x != x:
        return "null"
    return repr(float(x)) if isinstance(x, float) else str(x)


def rows_of(table) -> list[tuple]:
    names = sorted(table.column_names)
    return sorted(tuple(map(plain, r)) for r in zip(*[table[n].to_pylist() for n in names], strict=True))


def assert_same(df, sql: str, folder: str) -> None:
    ours, theirs = df.toArrow(), connect(folder).sql(sql).to_arrow_table()
    assert sorted(ours.column_names) == sorted(theirs.column_names)
    assert rows_of(ours) == rows_of(theirs)
