"""Ordered access: top rows, keyset pages, rank maps, running positions, guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows (TakeOrderedAndProject: each task keeps n)."""
    return df.orderBy(*order).limit(n)


def keyset_page(df: DataFrame, at: str, key: str, cursor: tuple | None, n: int) -> DataFrame:
    """The n rows after the cursor (at, key), newest first, ties by falling key, and
    ``has_more``. The cursor has both columns, so ties aren't skipped."""
    if cursor is not None:
        when, last = F.lit(cursor[0]).cast(df.schema[at].dataType), F.lit(cursor[1])
        df = df.where((F.col(at) < when) | ((F.col(at) == when) & (F.col(key) < last)))
    page = df.orderBy(F.desc_nulls_last(at), F.desc(key)).limit(n + 1)
    w = Window.orderBy(F.desc_nulls_last(at), F.desc(key))  # n + 1 rows at most
    return page.withColumn("__n", F.row_number().over(w)).withColumn("has_more", F.max("__n").over(Window.partitionBy()) > n).where(F.col("__n") <= n).drop("__n")


def rank_of(c: str, order: Sequence[str], other: int = 99) -> Column:
    """Place of a value in ``order``; ``other`` for any other value and for null."""
    out = F.lit(other)
    for i, v in enumerate(order):
        out = F.when(F.col(c) == v, i).otherwise(out)
    return out


def running_position(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "position") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def against_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str) -> DataFrame:
    """Adds baseline (the key's first value) and delta to it."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("baseline", F.first(value).over(w)).withColumn("delta", F.col(value) - F.col("baseline"))


def at_most(df: DataFrame, n: int) -> DataFrame:
    """df; fails when read if it has over n rows, rather than give part of them."""
    count = df.limit(n + 1).agg(F.count("*").alias("__n"))
    guard = count.select(F.assert_true(F.col("__n") <= n, F.lit(f"more than {n} rows")).isNull().alias("__ok"))
    return df.join(F.broadcast(guard), F.col("__ok")).drop("__ok")


def exactly_one(df: DataFrame) -> DataFrame:
    """df; fails when read unless it has one row."""
    count = df.limit(2).agg(F.count("*").alias("__n"))
    guard = count.select(F.assert_true(F.col("__n") == 1, F.lit("not exactly one row")).isNull().alias("__ok"))
    return df.join(F.broadcast(guard), F.col("__ok"), "right").drop("__ok")


#: Optional filters of a task list: name -> what they ask of which column.
TASK_FILTERS = {
    "status": ("status", "in"), "priority": ("priority", "in"), "task_type": ("task_type", "in"), "platform": ("platform", "="), "shop_code": ("shop_code", "="), "owner_type": ("owner_type", "="), "owner_key": ("owner_key", "="),
    "due_before": ("due_date", "<="), "due_after": ("due_date", ">="), "scheduled_after": ("scheduled_at", ">="), "scheduled_before": ("scheduled_at", "<="), "approval_required": ("approval_required", "="),
}


def contains_any(columns: Sequence[str], search: str) -> Column:
    """Whether a text stands in one of the columns, case ignored; no pattern."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(c), F.lit(search.lower())), F.lit(False))
    return found


def filtered(df: DataFrame, search_in: Sequence[str] = (), **filters) -> DataFrame:
    """Rows that meet all filters that are given (TASK_FILTERS, and ``search``); an empty
    list or null is no filter, an unknown name an error. Filters on stored columns reach
    the scan."""
    search = filters.pop("search", None)
    for name, value in filters.items():
        column, how = TASK_FILTERS[name]
        if value is None or (isinstance(value, list) and not value):
            continue
        c = F.col(column)
        df = df.where({"in": lambda: c.isin(*value), "=": lambda: c == value, "<=": lambda: c <= F.lit(value), ">=": lambda: c >= F.lit(value)}[how]())
    return df.where(contains_any(search_in, search)) if search else df


def searched_after(df: DataFrame, order: Sequence[Column], n: int, columns: Sequence[str], search: str) -> DataFrame:
    """The first n rows, and of these the ones in whose joined columns a text stands: the
    search sees the page only, and that is what it promises."""
    said = F.lower(F.concat_ws(" ", *[F.nullif(F.col(c).cast("string"), F.lit("")) for c in columns]))
    return top(df, order, n).where(F.contains(said, F.lit(search.strip().lower())))
