"""Joins of catalog work: missing children, classified lookups, latest-per-parent,
fallbacks. All take and return DataFrames and leave the physical strategy to Catalyst;
nothing is broadcast by hand but single rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def missing(parents: DataFrame, children: DataFrame, key: str, child_key: str) -> DataFrame:
    """Parents without a child (left anti; a null key has no child)."""
    return parents.join(children, parents[key] == children[child_key], "left_anti")


def present(parents: DataFrame, children: DataFrame, key: str, child_key: str) -> DataFrame:
    """Parents with a child, once each (left semi)."""
    return parents.join(children, parents[key] == children[child_key], "left_semi")


def star(fact: DataFrame, *dimensions: tuple[DataFrame, str, str]) -> DataFrame:
    """Chain of inner equi-joins: (dimension, key on the left, key of the dimension)."""
    return reduce(lambda left, d: left.join(d[0], left[d[1]] == d[0][d[2]]), dimensions, fact)


def lookup_classified(requests: DataFrame, source: DataFrame, on: str, source_key: str, value: str, order: str = "pos") -> DataFrame:
    """Each request (order, on) with the one source row of its key, case-insensitively,
    or with why there is none: ``not_found``, ``ambiguous``, ``no_value`` (null) or
    ``bad_value`` (negative or fractional). The build side is aggregated first, so an
    ambiguous key can't multiply requests. 0 is a value."""
    one = source.groupBy(F.upper(F.col(source_key)).alias("__key")).agg(F.count("*").alias("__n"), F.min(source_key).alias("found_key"), F.min(value).alias("__value"))
    joined = requests.join(one, F.upper(requests[on]) == one["__key"], "left")
    v = F.col("__value")
    status = (
        F.when(F.col("__n").isNull(), "not_found").when(F.col("__n") > 1, "ambiguous").when(v.isNull(), "no_value").when((v < 0) | (v != F.floor(v)), "bad_value").otherwise("ok")
    )
    joined = joined.withColumn("status", status)
    ok = F.col("status") == "ok"
    return joined.select(order, on, F.when(ok, F.col("found_key")).alias("found_key"), F.when(ok, v).alias("value"), "status")


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order`` (make it total)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def with_single_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Every row of df with the one row of ``row``; its columns are null if it has none."""
    return df.join(F.broadcast(row.limit(1)), F.lit(True), "left")


def children_nested(parents: DataFrame, children: DataFrame, key: str, child_key: str, fields: Sequence[str], name: str = "children") -> DataFrame:
    """Parents with a sorted array of child structs (empty for none). For parents with
    a bounded number of children."""
    nested = children.groupBy(child_key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    return parents.join(nested, parents[key] == nested[child_key], "left").drop(nested[child_key]).withColumn(name, F.coalesce(name, F.array()))


def unique_or_null(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Per key the value if there is exactly one distinct value, else null."""
    low, high = F.min(value), F.max(value)
    return df.groupBy(*keys).agg(F.when(low == high, low).alias(name))


def first_match(left: DataFrame, candidates: Sequence[tuple[DataFrame, list[tuple[str, str]], str, float]], left_id: str, right_id: str) -> DataFrame:
    """Union of equi-joins, one for each way to match: (right side, key pairs, method,
    confidence) -> (left_id, right_id, match_method, confidence)."""
    parts = []
    for right, pairs, method, confidence in candidates:
        on = reduce(lambda a, b: a & b, [left[a] == right[b] for a, b in pairs])
        parts.append(left.join(right, on).select(left[left_id], right[right_id], F.lit(method).alias("match_method"), F.lit(confidence).alias("confidence")))
    return reduce(DataFrame.unionByName, parts)


def fan_out(df: DataFrame, name: str, labels: Sequence[str]) -> DataFrame:
    """Each row once for every label."""
    return df.withColumn(name, F.explode(F.array(*map(F.lit, labels))))


def identity_else_grain(incoming: DataFrame, stored: DataFrame, identity: Sequence[str], grain: Sequence[str], id_column: str) -> DataFrame:
    """Incoming rows with the stored id found by identity, else by grain; ``conflict``
    where both find one and they differ."""
    def one(keys: Sequence[str], name: str) -> DataFrame:
        return stored.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])).groupBy(*keys).agg(F.min(id_column).alias(name))

    both = incoming.join(one(identity, "__a"), list(identity), "left").join(one(grain, "__b"), list(grain), "left")
    out = both.withColumn("matched_id", F.coalesce("__a", "__b")).withColumn("conflict", F.coalesce(F.col("__a") != F.col("__b"), F.lit(False)))
    how = F.when(F.col("__a").isNotNull(), "identity").when(F.col("__b").isNotNull(), "grain").otherwise("none")
    return out.withColumn("matched_by", how).drop("__a", "__b")
