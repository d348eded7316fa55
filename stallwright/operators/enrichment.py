"""Enrichment of listings from several sides of the catalog."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def only(value: str) -> Column:
    """Aggregate: the value where a group has exactly one, else null."""
    return F.when(F.min(value) == F.max(value), F.min(value))


def lookup_last(facts: DataFrame, dimension: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Facts with the value of the dimension's last row of their key; blank keys of the
    dimension are no keys. The dimension is aggregated first, so facts don't multiply."""
    last = dimension.where(F.trim(F.coalesce(key, F.lit(""))) != "").groupBy(key).agg(F.max_by(value, order).alias(value))
    return facts.join(last, key, "left")


def id_else_name(rows: DataFrame, targets: DataFrame, scope: Sequence[str], by_id: str, by_name: str, value: str) -> DataFrame:
    """Rows with the smallest target of their scope and id; rows without an id match by
    name (rows with one never do)."""
    on_id = targets.where(F.col(by_id).isNotNull()).groupBy(*scope, by_id).agg(F.min(value).alias("__by_id"))
    on_name = targets.groupBy(*scope, by_name).agg(F.min(value).alias("__by_name"))
    j = rows.join(on_id, [*scope, by_id], "left").join(on_name, [*scope, by_name], "left")
    return j.withColumn(value, F.when(F.col(by_id).isNotNull(), F.col("__by_id")).otherwise(F.col("__by_name"))).drop("__by_id", "__by_name")


def per_shop(variants: DataFrame, listings: DataFrame, shops: Sequence[str]) -> DataFrame:
    """variants(variant, sku, ...), listings(listing, shop, variant, sku, price) -> each
    variant with, for every shop, the number of its listings, the latest, its price and
    whether one is a legacy listing (without a variant, matched by sku). Linked and
    legacy listings are disjoint; a pivot over the fixed shops is one aggregate."""
    linked = listings.where("variant is not null").select("listing", "shop", "price", "variant", F.lit(False).alias("legacy"))
    coded = listings.where("variant is null").drop("variant").join(variants.select("variant", "sku"), "sku").select("listing", "shop", "price", "variant", F.lit(True).alias("legacy"))
    wanted = linked.unionByName(coded)

    def at(shop: str) -> list[Column]:
        own = lambda c: F.when(F.col("shop") == shop, F.col(c))
        return [F.count(own("listing")).alias(f"{shop}_n"), F.max(own("listing")).alias(f"{shop}_latest"), F.max_by("price", F.when(F.col("shop") == shop, F.struct("listing", "price"))).alias(f"{shop}_price"), F.coalesce(F.max(own("legacy")), F.lit(False)).alias(f"{shop}_legacy")]

    rows = wanted.groupBy("variant").agg(*reduce(lambda a, b: a + b, map(at, shops)))
    filled = {f"{s}_n": 0 for s in shops} | {f"{s}_legacy": False for s in shops}
    return variants.join(rows, "variant", "left").fillna(filled)


def as_seen_by(df: DataFrame, row_key: str, allowed: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The rows whose key is allowed (all, if none is named) with the allowed columns."""
    return (df.where(F.col(row_key).isin(*allowed)) if allowed else df).select(*columns)


def appended(items: Column, item: Column) -> Column:
    """The array with the item at its end, unless it has it."""
    return F.when(F.array_contains(items, item), items).otherwise(F.concat(items, F.array(item)))


def prepended(items: Column, item: Column) -> Column:
    """The array with the item at its start, unless it has it or there is none."""
    return F.when(item.isNull() | F.array_contains(items, item), items).otherwise(F.concat(F.array(item), items))


def resolved_codes(coded: DataFrame, known: DataFrame, listing: str) -> tuple[DataFrame, DataFrame]:
    """coded(listing, code), known(code, variant) -> (listing, variant, n_codes,
    n_unresolved), the variant only where all resolved codes name one; and the rows
    (listing, code, fingerprint) whose code is blank or unknown."""
    cleaned = coded.select(listing, F.trim("code").alias("code")).join(known.groupBy(F.trim("code").alias("code")).agg(F.max("variant").alias("variant")).where("code <> ''"), "code", "left")
    resolved = cleaned.groupBy(listing).agg(only("variant").alias("variant"), F.count("*").alias("n_codes"), F.count_if(F.col("variant").isNull()).alias("n_unresolved"))
    return resolved, cleaned.where("variant is null").select(listing, "code", F.substring(F.sha2(F.coalesce("code", F.lit("")), 256), 1, 12).alias("fingerprint"))
