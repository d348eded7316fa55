"""Idempotent writes as DataFrames: merges, inserts, guarded updates, staleness."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def upsert(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows whose key isn't incoming, and the incoming rows; keys compare
    null-safely, so a re-run can't duplicate rows with null key members."""
    return stored.join(incoming.select(*keys).distinct(), _same(stored, incoming, keys), "left_anti").unionByName(incoming, allowMissingColumns=True)


def insert_new(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The incoming rows whose key isn't stored."""
    return incoming.join(stored, _same(incoming, stored, keys), "left_anti")


def upsert_outcomes(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], row_hash: str) -> DataFrame:
    """Per incoming row: created, updated (other hash) or unchanged (replay)."""
    old = stored.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(row_hash).alias("__hash"), F.lit(True).alias("__known"))
    on = reduce(lambda x, y: x & y, [incoming[k].eqNullSafe(old[f"__{k}"]) for k in keys])
    outcome = F.when(F.col("__known").isNull(), "created").when(F.col("__hash").eqNullSafe(F.col(row_hash)), "unchanged").otherwise("updated")
    return incoming.join(old, on, "left").select(*incoming.columns, outcome.alias("outcome"))


def compare_and_set(stored: DataFrame, patches: DataFrame, key: str, revision: str, field: str) -> DataFrame:
    """patches(key, expected revision, new field) against stored(key, revision, field):
    the row after the patch, and the outcome applied, stale_revision or not_found. Of
    several patches to a key the one with the smallest value is tried."""
    p = patches.groupBy(key).agg(F.min_by(F.struct(revision, field), F.struct(revision, field)).alias("p"))
    s = stored.select(F.col(key).alias("__k"), F.col(revision).alias("__r"), F.col(field).alias("__f"))
    j = p.join(s, F.col(key) == F.col("__k"), "left")
    hit = F.col(f"p.{revision}") == F.col("__r")
    outcome = F.when(F.col("__k").isNull(), "not_found").when(hit, "applied").otherwise("stale_revision")
    return j.select(key, F.when(hit, F.col("__r") + 1).otherwise(F.col("__r")).alias(revision), F.when(hit, F.col(f"p.{field}")).otherwise(F.col("__f")).alias(field), outcome.alias("outcome"))


def staleness(open_items: DataFrame, current: DataFrame, key: str, row_hash: str) -> DataFrame:
    """Open items that the current rows no longer have (absent) or have with another
    hash (changed)."""
    now = current.select(F.col(key).alias("__k"), F.col(row_hash).alias("__h"))
    j = open_items.join(now, F.col(key) == F.col("__k"), "left")
    state = F.when(F.col("__k").isNull(), "absent").when(~F.col(row_hash).eqNullSafe(F.col("__h")), "changed")
    return j.select(key, state.alias("stale_state")).where("stale_state is not null")


def changed_fields(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Keys of both sides with the fields that differ, null-safely, in the given order."""
    o = old.select(F.col(key), *[F.col(f).alias(f"__{f}") for f in fields])
    j = new.join(o, key)
    names = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"__{f}")), F.lit(f)) for f in fields]))
    return j.select(key, F.array_join(names, ",").alias("changed"), F.size(names).cast("long").alias("n_changed")).where("n_changed > 0")


def activate(versions: DataFrame, scope: Sequence[str], version: str, status: str, wanted: int | Column) -> DataFrame:
    """Versions with the wanted draft active and the scope's former active one retired;
    a scope without that draft stays as it is."""
    draft = versions.where((F.col(version) == wanted) & (F.col(status) == "draft")).select(*[F.col(k).alias(f"__{k}") for k in scope]).distinct().withColumn("__go", F.lit(True))
    on = reduce(lambda x, y: x & y, [versions[k].eqNullSafe(draft[f"__{k}"]) for k in scope])
    go = F.coalesce("__go", F.lit(False))
    new = F.when(go & (F.col(version) == wanted) & (F.col(status) == "draft"), "active").when(go & (F.col(status) == "active"), "retired").otherwise(F.col(status))
    return versions.join(draft, on, "left").select(*[new.alias(status) if c == status else F.col(c) for c in versions.columns])


def update_where(df: DataFrame, condition: Column, values: dict[str, Column], touched: str | None = None, now: Column | None = None) -> DataFrame:
    """Rows that meet the condition take the values, and the time in ``touched``; others,
    and those for which it is unknown, stay as they are."""
    new = values | ({touched: now} if touched else {})
    return df.select(*[F.when(condition, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in df.columns])
