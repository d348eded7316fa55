"""Views that a catalog's screens ask for: boards, options, requests in order, windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal(c: Column) -> Column:
    """For comparing codes as people type them: outer white space and case don't count."""
    return F.lower(F.regexp_replace(c, "^\\s+|\\s+$", ""))


def matched(requests: DataFrame, known: DataFrame, code: str) -> tuple[DataFrame, DataFrame]:
    """Requests whose code is known, with the known code, and those whose isn't, both in
    normal form; a request stands in exactly one of them. Codes compare in normal form,
    and of known codes with one form the smallest counts."""
    k = known.where(normal(F.col(code)) != "").groupBy(normal(F.col(code)).alias("__n")).agg(F.min(code).alias("known"))
    asked = requests.withColumn("__n", normal(F.col(code)))
    return asked.join(k, "__n").drop("__n"), asked.join(k, "__n", "left_anti").withColumn(code, F.col("__n")).drop("__n")


def composite_counts(df: DataFrame, *parts: Column) -> DataFrame:
    """(key, n): rows by the parts joined with a bar, missing parts as ``none``."""
    return df.groupBy(F.concat_ws("|", *[F.coalesce(F.nullif(p, F.lit("")), F.lit("none")) for p in parts]).alias("key")).agg(F.count("*").alias("n"))


def options(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, options): the distinct values of each column, sorted, without nulls and
    blanks. Distinct in parts before they meet; for columns with few values."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    distinct = long.where("value is not null and value <> ''").distinct()
    return distinct.groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("options"))


def board(df: DataFrame, status: str, columns: Sequence[str], id_: str, order: Sequence[Column], shown: int) -> DataFrame:
    """(place, status, n, first): for each of the fixed columns, also the empty ones, its
    number of rows and the ids of the first ``shown`` of them; other states are left out."""
    from pyspark.sql.window import Window

    ranked = df.where(F.col(status).isin(*columns)).withColumn("__r", F.row_number().over(Window.partitionBy(status).orderBy(*order)))
    first = ranked.where(F.col("__r") <= shown).groupBy(status).agg(F.array_sort(F.collect_list(F.struct("__r", id_))).alias("f")).select(F.col(status).alias("status"), F.col(f"f.{id_}").alias("first"))
    counts = df.where(F.col(status).isin(*columns)).groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))
    places = df.sparkSession.createDataFrame([(i, s) for i, s in enumerate(columns, 1)], "place int, status string")
    kind = df.schema[id_].dataType.simpleString()
    return places.join(counts, "status", "left").join(first, "status", "left").select("place", "status", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("first", F.array().cast(f"array<{kind}>")).alias("first"))


def window_faults(start: Column, end: Column, event: Column, now: Column, ahead: str = "1 HOUR") -> Column:
    """What is wrong with a window and an event in it: order, an event past the end, and
    one further ahead of the clock than is allowed. What is missing is a fault, too."""
    rules: Mapping[str, Column] = {"window_order": start < end, "event_after_window": event <= end, "event_in_future": event <= now + F.expr(f"INTERVAL {ahead}")}
    return F.array_compact(F.array(*[F.when(~F.coalesce(holds, F.lit(False)), name) for name, holds in rules.items()]))


def activation(drafts: DataFrame, stored: DataFrame, scope: Sequence[str], rule: Column) -> DataFrame:
    """drafts(scope ..., version), stored(scope ..., version, ...) -> drafts with ``allowed``:
    false where another version of the scope already meets the uniqueness rule. One row a
    scope decides, so drafts don't multiply."""
    taken = stored.where(rule).groupBy(*scope).agg(F.min("version").alias("__lo"), F.max("version").alias("__hi"))
    j = drafts.join(taken, list(scope), "left")
    other = (F.col("__lo") != F.col("version")) | (F.col("__hi") != F.col("version"))
    return j.withColumn("allowed", ~F.coalesce(other, F.lit(False))).drop("__lo", "__hi")


def fresh_projection(rows: DataFrame, runs: DataFrame, source: str, done: Column, now: Column, within: str) -> DataFrame:
    """rows(source, ...) with the time of their source's last completed run and whether it
    is recent; rows of sources without one are not fresh. runs(source, finished, ...)."""
    last = runs.where(done).groupBy(source).agg(F.max("finished").alias("last_run"))
    return rows.join(last, source, "left").withColumn("fresh", F.coalesce(F.col("last_run") >= now - F.expr(f"INTERVAL {within}"), F.lit(False)))


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)
