"""Selection funnels: rows pass named steps in order; what each step leaves is counted."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def staged(df: DataFrame, steps: Mapping[str, Column]) -> DataFrame:
    """Adds lost_at: the number (from 1) of the first step that a row doesn't pass, null
    counting as not; null for rows that pass all."""
    out = F.lit(None).cast("int")
    for i, passed in reversed(list(enumerate(steps.values(), 1))):
        out = F.when(~F.coalesce(passed, F.lit(False)), i).otherwise(out)
    return df.withColumn("lost_at", out)


def _left(i: int) -> Column:
    return F.count_if(F.col("lost_at").isNull() | (F.col("lost_at") > i))


def step_counts(df: DataFrame, steps: Mapping[str, Column] | list[str]) -> DataFrame:
    """(step, name, n_left) of a staged table, step 0 being all rows; one aggregate."""
    names = ["all", *steps]
    one = df.agg(*[_left(i).alias(f"n{i}") for i in range(len(names))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("name"), F.col(f"n{i}").alias("n_left")) for i, n in enumerate(names)])))


def observed(df: DataFrame, steps: Mapping[str, Column], seen: Observation) -> DataFrame:
    """The rows of a staged table that pass all steps; the run that reads them leaves the
    number of rows after each step in ``seen``, without a scan of its own."""
    return df.observe(seen, *[_left(i).alias(n) for i, n in enumerate(["all", *steps])]).where("lost_at is null").drop("lost_at")
