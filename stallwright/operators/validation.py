"""Reports on what was imported: counts of several relations against what is expected.

Each relation is read once: its conditions are counted in one aggregate, over its keys
first where repeated keys count too.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def counted(df: DataFrame, conditions: Mapping[str, Column], key: Sequence[str] = (), repeated: str = "repeated") -> DataFrame:
    """(metric, value) rows: how many rows meet each condition; with a key also how many
    rows repeat an earlier key (null is a key like any other). One scan, partial counts."""
    per_key = [F.count_if(c).alias(name) for name, c in conditions.items()]
    if not key:
        one = df.agg(*per_key)
    else:
        groups = df.groupBy(*key).agg(F.count("*").alias("__n"), *per_key)
        one = groups.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias(repeated), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in conditions])
    names = [*conditions, *([repeated] if key else [])]
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("long").alias("value")) for n in names])))


def latest_run(runs: DataFrame, id_: str, finished: str, of: Column) -> DataFrame:
    """The id of the run that finished last of those that meet a condition: at most one row."""
    return runs.where(of).agg(F.max_by(id_, F.struct(finished, id_)).alias(id_)).where(f"{id_} is not null")


@dataclass(frozen=True)
class Check:
    """``passes`` of the metrics' columns gives PASS, else ``otherwise``; ``detail`` is text."""

    name: str
    passes: Column
    detail: Column
    otherwise: str = "FAIL"

    @staticmethod
    def equal(name: str, metric: str, expected: int | Column, otherwise: str = "FAIL") -> Check:
        e = F.lit(expected) if isinstance(expected, int) else expected
        return Check(name, F.col(metric) == e, F.concat(F.lit("expected "), e.cast("string"), F.lit(", got "), F.col(metric).cast("string")), otherwise)

    @staticmethod
    def least(name: str, metric: str, least: int, otherwise: str = "FAIL") -> Check:
        return Check(name, F.col(metric) >= least, F.concat(F.lit(f"at least {least}, got "), F.col(metric).cast("string")), otherwise)


def report(metrics: Sequence[DataFrame], names: Sequence[str], checks: Sequence[Check]) -> DataFrame:
    """(metric, value) tables of several relations -> (check, status, detail), a row for each
    check, in their order by ``no``; a metric that no table has counts as 0."""
    one = reduce(DataFrame.union, metrics).agg(*[F.coalesce(F.max(F.when(F.col("metric") == n, F.col("value"))), F.lit(0)).alias(n) for n in names])
    rows = [F.struct(F.lit(i).alias("no"), F.lit(c.name).alias("check"), F.when(c.passes, "PASS").otherwise(c.otherwise).alias("status"), c.detail.alias("detail")) for i, c in enumerate(checks, 1)]
    return one.select(F.inline(F.array(*rows)))


def probe(spark: SparkSession, read: Callable[[str], DataFrame], needed_for: Mapping[str, str]) -> DataFrame:
    """(name, required_for, present, n_rows) of relations; one that can't be found is a row
    with no count, not an error. ``read`` is spark.table for a catalog's relations."""
    rows = []
    for name, purpose in needed_for.items():
        try:
            found = read(name).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), F.lit(purpose).alias("required_for"), F.lit(True).alias("present"), "n_rows")
        except AnalysisException:
            found = spark.range(1).select(F.lit(name).alias("name"), F.lit(purpose).alias("required_for"), F.lit(False).alias("present"), F.lit(None).cast("long").alias("n_rows"))
        rows.append(found)
    return reduce(DataFrame.union, rows)
