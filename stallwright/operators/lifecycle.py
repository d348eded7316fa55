"""State machines over ordered events, as a batch fold; streaming.lifecycle is its twin."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Legal transitions of the listing states (fixed values).
LISTING_STATES = {"UNOPENED": ("UNOPENED", "OPENED", "CLOSED", "SUSPENDED"), "OPENED": ("OPENED", "CLOSED", "SUSPENDED"), "SUSPENDED": ("SUSPENDED", "OPENED", "CLOSED"), "CLOSED": ("CLOSED",)}


def legal(current: Column, wanted: Column, table: Mapping[str, Sequence[str]]) -> Column:
    out = F.lit(False)
    for state, nexts in table.items():
        out = F.when(current == state, wanted.isin(*nexts)).otherwise(out)
    return out


def fold(events: DataFrame, key: str, order: Sequence[str], wanted: str, start: str, table: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per key the state after all its events in order, and how many were applied and
    refused: legality depends on the state so far, so this is a fold over the key's
    ordered events. For keys with a bounded number of events; fold_runs() takes any."""
    seq = F.array_sort(F.collect_list(F.struct(*order, F.col(wanted).alias("wanted"))))
    zero = F.struct(F.lit(start).alias("state"), F.lit(0).cast("long").alias("applied"), F.lit(0).cast("long").alias("refused"))

    def step(acc: Column, e: Column) -> Column:
        ok = legal(acc.state, e.wanted, table)
        return F.struct(F.when(ok, e.wanted).otherwise(acc.state).alias("state"), (acc.applied + ok.cast("long")).alias("applied"), (acc.refused + (~ok).cast("long")).alias("refused"))

    return events.groupBy(key).agg(F.aggregate(seq, zero, step).alias("f")).select(key, "f.*")


def fold_runs(events: DataFrame, key: str, order: Sequence[str], wanted: str, start: str, table: Mapping[str, Sequence[str]], run: int = 10_000) -> DataFrame:
    """The same for keys of any size. An event maps each state to a state; runs of a
    key's events are composed into such maps in parallel (as many entries as states),
    and only the maps are folded for each key."""
    from pyspark.sql.window import Window

    states = list(table)
    numbered = events.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    seq = F.array_sort(F.collect_list(F.struct("__n", F.col(wanted).alias("wanted"))))

    def through(state: str) -> Column:
        zero = F.struct(F.lit(state).alias("state"), F.lit(0).cast("long").alias("applied"), F.lit(0).cast("long").alias("refused"))

        def step(acc: Column, e: Column) -> Column:
            ok = F.coalesce(legal(acc.state, e.wanted, table), F.lit(False))
            return F.struct(F.when(ok, e.wanted).otherwise(acc.state).alias("state"), (acc.applied + ok.cast("long")).alias("applied"), (acc.refused + (~ok).cast("long")).alias("refused"))

        return F.aggregate("seq", zero, step).alias(state)

    runs = numbered.groupBy(key, F.floor((F.col("__n") - 1) / run).alias("run")).agg(seq.alias("seq")).select(key, "run", F.struct(*map(through, states)).alias("map"))
    zero = F.struct(F.lit(start).alias("state"), F.lit(0).cast("long").alias("applied"), F.lit(0).cast("long").alias("refused"))

    def join(acc: Column, r: Column) -> Column:
        out = acc
        for s in states:
            m = r["map"][s]
            out = F.when(acc.state == s, F.struct(m.state.alias("state"), (acc.applied + m.applied).alias("applied"), (acc.refused + m.refused).alias("refused"))).otherwise(out)
        return out

    folded = runs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("run", "map"))).alias("runs"))
    return folded.select(key, F.aggregate("runs", zero, join).alias("f")).select(key, "f.*")


def claim_outcome(revision: Column, scored_revision: Column, score: Column, claim: Column, key: Column, least: int = 75) -> Column:
    """Answer to a claim for publishing: replay of the same key, taken by another,
    not_eligible (score), stale (scored at another revision), or claimed."""
    return (
        F.when(claim == key, "replay").when(claim.isNotNull(), "taken").when(F.coalesce(score, F.lit(0)) < least, "not_eligible").when(~scored_revision.eqNullSafe(revision), "stale").otherwise("claimed")
    )


def reconcile(expected: DataFrame, observed: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Observed rows with ``drift``: a filled observed field that differs from what is
    expected (an empty one never counts), and ``missing`` where nothing is expected."""
    e = expected.select(F.col(key).alias("__k"), *[F.col(f).alias(f"__{f}") for f in fields])
    j = observed.join(e, F.col(key) == F.col("__k"), "left")
    differs = F.lit(False)
    for f in fields:
        differs = differs | ((F.coalesce(F.col(f).cast("string"), F.lit("")) != "") & ~F.col(f).eqNullSafe(F.col(f"__{f}")))
    return j.select(key, F.when(F.col("__k").isNull(), "missing").when(differs, "drift").otherwise("same").alias("observation"))
