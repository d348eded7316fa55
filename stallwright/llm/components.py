"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, written


#: Up to so many edges a hub's rows are no matter, and a round is one job.
FEW_EDGES = 200_000


def _hook(pairs: DataFrame, many: bool) -> DataFrame:
    """pairs(u, v): adds m, the smallest of u and all its v. Of many pairs the minima are
    a written table, so that the rows of a hub can be split by the skew join."""
    least = pairs.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
    return pairs.join(written(least, "cc-least") if many else least, "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long), any direction, repeats allowed -> (node, component),
    component the smallest node reachable; nodes without an edge don't appear.

    Each round is partial aggregates and equi-joins, of written tables where there are
    many edges; the star rounds end after O(log^2) rounds, and a round's own tables go
    at its end. Only a count and a sum reach the driver. Nulls and loops are ignored."""
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before = written(e, "cc"), None
    while True:
        n, total = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if n == 0 or (n, total) == before:
            break
        before, many = (n, total), n > FEW_EDGES
        kept = written if many else lambda df, label: df
        with scratch():
            both = kept(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), "cc-both")
            large = kept(_hook(both, many).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large")
            hooked = _hook(large, many)
            small = hooked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(hooked.select("u", F.col("m").alias("v")))
            e = written(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc", outer=True)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
