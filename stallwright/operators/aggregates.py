"""Grouped computations: collapsing rules, consensus, modes, gaps, checks, duplicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranks of severities (fixed values); anything else ranks 0.
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}


def severity_rank(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    out = F.lit(0)
    for name, rank in SEVERITY_RANK.items():
        out = F.when(c == name, rank).otherwise(out)
    return out


def collapse_by_key(rows: DataFrame, key: str) -> DataFrame:
    """rows(key, rule, priority, severity, business_rank, seq, reason) -> one row for
    each key: the primary rule by priority, severity, business rank, then the first
    (smallest seq); the largest priority; the reasons in order of seq. For keys with a
    bounded number of rules."""
    best = F.struct("priority", severity_rank("severity").alias("s"), "business_rank", (-F.col("seq")).alias("first"))
    return rows.groupBy(key).agg(
        F.max_by("rule", best).alias("primary_rule"),
        F.max_by("severity", best).alias("severity"),
        F.max("priority").alias("max_priority"),
        F.count("*").alias("n_reasons"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "reason"))), lambda x: x.reason), "; ").alias("reasons"),
    )


def consensus(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Per key the value if every row has it and it is the same in all, else null."""
    same = (F.count(value) == F.count("*")) & (F.min(value) == F.max(value))
    return df.groupBy(*keys).agg(F.when(same, F.min(value)).alias(name))


def mode_first(df: DataFrame, key: str, value: str, seq: str, name: str) -> DataFrame:
    """Per key the most frequent value, of equally frequent ones that seen first."""
    each = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"), F.min(seq).alias("first"))
    return each.groupBy(key).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(name), F.max("n").alias("n_rows"))


def first_row(df: DataFrame, keys: Sequence[str], seq: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Per key the fields of the row with the smallest seq, by partial aggregation."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*fields), F.struct(*seq)).alias("__f")).select(*keys, "__f.*")


def gaps(df: DataFrame, key: str, position: str, low: int = 1) -> DataFrame:
    """(key, missing): positions low .. largest that no row has. For bounded positions."""
    have = df.groupBy(key).agg(F.collect_set(position).alias("have"), F.max(position).alias("top"))
    wanted = F.when(F.col("top") >= low, F.sequence(F.lit(low), F.col("top"))).otherwise(F.array().cast("array<int>"))
    return have.select(key, F.explode(F.array_except(wanted, F.col("have"))).alias("missing"))


def zero_filled(df: DataFrame, column: str, domain: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One count column for each value of a fixed domain, 0 where there is none."""
    counts = [F.count_if(F.col(column) == v).alias(f"n_{i}_{''.join(ch if ch.isalnum() else '_' for ch in v.lower())}") for i, v in enumerate(domain)]
    return (df.groupBy(*by) if by else df).agg(*counts)


def named_checks(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """(check_name, row_count) of each predicate, in one pass over df."""
    one = df.agg(*[F.count_if(F.coalesce(p, F.lit(False))).alias(k) for k, p in checks.items()])
    pairs = ", ".join(f"'{k}', `{k}`" for k in checks)
    return one.selectExpr(f"stack({len(checks)}, {pairs}) as (check_name, row_count)")


def duplicate_groups(df: DataFrame, key: Sequence[str | Column], member: str) -> DataFrame:
    """Keys with two rows or more: their number, and smallest and largest member."""
    return df.groupBy(*key).agg(F.count("*").alias("n_members"), F.min(member).alias("first_member"), F.max(member).alias("last_member")).where("n_members > 1")


def histogram(df: DataFrame, array: str | Column, name: str) -> DataFrame:
    """Rows that have each element of an array column."""
    return df.select(F.explode(F.array_distinct(array)).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def rounded_mean(c: str | Column) -> Column:
    """Mean rounded half up; 0 for none."""
    return F.coalesce(F.floor(F.avg(c) + 0.5), F.lit(0)).cast("long")


def work_item_priority(severity: Column, n_issues: Column, confidence: Column) -> Column:
    """min(100, base of the severity + 2 an issue up to 20 + 10 times the confidence)."""
    base = F.when(severity == "critical", 90).when(severity == "high", 70).when(severity == "medium", 40).when(severity == "low", 15).otherwise(30)
    return F.least(F.lit(100), base + F.least(n_issues * 2, F.lit(20)) + F.floor(confidence * 10 + 0.5)).cast("long")


def issue_groups(issues: DataFrame, key: str) -> DataFrame:
    """issues(key, severity, confidence) -> per key the worst severity, the number of
    issues and the priority of one work item for all of them."""
    g = issues.groupBy(key).agg(F.max_by("severity", severity_rank("severity")).alias("severity"), F.count("*").alias("n_issues"), F.avg("confidence").alias("c"))
    return g.select(key, "severity", "n_issues", work_item_priority(F.col("severity"), F.col("n_issues"), F.col("c")).alias("priority"))


def merged_json(c: Column, more: Column) -> Column:
    """A flat JSON object with the entries of a map over its own; other keys stay."""
    own = F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(own, lambda k, v: ~F.map_contains_key(more, k))
    return F.to_json(F.map_concat(kept, more))
