"""Import reports, relation probes, and price functions in SQL."""

import re

from pyspark.sql import functions as F

from stallwright.functions import pricing, pricing_sql
from stallwright.operators import validation
from stallwright.operators.funnel import observed, staged, step_counts
from stallwright.plans import validation as plans

from .conftest import SMALL


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_each_relation_is_scanned_once(spark, tables):
    scans = re.findall(r"Relation \[([a-z]+_[a-z]+)", plan_of(plans.import_report(tables)))
    twice = {"o_orderkey", "doc_id"}  # runs and the latest of them; documents and labels
    assert {x for x in scans if scans.count(x) > 1} <= twice
    assert len(scans) == 11


def test_repeated_keys_and_nulls(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("a", "x"), ("b", "x"), ("b", "x"), ("b", "x")], "p string, k string")
    got = validation.counted(df, {"rows": F.lit(True), "x": F.col("k") == "x"}, ["p", "k"]).collect()
    assert {r.metric: r.value for r in got} == {"rows": 6, "x": 4, "repeated": 3}
    empty = validation.counted(df.limit(0), {"rows": F.lit(True)}, ["p"]).collect()
    assert {r.metric: r.value for r in empty} == {"rows": 0, "repeated": 0}


def test_checks_of_missing_metrics(spark):
    checks = [validation.Check.equal("a", "n", 0), validation.Check.least("b", "n", 1, "WARN")]
    rows = validation.report([spark.createDataFrame([("other", 5)], "metric string, value long")], ["n"], checks).collect()
    assert [(r.no, r.check, r.status, r.detail) for r in rows] == [(1, "a", "PASS", "expected 0, got 0"), (2, "b", "WARN", "at least 1, got 0")]


def test_probe_of_the_catalog(spark):
    spark.range(7).createOrReplaceTempView("probed_relation")
    try:
        rows = validation.probe(spark, spark.table, {"probed_relation": "x", "no_such_relation": "y"}).collect()
    finally:
        spark.catalog.dropTempView("probed_relation")
    assert [tuple(r) for r in rows] == [("probed_relation", "x", True, 7), ("no_such_relation", "y", False, None)]


def test_sql_functions_are_inlined_and_agree_with_the_columns(spark):
    pricing_sql.register(spark)
    rows = [(u, f, c, r) for u in (2999.99, 3000.0, 8000.01, 12000.5, None) for f in (0.0, 450.0, None) for c in (0.0, -5.0, 1.0, 999.99, 12345.67, None) for r in ("High", "Moderate", "x", None)]
    df = spark.createDataFrame(rows, "u double, f double, c double, r string").select(*[F.col(x).cast(pricing.MONEY).alias(x) for x in "ufc"], "r")
    ex, inc = pricing.prices(F.col("u"), F.col("f"), F.col("c"), F.col("r"))
    asked = df.select(ex.alias("ex"), inc.alias("inc"), F.expr("price_excl_shipping(u, f, c, r)").alias("ex2"), F.expr("price_incl_shipping(u, f, c, r)").alias("inc2"))
    assert all(r.ex == r.ex2 and r.inc == r.inc2 for r in asked.collect())
    plan = plan_of(plans.pricing_by_sql_functions(plans.Tables(spark, SMALL)))
    assert "price_" not in plan.replace("price_excl#", "").replace("price_incl#", "")
    assert "Python" not in plan


def test_funnel_counts_in_the_run_that_reads_the_survivors(spark):
    from pyspark.sql import Observation

    df = spark.createDataFrame([(1, True, True), (2, False, True), (3, None, True), (4, True, False)], "k int, a boolean, b boolean")
    steps = {"a": F.col("a"), "b": F.col("b")}
    seen = Observation("funnel")
    assert [r.k for r in observed(staged(df, steps), steps, seen).collect()] == [1]
    assert seen.get == {"all": 4, "a": 2, "b": 1}
    assert [tuple(r) for r in step_counts(staged(df, steps), steps).collect()] == [(0, "all", 4), (1, "a", 2), (2, "b", 1)]
