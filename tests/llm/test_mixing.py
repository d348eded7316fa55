import math

from stallwright.llm import mixing

from ..conftest import SMALL
from ..oracle import assert_same
from .brute import empty, odd


def test_query_matches_oracle(spark):
    assert_same(mixing.op1_poisson_mix(spark, SMALL), mixing.SQL["op1_poisson_mix"], SMALL)


def test_poisson_table(spark):
    from pyspark.sql import functions as F

    cdf = spark.range(1).select(mixing.poisson_table(F.lit(2.5)).alias("c")).first().c
    want = [sum(math.exp(-2.5) * 2.5**k / math.factorial(k) for k in range(n + 1)) for n in range(10)]
    assert all(math.isclose(a, b, rel_tol=1e-12) for a, b in zip(cdf, want, strict=False))
    assert cdf[-1] > 1 - 1e-12


def test_counts_have_the_target_mean(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "'aaaa' as text", "case when id % 4 = 0 then 'big' else 'small' end as source")
    got = {r.source: r["count"] for r in mixing.poisson_mix(df, {"big": 3.0, "small": 1.0}, epochs=2.0).groupBy("source").count().collect()}
    assert abs(got["big"] - 30_000) < 5 * math.sqrt(30_000)
    assert abs(got["small"] - 10_000) < 5 * math.sqrt(10_000)


def test_large_rates_and_unweighted_sources(spark):
    df = spark.createDataFrame([(1, "x" * 10, "a"), (2, "y" * 990, "b"), (3, "z", "c")], "doc_id long, text string, source string")
    got = {r.source: r["count"] for r in mixing.poisson_mix(df, {"a": 1.0}, epochs=20.0).groupBy("source").count().collect()}
    assert set(got) == {"a"} and abs(got["a"] - 2002) < 250


def test_awkward_rows(spark):
    a = mixing.poisson_mix(odd(spark), epochs=3.0)
    assert a.columns == [*odd(spark).columns, "copy_no", "shuffle_key"]
    rows = a.collect()
    assert rows == mixing.poisson_mix(odd(spark), epochs=3.0).collect()  # the same draws and order each time
    assert [r.shuffle_key for r in rows] == sorted(r.shuffle_key for r in rows)
    assert mixing.poisson_mix(empty(spark)).count() == 0
    blank = odd(spark).where("doc_id in (3, 4)")
    assert mixing.poisson_mix(blank).count() == 0  # sources of no characters


def test_clashing_names(spark):
    from pyspark.sql import functions as F

    docs = odd(spark)
    for name in ("src", "id", "cdf", "parts", "n", "doc", "__src", "__id", "a.b"):
        docs = docs.withColumn(name, F.lit(1))
    out = mixing.poisson_mix(docs)
    assert out.columns == [*docs.columns, "copy_no", "shuffle_key"]
    assert sorted(map(repr, (r.doc_id for r in out.collect()))) == sorted(map(repr, (r.doc_id for r in mixing.poisson_mix(odd(spark)).collect())))
