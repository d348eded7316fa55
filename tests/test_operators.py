import pytest
from pyspark.sql import functions as F

from stallwright.functions import pricing, text
from stallwright.operators import aggregates, joins, lifecycle, merges, ordering


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize(
    "unit, fee, cost, returns, expected",
    [
        (2000, 500, 2000, None, (2950, 3450)),
        (5000, 1000, 4800, "High", (7550, 8550)),
        (8000, 1200, 8000, None, (11150, 12350)),
        (8001, 1200, 8001, None, (10900, 12100)),
        (12000, 1500, 12000, "Moderate", (17350, 18850)),
        (12001, 1500, 12001, "Moderate", (16950, 18450)),
        (2000, None, 2000, None, (None, None)),
        (2000, 500, 0, None, (None, None)),
        (2000, 500, None, None, (None, None)),
    ],
)
def test_price(spark, unit, fee, cost, returns, expected):
    a, b = pricing.prices(*[F.lit(x).cast("double") for x in (unit, fee, cost)], F.lit(returns).cast("string"))
    assert (one(spark, a), one(spark, b)) == expected


def test_costs(spark):
    d = lambda x: F.lit(x).cast(pricing.MONEY)
    assert one(spark, pricing.effective_cost(d(None), d(0), d(7), d(9))) == 7
    assert one(spark, pricing.total_cost(d(1000), d(None))) == 1000


def test_collapse_by_key(spark):
    rows = [("a", "r1", 50, "high", 0, 1, "x"), ("a", "r2", 75, "high", 0, 2, "y"), ("a", "r3", 65, "high", 0, 3, "z"), ("b", "t1", 50, "low", 1, 1, "p"), ("b", "t2", 50, "low", 1, 2, "q")]
    df = spark.createDataFrame(rows, "k string, rule string, priority int, severity string, business_rank int, seq int, reason string")
    got = {r.k: r for r in aggregates.collapse_by_key(df, "k").collect()}
    assert (got["a"].primary_rule, got["a"].max_priority, got["a"].reasons) == ("r2", 75, "x; y; z")
    assert got["b"].primary_rule == "t1"  # a full tie: the first stays


def test_work_item_priority(spark):
    df = spark.createDataFrame([("k", "high", 1.0), ("k", "low", 1.0), ("k", "low", 0.6)], "k string, severity string, confidence double")
    assert aggregates.issue_groups(df, "k").first().priority == 85


def test_mode_first_and_gaps(spark):
    df = spark.createDataFrame([("s", "a", 5), ("s", "b", 1), ("s", None, 0)], "k string, v string, seq int")
    assert aggregates.mode_first(df, "k", "v", "seq", "m").first().m == "b"
    pos = spark.createDataFrame([("k", p) for p in (0, 1, 3, 5)], "k string, p int")
    assert sorted(r.missing for r in aggregates.gaps(pos, "k", "p", low=0).collect()) == [2, 4]


def test_lookup_keeps_zero_and_fails_closed(spark):
    source = spark.createDataFrame([("A", 0.0), ("b", 1.0), ("B", 2.0), ("c", None), ("d", -1.0), ("e", 1.5)], "code2 string, v double")
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "C"), (4, "d"), (5, "e"), (6, "zz"), (7, None)], "pos long, code string")
    got = [(r.status, r.value) for r in joins.lookup_classified(asked, source, "code", "code2", "v").orderBy("pos").collect()]
    assert got == [("ok", 0.0), ("ambiguous", None), ("no_value", None), ("bad_value", None), ("bad_value", None), ("not_found", None), ("not_found", None)]


def test_upsert_is_null_safe(spark):
    a = spark.createDataFrame([(1, None, "x"), (2, 5, "y")], "k int, s int, v string")
    b = spark.createDataFrame([(1, None, "new")], "k int, s int, v string")
    assert sorted(tuple(r) for r in merges.upsert(a, b, ["k", "s"]).collect() if r.s is None) == [(1, None, "new")]
    assert merges.upsert(a, b, ["k", "s"]).count() == 2
    assert merges.insert_new(a, b, ["k", "s"]).count() == 0


def test_guards(spark):
    df = spark.range(3)
    assert ordering.at_most(df, 3).count() == 3
    with pytest.raises(Exception, match="more than 2 rows"):
        ordering.at_most(df, 2).collect()
    with pytest.raises(Exception, match="not exactly one"):
        ordering.exactly_one(df).collect()
    assert ordering.exactly_one(spark.range(1)).count() == 1


def test_listing_states(spark):
    legal = lambda a, b: one(spark, lifecycle.legal(F.lit(a), F.lit(b), lifecycle.LISTING_STATES))
    assert not legal("CLOSED", "OPENED")
    assert legal("UNOPENED", "OPENED")


def test_folds_agree_with_python(spark, tables):
    from stallwright.plans.lifecycle import STEPS

    events = tables.events.select("user_id", "ts", "event_id", "event_type")
    whole = lifecycle.fold(events, "user_id", ["ts", "event_id"], "event_type", "new", STEPS)
    runs = lifecycle.fold_runs(events, "user_id", ["ts", "event_id"], "event_type", "new", STEPS, run=7)
    a, b = ({r.user_id: (r.state, r.applied, r.refused) for r in x.collect()} for x in (whole, runs))
    want = {}
    for r in sorted(events.collect(), key=lambda r: (r.ts, r.event_id)):
        state, applied, refused = want.get(r.user_id, ("new", 0, 0))
        ok = r.event_type in STEPS[state]
        want[r.user_id] = (r.event_type if ok else state, applied + ok, refused + (not ok))
    assert a == b == want


def test_text_functions(spark):
    s = lambda x: F.lit(x)
    assert one(spark, text.js_round(F.lit(-2.5))) == -2
    assert one(spark, text.money(s("￥1,234.5"))) == 1234.5
    assert one(spark, text.money(s("abc"))) is None
    assert one(spark, text.unique_words(s("Red bag red BAG blue"))) == "Red bag blue"
    assert one(spark, text.split_list(s("a| b;;c"))) == ["a", "b", "c"]
    assert one(spark, text.ngrams(s("abc"), 28)) == []
    assert one(spark, text.ngrams(s("aéb"), 2)) == ["aé", "éb"]
    assert one(spark, text.real_date(s("2026-02-30"))) is False
    assert one(spark, text.real_date(s("2026-02-28"))) is True
    assert one(spark, text.zoned_timestamp(s("2026-02-28T00:00:00"))) is False
    assert one(spark, text.zoned_timestamp(s("2026-02-28T00:00:00Z"))) is True
    assert one(spark, text.utf8_cap(s("aéé"), 4)) == "aé"
    assert one(spark, text.repeated_marks(s("wow!!"))) is True
    assert one(spark, text.visible_text(s("<p>a&amp;b<br>c</p><script>x</script>"))) == "a&b\nc"
    assert one(spark, text.numbers_in(s("10cm and 10cm, 3kg"))) == ["10cm", "3kg"]


def test_changed_fields_and_activation(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "a", "b")], "k int, x string, y string")
    new = spark.createDataFrame([(1, "a", "c"), (2, "a", "b")], "k int, x string, y string")
    assert [tuple(r) for r in merges.changed_fields(old, new, "k", ["x", "y"]).collect()] == [(1, "y", 1)]
    v = spark.createDataFrame([("s", 1, "active"), ("s", 2, "draft"), ("t", 1, "active")], "scope string, version int, status string")
    got = sorted(tuple(r) for r in merges.activate(v, ["scope"], "version", "status", 2).collect())
    assert got == [("s", 1, "retired"), ("s", 2, "active"), ("t", 1, "active")]
