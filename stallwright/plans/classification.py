"""Rule classification of orders into a prioritised work queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates, joins, merges, ordering
from ..sources.tables import Tables
from .registry import query

HIGH_VALUE = 450_000

RULES_SQL = f"""
missing_lines AS (SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)),
free_lines AS (SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_discount = 0)),
lost_customers AS (SELECT o_orderkey FROM orders o WHERE o_custkey % 97 = 5 OR NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)),
double_lines AS (SELECT l_orderkey AS o_orderkey FROM (SELECT l_orderkey, l_partkey FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1),
rules AS (
  SELECT o_orderkey, 'missing_lines' AS rule, 75 AS priority, 'high' AS severity, 1 AS business_rank, 1 AS seq, 'order has no lines' AS reason FROM missing_lines
  UNION ALL SELECT o_orderkey, 'closed_high_value', 65, 'medium', 2, 2, 'closed order of high value' FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > {HIGH_VALUE}
  UNION ALL SELECT o_orderkey, 'urgent_open', 75, 'high', 2, 3, 'urgent order is open' FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'
  UNION ALL SELECT o_orderkey, 'no_discount', 30, 'low', 0, 4, 'a line has no discount' FROM free_lines
  UNION ALL SELECT o_orderkey, 'partial', 50, 'medium', 0, 5, 'order is partly delivered' FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority IN ('1-URGENT', '2-HIGH')
  UNION ALL SELECT o_orderkey, 'lost_customer', 90, 'critical', 3, 6, 'customer of the order is unknown' FROM lost_customers
  UNION ALL SELECT o_orderkey, 'double_lines', 50, 'low', 1, 7, 'a part stands in several lines' FROM double_lines)"""

COLLAPSED_SQL = f"""
{RULES_SQL},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY priority DESC,
    CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC, business_rank DESC, seq) AS r FROM rules),
items AS (
  SELECT o_orderkey, max(CASE WHEN r = 1 THEN rule END) AS primary_rule, max(CASE WHEN r = 1 THEN severity END) AS severity,
    max(priority)::INTEGER AS max_priority, count(*) AS n_reasons, string_agg(reason, '; ' ORDER BY seq) AS reasons
  FROM ranked GROUP BY o_orderkey)"""


@query("SELECT o_orderkey, o_orderpriority, CASE WHEN o_totalprice > 250000 THEN 'high' ELSE 'normal' END AS issue_severity, 'missing_lines' AS issue_type, CAST(NULL AS VARCHAR) AS external_sku FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def missing_children(t: Tables) -> DataFrame:
    rows = joins.missing(t.orders, t.lineitem, "o_orderkey", "l_orderkey")
    severity = F.when(F.col("o_totalprice") > 250000, "high").otherwise("normal")
    return rows.select("o_orderkey", "o_orderpriority", severity.alias("issue_severity"), F.lit("missing_lines").alias("issue_type"), F.lit(None).cast("string").alias("external_sku"))


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def missing_children_nested(t: Tables) -> DataFrame:
    bare = joins.missing(t.orders, t.lineitem, "o_orderkey", "l_orderkey")
    return bare.join(t.customer, bare.o_custkey == F.col("c_custkey")).select("o_orderkey", "c_name", "c_mktsegment")


def classify(t: Tables) -> DataFrame:
    """(o_orderkey, rule, priority, severity, business_rank, seq, reason), one row for
    each rule that an order breaks. Each table is read once; order keys are unique."""
    c = F.col
    # Lines are dealt by order once; both groupings and the join keep that.
    dealt = t.lineitem.select("l_orderkey", "l_partkey", "l_discount").repartition("l_orderkey")
    of_part = dealt.groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n"), F.bool_or(c("l_discount") == 0).alias("free"))
    lines = of_part.groupBy("l_orderkey").agg(F.bool_or("free").alias("free"), (F.max("n") > 1).alias("doubled"))
    known = t.customer.where("c_custkey % 97 <> 5").select("c_custkey").distinct()
    x = t.orders.join(lines, c("o_orderkey") == c("l_orderkey"), "left").join(known, c("o_custkey") == c("c_custkey"), "left")
    status, urgent = c("o_orderstatus"), c("o_orderpriority")
    rules = [
        (c("l_orderkey").isNull(), "missing_lines", 75, "high", 1, "order has no lines"),
        ((status == "F") & (c("o_totalprice") > HIGH_VALUE), "closed_high_value", 65, "medium", 2, "closed order of high value"),
        ((status == "O") & (urgent == "1-URGENT"), "urgent_open", 75, "high", 2, "urgent order is open"),
        (c("free"), "no_discount", 30, "low", 0, "a line has no discount"),
        ((status == "P") & urgent.isin("1-URGENT", "2-HIGH"), "partial", 50, "medium", 0, "order is partly delivered"),
        (c("c_custkey").isNull(), "lost_customer", 90, "critical", 3, "customer of the order is unknown"),
        (c("doubled"), "double_lines", 50, "low", 1, "a part stands in several lines"),
    ]
    broken = [F.when(holds, F.struct(F.lit(rule).alias("rule"), F.lit(p).alias("priority"), F.lit(sev).alias("severity"), F.lit(b).alias("business_rank"), F.lit(i).alias("seq"), F.lit(why).alias("reason"))) for i, (holds, rule, p, sev, b, why) in enumerate(rules, 1)]
    return x.select("o_orderkey", F.inline(F.array_compact(F.array(*broken))))


@query(f"WITH {RULES_SQL} SELECT * FROM rules")
def rule_union_classify(t: Tables) -> DataFrame:
    return classify(t)


@query(f"WITH {COLLAPSED_SQL} SELECT * FROM items")
def rule_collapse_work_items(t: Tables) -> DataFrame:
    return aggregates.collapse_by_key(classify(t), "o_orderkey")


@query(f"""WITH {COLLAPSED_SQL}, stored AS (SELECT o_orderkey, 'double_lines' AS primary_rule, 1 AS max_priority FROM orders WHERE o_orderkey % 3 = 0)
SELECT o_orderkey, primary_rule, max_priority FROM items UNION ALL SELECT * FROM stored WHERE o_orderkey NOT IN (SELECT o_orderkey FROM items)""")
def work_item_upsert(t: Tables) -> DataFrame:
    """Today's work items over the stored ones; a second run changes nothing."""
    items = aggregates.collapse_by_key(classify(t), "o_orderkey").select("o_orderkey", "primary_rule", "max_priority")
    stored = t.orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("double_lines").alias("primary_rule"), F.lit(1).alias("max_priority"))
    return merges.upsert(merges.upsert(stored, items, ["o_orderkey"]), items, ["o_orderkey"])


@query(f"WITH {COLLAPSED_SQL} SELECT o_orderkey, primary_rule, max_priority FROM items ORDER BY max_priority DESC, o_orderkey LIMIT 200")
def workqueue_topk(t: Tables) -> DataFrame:
    """The 200 most urgent work items; a top-k report."""
    items = aggregates.collapse_by_key(classify(t), "o_orderkey")
    return ordering.top(items, [F.desc("max_priority"), F.asc("o_orderkey")], 200).select("o_orderkey", "primary_rule", "max_priority")


@query(f"""WITH {COLLAPSED_SQL} SELECT primary_rule, severity, count(*) AS n_items, count(*) FILTER (WHERE severity IN ('high', 'critical')) AS n_high,
  CASE WHEN count(*) > 0 THEN floor(avg(max_priority) + 0.5)::BIGINT ELSE 0 END AS mean_priority FROM items GROUP BY ALL""")
def workqueue_kpis(t: Tables) -> DataFrame:
    items = aggregates.collapse_by_key(classify(t), "o_orderkey")
    return items.groupBy("primary_rule", "severity").agg(F.count("*").alias("n_items"), F.count_if(F.col("severity").isin("high", "critical")).alias("n_high"), aggregates.rounded_mean("max_priority").alias("mean_priority"))


_HASH = "sha256(concat_ws('|', o_orderkey::VARCHAR, {status}, (round(o_totalprice * 100))::BIGINT::VARCHAR))"


@query(f"""WITH open_items AS (SELECT o_orderkey, {_HASH.format(status='o_orderstatus')} AS h FROM orders),
current AS (SELECT o_orderkey, {_HASH.format(status="CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END")} AS h FROM orders WHERE o_orderkey % 11 <> 0)
SELECT o.o_orderkey, CASE WHEN c.h IS NULL THEN 'absent' ELSE 'changed' END AS stale_state
FROM open_items o LEFT JOIN current c USING (o_orderkey) WHERE c.h IS NULL OR c.h <> o.h""")
def stale_marking(t: Tables) -> DataFrame:
    """Yesterday's items against today's, in which some orders changed and some went."""
    def hashed(df: DataFrame, status) -> DataFrame:
        return df.select("o_orderkey", F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), status, F.round(F.col("o_totalprice") * 100).cast("long").cast("string")), 256).alias("h"))

    changed = F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus"))
    now = t.orders.where("o_orderkey % 11 <> 0")
    return merges.staleness(hashed(t.orders, F.col("o_orderstatus")), hashed(now, changed), "o_orderkey", "h")


@query("""WITH issues AS (
  SELECT l_orderkey, 'high' AS severity, 1.0::DOUBLE AS confidence FROM lineitem WHERE l_discount = 0
  UNION ALL SELECT l_orderkey, 'medium', 0.8::DOUBLE FROM lineitem WHERE l_tax = 0
  UNION ALL SELECT l_orderkey, 'low', 0.6::DOUBLE FROM lineitem WHERE l_quantity < 3
  UNION ALL SELECT l_orderkey, 'critical', 0.9::DOUBLE FROM lineitem WHERE l_extendedprice > 99000 AND l_discount = 0),
g AS (SELECT l_orderkey, max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS r, count(*) AS n_issues,
  round(avg(confidence), 6) AS c FROM issues GROUP BY 1)
SELECT l_orderkey, CASE r WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity, n_issues,
  least(100, CASE r WHEN 4 THEN 90 WHEN 3 THEN 70 WHEN 2 THEN 40 ELSE 15 END + least(n_issues * 2, 20) + floor(c * 10 + 0.5))::BIGINT AS priority FROM g""")
def issue_groups_priority(t: Tables) -> DataFrame:
    """Line issues of an order become one work item."""
    tests = [("l_discount = 0", "high", 1.0), ("l_tax = 0", "medium", 0.8), ("l_quantity < 3", "low", 0.6), ("l_extendedprice > 99000 and l_discount = 0", "critical", 0.9)]
    found = F.array_compact(F.array(*[F.when(F.expr(p), F.struct(F.lit(s).alias("severity"), F.lit(c).alias("confidence"))) for p, s, c in tests]))
    issues = t.lineitem.select("l_orderkey", F.explode(found).alias("i")).select("l_orderkey", "i.*")
    g = issues.groupBy("l_orderkey").agg(F.max_by("severity", aggregates.severity_rank("severity")).alias("severity"), F.count("*").alias("n_issues"), F.round(F.avg("confidence"), 6).alias("c"))
    return g.select("l_orderkey", "severity", "n_issues", aggregates.work_item_priority(F.col("severity"), F.col("n_issues"), F.col("c")).alias("priority"))
