"""Lookups, stars, latest rows, fallbacks and pages on the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates, joins, merges, ordering
from ..sources.tables import Tables
from .registry import query


@query("""WITH requests AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS pos, lower(n_name) AS code FROM nation
  UNION ALL SELECT 100, 'atlantis' UNION ALL SELECT 101, 'Customer#000000001' UNION ALL SELECT 102, 'CUSTOMER#000000002'),
source AS (SELECT c_name AS code, (c_custkey * 3)::DOUBLE AS v FROM customer
  UNION ALL SELECT n_name, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN -1 ELSE 0.5 END FROM nation LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey
  UNION ALL SELECT n_name, 1 FROM nation WHERE n_nationkey % 5 = 0),
one AS (SELECT upper(code) AS k, count(*) AS n, min(code) AS found_key, min(v) AS v FROM source GROUP BY 1),
j AS (SELECT pos, code, found_key, v, CASE WHEN n IS NULL THEN 'not_found' WHEN n > 1 THEN 'ambiguous' WHEN v IS NULL THEN 'no_value' WHEN v < 0 OR v <> floor(v) THEN 'bad_value' ELSE 'ok' END AS status FROM requests LEFT JOIN one ON upper(code) = k)
SELECT pos::BIGINT AS pos, code, CASE WHEN status = 'ok' THEN found_key END AS found_key, CASE WHEN status = 'ok' THEN v END AS value, status FROM j""")
def lookup_classified(t: Tables) -> DataFrame:
    """Requested codes, known, unknown and ambiguous, each with one answer."""
    spark = t.spark
    extra = spark.createDataFrame([(100, "atlantis"), (101, "Customer#000000001"), (102, "CUSTOMER#000000002")], "pos long, code string")
    requests = t.nation.select((F.col("n_nationkey") + 1).cast("long").alias("pos"), F.lower("n_name").alias("code")).union(extra)
    first = t.supplier.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("s"))
    v = F.when(F.col("s") % 3 == 0, F.lit(None)).when(F.col("s") % 3 == 1, -1.0).otherwise(0.5)
    named = t.nation.join(first, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(F.col("n_name").alias("code"), v.cast("double").alias("v"))
    again = t.nation.where("n_nationkey % 5 = 0").select(F.col("n_name").alias("code"), F.lit(1.0).alias("v"))
    source = t.customer.select(F.col("c_name").alias("code"), (F.col("c_custkey") * 3).cast("double").alias("v")).union(named).union(again)
    return joins.lookup_classified(requests, source.withColumnRenamed("code", "source_code"), "code", "source_code", "v")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, o_orderdate, c_name, n_name, r_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')""")
def star_projection(t: Tables) -> DataFrame:
    regions = t.region.where(F.col("r_name").isin("ASIA", "EUROPE"))
    whole = joins.star(t.lineitem, (t.orders, "l_orderkey", "o_orderkey"), (t.customer, "o_custkey", "c_custkey"), (t.nation, "c_nationkey", "n_nationkey"), (regions, "n_regionkey", "r_regionkey"))
    return whole.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "o_orderdate", "c_name", "n_name", "r_name")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def latest_per_parent(t: Tables) -> DataFrame:
    newest = aggregates.first_row(t.orders.withColumn("d", -F.unix_micros(F.col("o_orderdate").cast("timestamp"))).withColumn("k", -F.col("o_orderkey")), ["o_custkey"], ["d", "k"], ["o_orderkey", "o_orderdate"])
    return newest.select("o_custkey", "o_orderkey", "o_orderdate")


@query("""WITH o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) AS q FROM lineitem) WHERE q = 1)
SELECT c_custkey, o_orderkey, l_linenumber, l_partkey FROM customer LEFT JOIN o ON c_custkey = o_custkey LEFT JOIN l ON o_orderkey = l_orderkey""")
def latest_chained(t: Tables) -> DataFrame:
    """A customer's latest order, and the latest line of that order."""
    o = joins.latest_per(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    l = joins.latest_per(t.lineitem, ["l_orderkey"], [F.desc(c) for c in ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")])
    return t.customer.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("c_custkey", "o_orderkey", "l_linenumber", "l_partkey")


@query("SELECT n_nationkey, n_name, e.ts AS last_ts, e.event_id AS last_event FROM nation LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 1) e ON true")
def latest_global_freshness(t: Tables) -> DataFrame:
    last = ordering.top(t.events.where("event_type = 'purchase' and ts is not null"), [F.desc("ts"), F.desc("event_id")], 1)
    return joins.with_single_row(t.nation, last).select("n_nationkey", "n_name", F.col("ts").alias("last_ts"), F.col("event_id").alias("last_event"))


@query("SELECT s_suppkey, coalesce(string_agg(DISTINCT p_brand, ',' ORDER BY p_brand), '') AS brands, count(DISTINCT p_brand) AS n_brands FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1")
def lateral_distinct_array(t: Tables) -> DataFrame:
    pairs = t.lineitem.select("l_suppkey", "l_partkey").distinct().join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    brands = pairs.groupBy("l_suppkey").agg(F.array_sort(F.collect_set("p_brand")).alias("b"))
    s = t.supplier.join(brands, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return s.select("s_suppkey", F.coalesce(F.array_join("b", ","), F.lit("")).alias("brands"), F.coalesce(F.size("b"), F.lit(0)).cast("long").alias("n_brands"))


@query("""SELECT o_orderkey, count(l_orderkey) AS n_lines, coalesce(string_agg(l_linenumber || '/' || l_partkey, ' ' ORDER BY l_linenumber, l_partkey), '') AS line_labels FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def embedded_children(t: Tables) -> DataFrame:
    nested = joins.children_nested(t.orders.select("o_orderkey"), t.lineitem, "o_orderkey", "l_orderkey", ["l_linenumber", "l_partkey"])
    label = F.transform("children", lambda x: F.concat_ws("/", x.l_linenumber.cast("string"), x.l_partkey.cast("string")))
    return nested.select("o_orderkey", F.size("children").cast("long").alias("n_lines"), F.array_join(label, " ").alias("line_labels"))


@query("""SELECT c_custkey, coalesce(CASE WHEN min(s_nationkey) = max(s_nationkey) THEN min(s_nationkey) END, min(c_nationkey)) AS resolved_nation, CASE WHEN min(s_nationkey) = max(s_nationkey) THEN 'supplier' ELSE 'own' END AS resolved_by
FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1""")
def unique_value_fallback(t: Tables) -> DataFrame:
    """The nation of a customer's suppliers if they have one in common, else its own."""
    used = joins.star(t.orders, (t.lineitem, "o_orderkey", "l_orderkey"), (t.supplier, "l_suppkey", "s_suppkey"))
    only = joins.unique_or_null(used, ["o_custkey"], "s_nationkey", "only")
    j = t.customer.join(only, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select("c_custkey", F.coalesce("only", "c_nationkey").alias("resolved_nation"), F.when(F.col("only").isNotNull(), "supplier").otherwise("own").alias("resolved_by"))


@query("""SELECT c_custkey AS left_id, s_suppkey AS right_id, match_method, confidence FROM (
  SELECT c_custkey, s_suppkey, 'nation_band' AS match_method, 1.0::DOUBLE AS confidence FROM customer JOIN supplier ON c_nationkey = s_nationkey AND floor(c_acctbal / 500)::BIGINT = floor(s_acctbal / 500)::BIGINT
  UNION ALL SELECT c_custkey, s_suppkey, 'number', 0.95::DOUBLE FROM customer JOIN supplier ON substr(c_name, 10) = substr(s_name, 10))""")
def two_key_match(t: Tables) -> DataFrame:
    band = lambda c: F.floor(F.col(c) / 500).cast("long")
    left = t.customer.select(F.col("c_custkey").alias("left_id"), "c_nationkey", band("c_acctbal").alias("c_band"), F.substring("c_name", 10, 20).alias("c_no"))
    right = t.supplier.select(F.col("s_suppkey").alias("right_id"), "s_nationkey", band("s_acctbal").alias("s_band"), F.substring("s_name", 10, 20).alias("s_no"))
    ways = [(right, [("c_nationkey", "s_nationkey"), ("c_band", "s_band")], "nation_band", 1.0), (right, [("c_no", "s_no")], "number", 0.95)]
    return joins.first_match(left, ways, "left_id", "right_id")


@query("""SELECT n_nationkey, label FROM nation, (VALUES ('shop1'), ('shop2'), ('shop3')) s(label) WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND 'shop' || (1 + s_suppkey % 3) = label)""")
def fanout_shops(t: Tables) -> DataFrame:
    """Nation and shop pairs that no supplier covers yet."""
    have = t.supplier.select(F.col("s_nationkey").alias("n_nationkey"), F.concat(F.lit("shop"), (1 + F.col("s_suppkey") % 3).cast("string")).alias("label"))
    wanted = joins.fan_out(t.nation.select("n_nationkey"), "label", ["shop1", "shop2", "shop3"])
    return merges.insert_new(have, wanted, ["n_nationkey", "label"])


@query("""WITH stored AS (SELECT s_suppkey AS id, s_nationkey AS nation, s_name AS external FROM supplier),
inc AS (SELECT c_custkey, c_nationkey AS nation, 'Supplier#' || substr(c_name, 10) AS external FROM customer),
a AS (SELECT external, min(id) AS a FROM stored GROUP BY 1), b AS (SELECT nation, min(id) AS b FROM stored GROUP BY 1)
SELECT c_custkey, coalesce(a, b) AS matched_id, coalesce(a <> b, false) AS conflict, CASE WHEN a IS NOT NULL THEN 'identity' WHEN b IS NOT NULL THEN 'grain' ELSE 'none' END AS matched_by FROM inc LEFT JOIN a USING (external) LEFT JOIN b USING (nation)""")
def identity_then_grain(t: Tables) -> DataFrame:
    stored = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.col("s_name").alias("external"))
    incoming = t.customer.select("c_custkey", F.col("c_nationkey").alias("nation"), F.concat(F.lit("Supplier#"), F.substring("c_name", 10, 20)).alias("external"))
    return joins.identity_else_grain(incoming, stored, ["external"], ["nation"], "id").select("c_custkey", "matched_id", "conflict", "matched_by")


@query("SELECT o_orderkey, o_orderdate, true AS has_more FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' OR (o_orderdate = TIMESTAMP '1998-01-01' AND o_orderkey < 5000) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def keyset_page(t: Tables) -> DataFrame:
    """A page of 50 after a cursor."""
    return ordering.keyset_page(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", ("1998-01-01", 5000), 50)


@query("""SELECT o_orderkey, o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '5-LOW' THEN 3 ELSE 99 END AS priority_rank FROM orders ORDER BY 3, o_orderkey LIMIT 500""")
def rank_map_sort(t: Tables) -> DataFrame:
    """The first 500 orders by mapped priority."""
    rank = ordering.rank_of("o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"])
    return ordering.top(t.orders.select("o_orderkey", "o_orderpriority", rank.alias("priority_rank")), [F.asc("priority_rank"), F.asc("o_orderkey")], 500)


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS position FROM events")
def running_position(t: Tables) -> DataFrame:
    return ordering.running_position(t.events.select("event_id", "user_id", "ts"), ["user_id"], [F.asc("ts"), F.asc("event_id")]).drop("ts")


@query("SELECT user_id, event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def keep_first(t: Tables) -> DataFrame:
    return aggregates.first_row(t.events, ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "ts"])


@query("SELECT event_id, user_id, value, first_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS baseline, round(value - first_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS delta FROM events")
def baseline_delta(t: Tables) -> DataFrame:
    df = ordering.against_first(t.events.select("event_id", "user_id", "value", "ts"), ["user_id"], [F.asc("ts"), F.asc("event_id")], "value")
    return df.select("event_id", "user_id", "value", "baseline", F.round("delta", 6).alias("delta"))


@query("""WITH stored AS (SELECT p_partkey AS k, p_brand AS brand, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size END AS scope FROM part WHERE p_partkey % 3 <> 0),
inc AS (SELECT p_partkey AS k, p_brand || '*' AS brand, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size END AS scope FROM part WHERE p_partkey % 2 = 0)
SELECT * FROM inc UNION ALL SELECT * FROM stored s WHERE NOT EXISTS (SELECT 1 FROM inc i WHERE i.k = s.k AND i.scope IS NOT DISTINCT FROM s.scope)""")
def null_safe_upsert(t: Tables) -> DataFrame:
    scope = F.when(F.col("p_partkey") % 4 != 0, F.col("p_size")).alias("scope")
    stored = t.part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("brand"), scope)
    incoming = t.part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("k"), F.concat("p_brand", F.lit("*")).alias("brand"), scope)
    return merges.upsert(stored, incoming, ["k", "scope"])


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN p_size % 4 + 1 ELSE p_size % 4 END AS revision, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN 'new' ELSE p_brand END AS brand,
CASE WHEN p_partkey % 5 = 0 THEN 'not_found' WHEN p_partkey % 3 = 0 THEN 'applied' ELSE 'stale_revision' END AS outcome FROM part""")
def compare_and_set(t: Tables) -> DataFrame:
    """Patches with an expected revision: a third is current, a fifth has no row."""
    revision = F.col("p_size") % 4
    stored = t.part.where("p_partkey % 5 <> 0").select("p_partkey", revision.alias("revision"), F.col("p_brand").alias("brand"))
    expected = F.when(F.col("p_partkey") % 3 == 0, revision).otherwise(revision - 1)
    return merges.compare_and_set(stored, t.part.select("p_partkey", expected.alias("revision"), F.lit("new").alias("brand")), "p_partkey", "revision", "brand")


@query("""WITH v AS (SELECT p_brand AS scope, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)::INTEGER AS version FROM part),
s AS (SELECT scope, version, CASE version WHEN 1 THEN 'retired' WHEN 2 THEN 'active' ELSE 'draft' END AS status FROM v)
SELECT scope, version, CASE WHEN version = 3 AND status = 'draft' THEN 'active' WHEN status = 'active' AND EXISTS (SELECT 1 FROM s x WHERE x.scope = s.scope AND x.version = 3 AND x.status = 'draft') THEN 'retired' ELSE status END AS status FROM s""")
def version_activation(t: Tables) -> DataFrame:
    v = ordering.running_position(t.part.select(F.col("p_brand").alias("scope"), "p_partkey"), ["scope"], [F.asc("p_partkey")], "version")
    status = F.when(F.col("version") == 1, "retired").when(F.col("version") == 2, "active").otherwise("draft")
    return merges.activate(v.select("scope", "version", status.alias("status")), ["scope"], "version", "status", 3)
