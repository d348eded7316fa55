"""Grouped reports: modes, consensus, duplicates, gaps, checks, grids, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pricing, text
from ..operators import aggregates, merges
from ..sources.tables import Tables
from .registry import query

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("SELECT p_brand, p_type AS common_type, n AS n_rows FROM (SELECT p_brand, p_type, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, min(p_partkey)) AS r FROM part GROUP BY 1, 2) WHERE r = 1")
def collapse_mode_first(t: Tables) -> DataFrame:
    return aggregates.mode_first(t.part, "p_brand", "p_type", "p_partkey", "common_type")


@query("SELECT l_orderkey, CASE WHEN count(l_returnflag) = count(*) AND min(l_returnflag) = max(l_returnflag) THEN min(l_returnflag) END AS agreed_flag FROM lineitem GROUP BY 1")
def consensus_value(t: Tables) -> DataFrame:
    return aggregates.consensus(t.lineitem, ["l_orderkey"], "l_returnflag", "agreed_flag")


@query("SELECT sha256(text) AS text_hash, count(*) AS n_members, min(doc_id) AS first_member, max(doc_id) AS last_member FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_groups(t: Tables) -> DataFrame:
    return aggregates.duplicate_groups(t.documents.select(F.sha2("text", 256).alias("text_hash"), "doc_id"), ["text_hash"], "doc_id")


@query("""WITH h AS (SELECT 'text' AS kind, sha256(text) AS hash, doc_id FROM documents UNION ALL SELECT 'size and language', sha256(lang || ':' || n_chars), doc_id FROM documents), g AS (SELECT hash, list_sort(list(doc_id)) AS members, min(kind) AS kind FROM h WHERE hash IS NOT NULL GROUP BY hash HAVING count(*) > 1)
SELECT members, min(kind) AS kind FROM g GROUP BY 1""")
def dup_member_lists(t: Tables) -> DataFrame:
    """Groups of equal documents by either of two hashes, with their sorted members; a
    group that both hashes find counts once. For groups whose lists fit in a row."""
    h = lambda kind, c: t.documents.select(F.lit(kind).alias("kind"), F.sha2(c, 256).alias("hash"), "doc_id")
    both = h("text", F.col("text")).union(h("size and language", F.concat("lang", F.lit(":"), F.col("n_chars").cast("string")))).where("hash is not null")
    groups = both.groupBy("hash").agg(F.array_sort(F.collect_list("doc_id")).alias("members"), F.min("kind").alias("kind")).where(F.size("members") > 1)
    return groups.groupBy("members").agg(F.min("kind").alias("kind"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_members, min(l_partkey) AS first_member, max(l_partkey) AS last_member FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dup_line_numbers(t: Tables) -> DataFrame:
    return aggregates.duplicate_groups(t.lineitem, ["l_orderkey", "l_linenumber"], "l_partkey")


@query("SELECT count(*) AS n_rows, count(DISTINCT (l_orderkey, l_linenumber)) AS n_distinct, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS n_duplicates FROM lineitem")
def duplicate_row_count(t: Tables) -> DataFrame:
    per_key = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    return per_key.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_distinct"), (F.sum("n") - F.count("*")).alias("n_duplicates"))


@query("WITH m AS (SELECT l_orderkey, max(l_linenumber) AS top FROM lineitem GROUP BY 1) SELECT l_orderkey, i::INTEGER AS missing FROM m, range(1, 100) r(i) WHERE i <= top AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = m.l_orderkey AND l.l_linenumber = i)")
def gap_detection(t: Tables) -> DataFrame:
    return aggregates.gaps(t.lineitem, "l_orderkey", "l_linenumber")


@query("SELECT o_orderstatus, " + ", ".join(f"count(*) FILTER (WHERE o_orderpriority = '{p}') AS n_{i}_{''.join(c if c.isalnum() else '_' for c in p.lower())}" for i, p in enumerate((*PRIORITIES, "6-NONE"))) + " FROM orders GROUP BY 1")
def zero_filled_counts(t: Tables) -> DataFrame:
    return aggregates.zero_filled(t.orders, "o_orderpriority", (*PRIORITIES, "6-NONE"), ["o_orderstatus"])


@query("""SELECT 'no_price' AS check_name, count(*) FILTER (WHERE o_totalprice IS NULL) AS row_count FROM orders UNION ALL SELECT 'negative_price', count(*) FILTER (WHERE o_totalprice < 0) FROM orders
UNION ALL SELECT 'high_price', count(*) FILTER (WHERE o_totalprice > 400000) FROM orders UNION ALL SELECT 'odd_status', count(*) FILTER (WHERE o_orderstatus IS DISTINCT FROM 'F' AND o_orderstatus IS DISTINCT FROM 'O') FROM orders UNION ALL SELECT 'all_rows', count(*) FROM orders""")
def named_checks(t: Tables) -> DataFrame:
    status = F.col("o_orderstatus")
    return aggregates.named_checks(
        t.orders,
        {"no_price": F.col("o_totalprice").isNull(), "negative_price": F.col("o_totalprice") < 0, "high_price": F.col("o_totalprice") > 400000, "odd_status": ~status.eqNullSafe("F") & ~status.eqNullSafe("O"), "all_rows": F.lit(True)},
    )


@query("""WITH m AS (SELECT 'orders' AS relation, count(*) AS n, 15 * (SELECT count(*) FROM customer) / 2 AS least FROM orders UNION ALL SELECT 'lineitem', count(*), (SELECT count(*) FROM orders) FROM lineitem UNION ALL SELECT 'nation', count(*), 30 FROM nation)
SELECT relation, n AS n_rows, CASE WHEN n >= least THEN 'PASS' WHEN n > 0 THEN 'WARN' ELSE 'FAIL' END AS verdict FROM m""")
def import_validation(t: Tables) -> DataFrame:
    """Row counts against thresholds taken from other tables or parameters."""
    n = lambda df: df.agg(F.count("*").alias("n"))
    customers, orders = n(t.customer).withColumnRenamed("n", "c"), n(t.orders)
    rows = [
        orders.join(F.broadcast(customers)).select(F.lit("orders").alias("relation"), "n", (F.col("c") * 15 / 2).alias("least")),
        n(t.lineitem).join(F.broadcast(orders.withColumnRenamed("n", "o"))).select(F.lit("lineitem").alias("relation"), "n", F.col("o").cast("double").alias("least")),
        n(t.nation).select(F.lit("nation").alias("relation"), "n", F.lit(30.0).alias("least")),
    ]
    whole = rows[0].union(rows[1]).union(rows[2])
    return whole.select("relation", F.col("n").alias("n_rows"), F.when(F.col("n") >= F.col("least"), "PASS").when(F.col("n") > 0, "WARN").otherwise("FAIL").alias("verdict"))


PRICE_SQL = """base AS (SELECT p_partkey, (p_retailprice * 8)::DECIMAL(18,2) AS unit, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE (p_size * 30)::DECIMAL(18,2) END AS fee,
  CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE (p_retailprice * 7)::DECIMAL(18,2) END AS manual, CASE WHEN p_partkey % 14 = 0 THEN NULL ELSE (p_retailprice * 8)::DECIMAL(18,2) END AS baseline,
  CASE p_type WHEN 'PROMO' THEN 'High' WHEN 'LARGE' THEN 'Moderate' END AS rma FROM part),
costed AS (SELECT *, coalesce(nullif(manual, 0), nullif(baseline, 0)) AS cost FROM base),
priced AS (SELECT *, (((cost + fee)::DOUBLE / 0.76) * (CASE WHEN unit > 12000 THEN 0.98 WHEN unit > 8000 THEN 1.00 WHEN unit < 3000 THEN 1.05 ELSE 1.02 END)::DOUBLE * (CASE rma WHEN 'High' THEN 1.1 WHEN 'Moderate' THEN 1.06 ELSE 1.0 END)::DOUBLE - fee::DOUBLE) AS gross FROM costed),
final AS (SELECT p_partkey, cost, fee, round(gross / 50) * 50 AS ex FROM priced)"""


def _priced(t: Tables) -> DataFrame:
    d = lambda c: c.cast("decimal(18,2)")
    key = F.col("p_partkey")
    df = t.part.select(
        "p_partkey",
        d(F.col("p_retailprice") * 8).alias("unit"),
        F.when(key % 13 != 0, d(F.col("p_size") * 30)).alias("fee"),
        F.when(key % 7 == 0, d(F.lit(0))).otherwise(d(F.col("p_retailprice") * 7)).alias("manual"),
        F.when(key % 14 != 0, d(F.col("p_retailprice") * 8)).alias("baseline"),
        F.when(F.col("p_type") == "PROMO", "High").when(F.col("p_type") == "LARGE", "Moderate").alias("rma"),
    )
    df = df.withColumn("cost", pricing.effective_cost(F.col("manual").cast(pricing.MONEY), F.col("baseline").cast(pricing.MONEY)))
    ex, inc = pricing.prices(F.col("unit"), F.col("fee"), F.col("cost"), F.col("rma"))
    return df.withColumn("price_excl", ex).withColumn("price_incl", inc).withColumn("tcogs", pricing.total_cost(F.col("cost"), F.col("fee").cast(pricing.MONEY)).cast("double"))


@query(f"""WITH {PRICE_SQL} SELECT p_partkey, CASE WHEN cost > 0 AND fee IS NOT NULL THEN greatest(ex, 0)::DOUBLE END AS price_excl, CASE WHEN cost > 0 AND fee IS NOT NULL THEN greatest(round((ex + fee::DOUBLE) / 50) * 50, 0)::DOUBLE END AS price_incl,
(cost + coalesce(fee, 0))::DOUBLE AS tcogs FROM final""")
def pricing_formula(t: Tables) -> DataFrame:
    return _priced(t).select("p_partkey", "price_excl", "price_incl", "tcogs")


@query(f"""WITH {PRICE_SQL}, x AS (SELECT cost, fee, CASE WHEN cost > 0 AND fee IS NOT NULL THEN greatest(round((ex + fee::DOUBLE) / 50) * 50, 0) END AS inc FROM final)
SELECT 'price_without_cost' AS check_name, count(*) FILTER (WHERE cost IS NULL AND inc IS NOT NULL) AS row_count FROM x UNION ALL SELECT 'price_without_fee', count(*) FILTER (WHERE fee IS NULL AND inc IS NOT NULL) FROM x
UNION ALL SELECT 'below_cost', count(*) FILTER (WHERE inc < cost + fee) FROM x UNION ALL SELECT 'priced', count(inc) FROM x UNION ALL SELECT 'rows', count(*) FROM x""")
def pricing_consistency(t: Tables) -> DataFrame:
    inc = F.col("price_incl")
    return aggregates.named_checks(
        _priced(t),
        {"price_without_cost": F.col("cost").isNull() & inc.isNotNull(), "price_without_fee": F.col("fee").isNull() & inc.isNotNull(), "below_cost": inc < F.col("tcogs"), "priced": inc.isNotNull(), "rows": F.lit(True)},
    )


@query("SELECT p_partkey, floor(p_retailprice * 0.95::DOUBLE * 100 + 0.5) / 100 AS suggested_price FROM part WHERE p_size > 0 AND p_retailprice IS NOT NULL AND p_type = 'PROMO'")
def promotion_candidates(t: Tables) -> DataFrame:
    eligible = t.part.where("p_size > 0 and p_retailprice is not null and p_type = 'PROMO'")
    return eligible.select("p_partkey", pricing.promotion_price(F.col("p_retailprice")).alias("suggested_price"))


@query("""WITH a AS (SELECT o_orderkey, o_orderdate AS d, o_orderpriority AS p, o_orderstatus AS s FROM orders WHERE o_orderstatus <> 'F')
SELECT o_orderkey, bucket FROM (
  SELECT o_orderkey, 'overdue' AS bucket FROM a WHERE d < TIMESTAMP '2001-07-01' UNION ALL SELECT o_orderkey, 'today' FROM a WHERE d = TIMESTAMP '2001-07-01'
  UNION ALL SELECT o_orderkey, 'next_7_days' FROM a WHERE d >= TIMESTAMP '2001-07-01' AND d <= TIMESTAMP '2001-07-08' UNION ALL SELECT o_orderkey, 'waiting' FROM a WHERE s = 'P' UNION ALL SELECT o_orderkey, 'urgent' FROM a WHERE p = '1-URGENT')""")
def due_buckets(t: Tables) -> DataFrame:
    """Open orders under every label that holds as of a fixed day."""
    d, as_of = F.col("o_orderdate").cast("timestamp"), F.lit("2001-07-01").cast("timestamp")
    labels = [(d < as_of, "overdue"), (d == as_of, "today"), ((d >= as_of) & (d <= F.date_add(as_of, 7).cast("timestamp")), "next_7_days"), (F.col("o_orderstatus") == "P", "waiting"), (F.col("o_orderpriority") == "1-URGENT", "urgent")]
    return t.orders.where("o_orderstatus <> 'F'").select("o_orderkey", F.explode(F.array_compact(F.array(*[F.when(p, F.lit(x)) for p, x in labels]))).alias("bucket"))


@query("""WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) ELSE p_name END AS p_name, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_type END AS p_type, p_size + (p_partkey % 10 = 3)::INTEGER AS p_size FROM part),
c AS (SELECT p_partkey, concat_ws(',', CASE WHEN n.p_name IS DISTINCT FROM o.p_name THEN 'p_name' END, CASE WHEN n.p_type IS DISTINCT FROM o.p_type THEN 'p_type' END, CASE WHEN n.p_size IS DISTINCT FROM o.p_size THEN 'p_size' END) AS changed FROM n JOIN part o USING (p_partkey))
SELECT p_partkey, changed, len(string_split(changed, ','))::BIGINT AS n_changed FROM c WHERE changed <> ''""")
def change_detection(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    new = t.part.select("p_partkey", F.when(k % 5 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("p_name"), F.when(k % 6 != 0, F.col("p_type")).alias("p_type"), (F.col("p_size") + (k % 10 == 3).cast("int")).alias("p_size"))
    return merges.changed_fields(t.part, new, "p_partkey", ["p_name", "p_type", "p_size"])


@query("SELECT p_partkey, slot, field, value FROM (SELECT p_partkey, 1 AS slot, 'name' AS field, p_name AS value FROM part UNION ALL SELECT p_partkey, 2, 'brand', CASE WHEN p_partkey % 3 <> 0 THEN p_brand ELSE '' END FROM part UNION ALL SELECT p_partkey, 3, 'type', p_type FROM part UNION ALL SELECT p_partkey, 4, 'size', CASE WHEN p_size > 5 THEN p_size::VARCHAR END FROM part) WHERE value IS NOT NULL AND trim(value) <> ''")
def slot_unpivot(t: Tables) -> DataFrame:
    """Wide slots to rows; blank slots are skipped."""
    from ..sources.files import unpivot_slots

    wide = t.part.select("p_partkey", F.col("p_name").alias("name_1"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).otherwise("").alias("brand_2"), F.col("p_type").alias("type_3"), F.when(F.col("p_size") > 5, F.col("p_size").cast("string")).alias("size_4"))
    return unpivot_slots(wide, ["p_partkey"], [(1, "name", "name_1"), (2, "brand", "brand_2"), (3, "type", "type_3"), (4, "size", "size_4")])


@query("SELECT o_orderkey, o_totalprice AS amount, floor(o_totalprice)::INTEGER AS whole FROM orders")
def money_parse(t: Tables) -> DataFrame:
    """Amounts formatted with marks and signs, read back."""
    shown = F.concat(F.lit(" ¥"), F.format_number("o_totalprice", 2))
    whole = F.concat(F.floor("o_totalprice").cast("string"), F.lit(" yen"))
    return t.orders.select("o_orderkey", text.money(shown).alias("amount"), text.leading_int(whole).alias("whole"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER) > 50, false) AS big FROM events")
def json_extract(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    return t.events.select("event_id", k.alias("k"), F.coalesce(k > 50, F.lit(False)).alias("big"))


@query("""SELECT p_partkey, sha256('{"brand":"' || p_brand || '","name":"' || p_name || '","size":' || p_size || '}') AS row_hash, substr(sha256('{"brand":"' || p_brand || '","name":"' || p_name || '","size":' || p_size || '}'), 1, 16) AS short_hash,
'part:' || p_partkey || '::' || p_brand AS target_key FROM part""")
def canonical_hash(t: Tables) -> DataFrame:
    h = text.canonical_hash(("size", F.col("p_size")), ("name", F.col("p_name")), ("brand", F.col("p_brand")))
    key = text.composite_key(F.lit("part"), F.col("p_partkey"), F.lit(None).cast("string"), F.col("p_brand"))
    return t.part.select("p_partkey", h.alias("row_hash"), F.substring(h, 1, 16).alias("short_hash"), key.alias("target_key"))


@query("""SELECT source, count(*) AS n_docs, count(DISTINCT lang) AS n_langs, round(avg((n_chars >= 200)::INTEGER), 6) AS long_share, count(*) >= 5 AND count(DISTINCT lang) >= 3 AND avg((n_chars >= 200)::INTEGER) >= 0.7 AS passes FROM documents GROUP BY 1""")
def candidate_gate(t: Tables) -> DataFrame:
    share = F.avg((F.col("n_chars") >= 200).cast("int"))
    g = t.documents.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_distinct("lang").alias("n_langs"), share.alias("s"))
    return g.select("source", "n_docs", "n_langs", F.round("s", 6).alias("long_share"), ((F.col("n_docs") >= 5) & (F.col("n_langs") >= 3) & (F.col("s") >= 0.7)).alias("passes"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_rollup(t: Tables) -> DataFrame:
    """Beyond the catalog operators: totals over all combinations."""
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n_orders"), F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")), 2).cast("double").alias("total"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n_events, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def tumbling_windows(t: Tables) -> DataFrame:
    """Beyond the catalog operators: events a day."""
    w = t.events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n_events"), F.round(F.sum(F.col("value").cast("decimal(18,2)")), 2).cast("double").alias("total"))
    return w.select(F.col("w.start").alias("day"), "event_type", "n_events", "total")


REGIONS = {"ASIA": (0.25, 0.20, 0.20, 0.20, 0.10, 0.05), "EUROPE": (0.20, 0.25, 0.25, 0.15, 0.10, 0.05)}
OTHER = (0.20, 0.30, 0.15, 0.20, 0.10, 0.05)


@query(f"""WITH l AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_linestatus = 'F') AS loaded, sum(CASE WHEN l_linestatus = 'F' AND l_quantity < 3 THEN floor((1 - l_quantity / 3) * 10 + 0.5) ELSE 0 END) AS small,
  count(*) FILTER (WHERE l_returnflag = 'R' AND l_discount = 0.1 AND l_tax = 0.08) AS odd, bool_or(l_linenumber = 1 AND l_linestatus = 'F') AS main, count(*) FILTER (WHERE l_returnflag = 'A' AND l_discount = 0 AND l_tax = 0) AS hard,
  count(*) FILTER (WHERE l_returnflag = 'N' AND l_discount = 0 AND l_tax = 0) AS soft, bool_or(l_linenumber = 1 AND l_linestatus <> 'F' AND l_quantity > 49) AS broken FROM lineitem GROUP BY 1),
s AS (SELECT s_suppkey, r_name, greatest(0, least(100, 100 - floor((1 - loaded / n) * 100 + 0.5) - small - 5 * odd)) AS technical,
  greatest(0, least(100, 100 - CASE WHEN loaded < 400 THEN floor((1 - loaded / 400) * 40 + 0.5) ELSE 0 END - CASE WHEN main THEN 0 ELSE 35 END - 8 * hard)) AS image,
  greatest(0, least(100, 100 - CASE WHEN length(s_name) < 18 THEN 15 ELSE 0 END - 3 * soft)) AS content, greatest(0, least(100, 100 - 15 * hard)) AS compliance,
  greatest(0, least(100, 100 - 15 * (soft > 5)::INTEGER - 10 * (hard > 5)::INTEGER - 3 * soft)) AS conversion,
  greatest(0, least(100, 100 - 40 * broken::INTEGER - CASE WHEN s_acctbal < 300 OR s_acctbal > 9500 THEN 30 ELSE 0 END)) AS risk
  FROM supplier JOIN l ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
w AS (SELECT *, floor(technical * CASE r_name WHEN 'ASIA' THEN 0.25 ELSE 0.20 END::DOUBLE + image * CASE r_name WHEN 'ASIA' THEN 0.20 WHEN 'EUROPE' THEN 0.25 ELSE 0.30 END::DOUBLE + content * CASE r_name WHEN 'ASIA' THEN 0.20 WHEN 'EUROPE' THEN 0.25 ELSE 0.15 END::DOUBLE
  + compliance * CASE r_name WHEN 'EUROPE' THEN 0.15 ELSE 0.20 END::DOUBLE + conversion * 0.10::DOUBLE + risk * 0.05::DOUBLE + 0.5)::BIGINT AS final_score FROM s)
SELECT s_suppkey, r_name, technical::BIGINT AS technical, image::BIGINT AS image, content::BIGINT AS content, compliance::BIGINT AS compliance, conversion::BIGINT AS conversion, risk::BIGINT AS risk, final_score,
CASE WHEN final_score < 40 THEN 'critical' WHEN final_score < 60 THEN 'high' WHEN final_score < 80 THEN 'medium' ELSE 'low' END AS grade FROM w""")
def quality_score(t: Tables) -> DataFrame:
    """Six sub-scores of a supplier from its lines, weighed as its region asks."""
    from .scores import grade, weighted

    c, count = F.col, F.count_if
    loaded, main = c("l_linestatus") == "F", c("l_linenumber") == 1
    bare = (c("l_discount") == 0) & (c("l_tax") == 0)
    lines = t.lineitem.groupBy("l_suppkey").agg(
        F.count("*").alias("n"),
        count(loaded).alias("loaded"),
        F.sum(F.when(loaded & (c("l_quantity") < 3), text.js_round((1 - c("l_quantity") / 3) * 10)).otherwise(0)).alias("small"),
        count((c("l_returnflag") == "R") & (c("l_discount") == 0.1) & (c("l_tax") == 0.08)).alias("odd"),
        F.bool_or(main & loaded).alias("main"),
        count((c("l_returnflag") == "A") & bare).alias("hard"),
        count((c("l_returnflag") == "N") & bare).alias("soft"),
        F.bool_or(main & ~loaded & (c("l_quantity") > 49)).alias("broken"),
    )
    s = t.supplier.join(lines, c("s_suppkey") == c("l_suppkey")).join(t.nation, c("s_nationkey") == c("n_nationkey")).join(t.region, c("n_regionkey") == c("r_regionkey"))
    flag = lambda p, x: F.when(p, x).otherwise(0)
    score = lambda x: text.clamp(x).cast("long")
    s = s.select(
        "s_suppkey",
        "r_name",
        score(100 - text.js_round((1 - c("loaded") / c("n")) * 100) - c("small") - 5 * c("odd")).alias("technical"),
        score(100 - flag(c("loaded") < 400, text.js_round((1 - c("loaded") / 400) * 40)) - flag(~c("main"), 35) - 8 * c("hard")).alias("image"),
        score(100 - flag(F.length("s_name") < 18, 15) - 3 * c("soft")).alias("content"),
        score(100 - 15 * c("hard")).alias("compliance"),
        score(100 - flag(c("soft") > 5, 15) - flag(c("hard") > 5, 10) - 3 * c("soft")).alias("conversion"),
        score(100 - flag(c("broken"), 40) - flag((c("s_acctbal") < 300) | (c("s_acctbal") > 9500), 30)).alias("risk"),
    )
    s = s.withColumn("final_score", weighted(F.col("r_name"), ["technical", "image", "content", "compliance", "conversion", "risk"], REGIONS, OTHER))
    return s.withColumn("grade", grade(F.col("final_score")))
