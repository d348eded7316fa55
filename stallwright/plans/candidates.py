"""Listing candidates and what they are joined from: links, bridges, enrichments.

A part is a variant, a line of an order its listing in one of four shops; lines 3 and 5
are legacy listings, known by code only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import enrichment, joins
from ..sources.tables import Tables
from .registry import query

SHOPS = ("shop1", "shop2", "shop3", "shop4")

_LISTINGS = """SELECT l_orderkey * 10 + l_linenumber AS listing, 'shop' || (1 + l_suppkey % 4) AS shop, CASE WHEN l_linenumber NOT IN (3, 5) THEN l_partkey END AS variant, 'SKU-' || l_partkey AS sku, l_extendedprice AS price FROM lineitem"""


def _listings(t: Tables) -> DataFrame:
    linked = ~F.col("l_linenumber").isin(3, 5)
    return t.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("listing"),
        F.concat(F.lit("shop"), (1 + F.col("l_suppkey") % 4).cast("string")).alias("shop"),
        F.when(linked, F.col("l_partkey")).alias("variant"),
        F.concat(F.lit("SKU-"), F.col("l_partkey").cast("string")).alias("sku"),
        F.col("l_extendedprice").alias("price"),
    )


@query(f"""WITH l AS (SELECT DISTINCT * FROM ({_LISTINGS}) q), v AS (SELECT p_partkey AS variant, 'SKU-' || p_partkey AS sku, p_brand, p_retailprice FROM part WHERE p_size > 0),
owned AS (SELECT l.listing, l.shop, l.price, l.variant, false AS legacy FROM l WHERE l.variant IS NOT NULL UNION ALL SELECT l.listing, l.shop, l.price, v.variant, true FROM l JOIN v ON v.sku = l.sku WHERE l.variant IS NULL),
s AS (SELECT variant, shop, count(*) AS n, max(listing) AS latest, max_by(price, struct_pack(a := listing, b := price)) AS price, bool_or(legacy) AS legacy FROM owned GROUP BY 1, 2)
SELECT v.variant, p_brand AS brand, {', '.join(f"coalesce(max(CASE WHEN shop = '{s}' THEN n END), 0) AS {s}_n, max(CASE WHEN shop = '{s}' THEN latest END) AS {s}_latest, max(CASE WHEN shop = '{s}' THEN price END) AS {s}_price, coalesce(bool_or(CASE WHEN shop = '{s}' THEN legacy END), false) AS {s}_legacy" for s in SHOPS)},
  CASE WHEN p_retailprice IS NULL THEN 'no_price' WHEN count(shop) = 4 THEN 'covered' WHEN count(shop) = 0 THEN 'new' ELSE 'extend' END AS candidate
FROM v LEFT JOIN s ON s.variant = v.variant GROUP BY v.variant, p_brand, p_retailprice""")
def listing_candidates(t: Tables) -> DataFrame:
    """Each variant with what it has in each shop, by link or by legacy code."""
    variants = t.part.where("p_size > 0").select(F.col("p_partkey").alias("variant"), F.concat(F.lit("SKU-"), F.col("p_partkey").cast("string")).alias("sku"), F.col("p_brand").alias("brand"), "p_retailprice")
    shops = enrichment.per_shop(variants, _listings(t).distinct(), SHOPS)
    n_shops = sum((F.col(f"{s}_n") > 0).cast("int") for s in SHOPS)
    found = F.when(F.col("p_retailprice").isNull(), "no_price").when(n_shops == 4, "covered").when(n_shops == 0, "new").otherwise("extend")
    return shops.select("variant", "brand", *[f"{s}_{c}" for s in SHOPS for c in ("n", "latest", "price", "legacy")], found.alias("candidate"))


@query("""WITH dim AS (SELECT o_orderpriority AS name, max_by(o_orderkey, o_orderkey) AS id FROM orders WHERE o_orderpriority NOT LIKE '%LOW%' GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN '' ELSE o_orderpriority END AS name, id FROM orders LEFT JOIN dim ON name = CASE WHEN o_custkey % 5 = 0 THEN '' ELSE o_orderpriority END""")
def last_wins_lookup(t: Tables) -> DataFrame:
    """A dimension with repeated keys: the last row of a key counts, blank keys never."""
    dim = t.orders.select(F.when(F.col("o_orderpriority").contains("LOW"), " ").otherwise(F.col("o_orderpriority")).alias("name"), F.col("o_orderkey").alias("id"))
    facts = t.orders.select("o_orderkey", F.when(F.col("o_custkey") % 5 == 0, "").otherwise(F.col("o_orderpriority")).alias("name"))
    return enrichment.lookup_last(facts, dim, "name", "id", "id")


@query("""WITH runs AS (SELECT o_orderkey AS run, o_orderdate AS done_at FROM orders WHERE o_orderstatus = 'F'), latest AS (SELECT run FROM runs ORDER BY done_at DESC, run DESC LIMIT 1),
m AS (SELECT l_orderkey AS run, 'A' || l_suppkey AS external, l_partkey AS variant FROM lineitem)
SELECT DISTINCT s_suppkey, m.variant, p_name FROM supplier JOIN m ON m.external = 'A' || s_suppkey JOIN latest USING (run) JOIN part ON p_partkey = m.variant""")
def bridge_of_latest_run(t: Tables) -> DataFrame:
    """Listings and variants over a mapping table, of its latest completed run only."""
    runs = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("run"), F.col("o_orderdate").alias("done_at"))
    mapping = t.lineitem.select(F.col("l_orderkey").alias("run"), F.concat(F.lit("A"), F.col("l_suppkey").cast("string")).alias("external"), F.col("l_partkey").alias("variant"))
    latest = runs.orderBy(F.desc("done_at"), F.desc("run")).limit(1).select("run")
    listings = t.supplier.select("s_suppkey", F.concat(F.lit("A"), F.col("s_suppkey").cast("string")).alias("external"))
    rows = listings.join(mapping.join(F.broadcast(latest), "run", "left_semi"), "external").join(t.part, F.col("p_partkey") == F.col("variant"))
    return rows.select("s_suppkey", "variant", "p_name").distinct()


@query("""WITH l AS (SELECT l_orderkey AS listing, l_partkey AS variant, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount END AS confidence, l_linenumber AS link FROM lineitem),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY listing ORDER BY confidence DESC NULLS LAST, link, variant) AS r FROM l) WHERE r = 1),
linked AS (SELECT listing, list_sort(list(DISTINCT variant)) AS variants FROM l WHERE confidence >= 0.05 GROUP BY 1), every AS (SELECT listing, list_sort(list(DISTINCT variant)) AS variants FROM l GROUP BY 1)
SELECT listing, best.variant AS best_variant, confidence, coalesce(linked.variants, every.variants) AS variants FROM best JOIN every USING (listing) LEFT JOIN linked USING (listing)""")
def best_links(t: Tables) -> DataFrame:
    """The surest link of each listing; its variants are the surely linked ones, else all."""
    links = t.lineitem.select(F.col("l_orderkey").alias("listing"), F.col("l_partkey").alias("variant"), F.when(F.col("l_linenumber") != 7, F.col("l_discount")).alias("confidence"), F.col("l_linenumber").alias("link"))
    best = joins.latest_per(links, ["listing"], [F.desc_nulls_last("confidence"), F.asc("link"), F.asc("variant")])
    sure = F.array_sort(F.collect_set(F.when(F.col("confidence") >= 0.05, F.col("variant"))))
    sets = links.groupBy("listing").agg(sure.alias("sure"), F.array_sort(F.collect_set("variant")).alias("every"))
    variants = F.when(F.size("sure") > 0, F.col("sure")).otherwise(F.col("every"))
    return best.join(sets, "listing").select("listing", F.col("variant").alias("best_variant"), "confidence", variants.alias("variants"))


@query("""WITH b AS (SELECT p_type AS platform, CASE WHEN p_partkey % 3 <> 0 THEN p_size END AS category_id, p_brand AS category, min(p_partkey) AS benchmark FROM part GROUP BY 1, 2, 3),
q AS (SELECT p_partkey, p_type AS platform, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS category_id, p_brand AS category FROM part),
i AS (SELECT platform, category_id, min(benchmark) AS benchmark FROM b WHERE category_id IS NOT NULL GROUP BY 1, 2), n AS (SELECT platform, category, min(benchmark) AS benchmark FROM b GROUP BY 1, 2)
SELECT p_partkey, CASE WHEN q.category_id IS NOT NULL THEN i.benchmark ELSE n.benchmark END AS benchmark FROM q LEFT JOIN i ON i.platform = q.platform AND i.category_id = q.category_id LEFT JOIN n ON n.platform = q.platform AND n.category = q.category""")
def benchmark_by_id_else_name(t: Tables) -> DataFrame:
    """Benchmarks by platform and category id; by category name for listings without one."""
    size, brand, platform = F.col("p_size"), F.col("p_brand"), F.col("p_type")
    b = t.part.groupBy(platform.alias("platform"), F.when(F.col("p_partkey") % 3 != 0, size).alias("category_id"), brand.alias("category")).agg(F.min("p_partkey").alias("benchmark"))
    q = t.part.select("p_partkey", platform.alias("platform"), F.when(F.col("p_partkey") % 2 == 0, size).alias("category_id"), brand.alias("category"))
    return enrichment.id_else_name(q, b, ["platform"], "category_id", "category", "benchmark").select("p_partkey", "benchmark")


@query("""WITH l AS (SELECT l_orderkey AS listing, l_partkey AS variant FROM lineitem), v AS (SELECT p_partkey AS variant, p_brand AS spu, p_type AS family, p_size AS attribute, p_retailprice AS price FROM part),
e AS (SELECT listing, count(DISTINCT l.variant) AS n, min(l.variant) AS variant, CASE WHEN count(DISTINCT spu) = 1 THEN min(spu) END AS spu, CASE WHEN count(DISTINCT family) = 1 THEN min(family) END AS family, CASE WHEN count(DISTINCT attribute) = 1 THEN min(attribute) END AS attribute, coalesce(bool_or(price > 950), false) AS hero FROM l LEFT JOIN v USING (variant) GROUP BY 1),
m AS (SELECT spu, count(*) AS n_variants, CASE WHEN count(DISTINCT family) = 1 THEN min(family) END AS spu_family FROM v GROUP BY 1)
SELECT listing, CASE WHEN n = 1 THEN variant END AS variant, e.spu, coalesce(e.family, spu_family) AS family, attribute, n_variants, hero, n > 1 AS unresolved FROM e LEFT JOIN m ON m.spu = e.spu""")
def enriched_listings(t: Tables) -> DataFrame:
    """Links, variants, SPUs, their variants, families, attributes and hero flags of each
    listing; an id counts where there is exactly one."""
    v = t.part.select(F.col("p_partkey").alias("variant"), F.col("p_brand").alias("spu"), F.col("p_type").alias("family"), F.col("p_size").alias("attribute"), F.col("p_retailprice").alias("price"))
    rows = t.lineitem.select(F.col("l_orderkey").alias("listing"), F.col("l_partkey").alias("variant")).join(v, "variant", "left")
    one = enrichment.only
    e = rows.groupBy("listing").agg(one("variant").alias("one_variant"), one("spu").alias("spu"), one("family").alias("own_family"), one("attribute").alias("attribute"), F.coalesce(F.max(F.col("price") > 950), F.lit(False)).alias("hero"), (F.min("variant") != F.max("variant")).alias("unresolved"))
    m = v.groupBy("spu").agg(F.count("*").alias("n_variants"), one("family").alias("spu_family"))
    return e.join(m, "spu", "left").select("listing", F.col("one_variant").alias("variant"), "spu", F.coalesce("own_family", "spu_family").alias("family"), "attribute", "n_variants", "hero", "unresolved")


@query("""WITH o AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderdate, o_orderkey) AS orders, count(*) AS n FROM orders GROUP BY 1), p AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS priorities FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(o.orders, []) AS orders, coalesce(priorities, []) AS priorities, list_sort(list_filter(coalesce(o.orders, []), lambda x: x % 2 = 0))[1:5] AS first_even FROM customer LEFT JOIN o ON o.o_custkey = c_custkey LEFT JOIN p ON p.o_custkey = c_custkey""")
def customer_detail(t: Tables) -> DataFrame:
    """A parent with several ordered child lists, and the first five of a filtered one."""
    o = t.orders.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda x: x.o_orderkey).alias("orders"), F.array_sort(F.collect_set("o_orderpriority")).alias("priorities"))
    j = t.customer.join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    orders = F.coalesce("orders", F.array().cast("array<long>"))
    return j.select("c_custkey", orders.alias("orders"), F.coalesce("priorities", F.array().cast("array<string>")).alias("priorities"), F.slice(F.array_sort(F.filter(orders, lambda x: x % 2 == 0)), 1, 5).alias("first_even"))


@query("""SELECT user_id, min(ts) FILTER (WHERE event_type = 'signup') AS queued_at, min(ts) FILTER (WHERE event_type = 'view') AS opened_at, max(ts) AS seen_at, max_by(event_type, struct_pack(a := ts, b := event_id)) AS status FROM events GROUP BY 1""")
def first_and_last_seen(t: Tables) -> DataFrame:
    """Timestamps that a later status never overwrites, beside the latest."""
    first = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("ts")))
    return t.events.groupBy("user_id").agg(first("signup").alias("queued_at"), first("view").alias("opened_at"), F.max("ts").alias("seen_at"), F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))


@query("""WITH r AS (SELECT p_partkey, p_brand AS hash, p_type AS model, p_size AS version, p_partkey % 3 <> 0 AS valid FROM part), w AS (SELECT s_suppkey, 'Brand#' || (1 + s_suppkey % 5) AS hash FROM supplier)
SELECT s_suppkey, w.hash, max(p_partkey) AS review, count(p_partkey) = 0 AS has_to_run FROM w LEFT JOIN r ON r.hash = w.hash AND model = 'ECONOMY' AND version >= 10 AND valid GROUP BY 1, 2""")
def reusable_reviews(t: Tables) -> DataFrame:
    """The latest valid review of the same content, model and prompt version, if any."""
    usable = t.part.where("p_type = 'ECONOMY' and p_size >= 10 and p_partkey % 3 <> 0").groupBy(F.col("p_brand").alias("hash")).agg(F.max("p_partkey").alias("review"))
    wanted = t.supplier.select("s_suppkey", F.concat(F.lit("Brand#"), (1 + F.col("s_suppkey") % 5).cast("string")).alias("hash"))
    return wanted.join(usable, "hash", "left").select("s_suppkey", "hash", "review", F.col("review").isNull().alias("has_to_run"))


_CHECKS = "'[' || CASE WHEN p_size % 4 = 0 THEN '{\"check\":\"zero_stock\",\"n\":0},' ELSE '' END || '{\"check\":\"title\",\"n\":' || p_size || '}]'"


@query(f"""WITH w AS (SELECT p_partkey, {_CHECKS} AS checks, CASE WHEN p_size % 3 = 0 THEN 'listing_copy' ELSE 'images' END AS kind, p_size FROM part)
SELECT p_partkey, pos::INTEGER AS pos, CASE WHEN p_size % 4 = 0 AND pos = 0 THEN 'zero_stock' ELSE 'title' END AS check_name, kind = 'listing_copy' AS is_copy FROM (SELECT *, unnest(range(CASE WHEN p_size % 4 = 0 THEN 2 ELSE 1 END)) AS pos FROM w) WHERE kind = 'listing_copy' OR p_size % 4 <> 0""")
def work_items_with_stock(t: Tables) -> DataFrame:
    """Work items by the checks in their JSON: those of zero stock go, unless of copy work
    (found by a path in their context); the checks are unnested with their places."""
    zero = F.when(F.col("p_size") % 4 == 0, '{"check":"zero_stock","n":0},').otherwise("")
    checks = F.concat(F.lit("["), zero, F.lit('{"check":"title","n":'), F.col("p_size").cast("string"), F.lit("}]"))
    kind = F.when(F.col("p_size") % 3 == 0, "listing_copy").otherwise("images")
    items = t.part.select("p_partkey", checks.alias("checks"), F.to_json(F.struct(F.struct(kind.alias("kind")).alias("copy_improvement"))).alias("context"))
    parsed = F.from_json("checks", "array<struct<check:string,n:int>>")
    is_copy = F.get_json_object("context", "$.copy_improvement.kind") == "listing_copy"
    kept = items.where(is_copy | ~F.exists(parsed, lambda x: x.check == "zero_stock"))
    return kept.select("p_partkey", F.posexplode(parsed).alias("pos", "x"), is_copy.alias("is_copy")).select("p_partkey", "pos", F.col("x.check").alias("check_name"), "is_copy")


def _reader(name: str) -> tuple[list[str], list[str]]:
    """(segments, columns) that a reader may see."""
    return {"furniture_reader": (["FURNITURE"], ["c_custkey", "c_name"]), "all_reader": ([], ["c_custkey", "c_name", "c_mktsegment"])}.get(name, (["none"], ["c_custkey"]))


@query("""SELECT 'furniture_reader' AS reader, c_custkey, c_name, NULL::VARCHAR AS c_mktsegment FROM customer WHERE c_mktsegment = 'FURNITURE' UNION ALL SELECT 'all_reader', c_custkey, c_name, c_mktsegment FROM customer""")
def reader_projections(t: Tables) -> DataFrame:
    """What each reader may see: its rows and columns, and nothing for unknown readers."""
    parts = [enrichment.as_seen_by(t.customer, "c_mktsegment", *_reader(r)).select(F.lit(r).alias("reader"), "*") for r in ("furniture_reader", "all_reader", "stranger")]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


@query("""SELECT o_orderkey, o_orderpriority, o_orderdate, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS total FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority DESC, o_orderdate, o_orderkey LIMIT 20 OFFSET 40""")
def page_with_total(t: Tables) -> DataFrame:
    """The third page of 20 and the exact number of all rows."""
    rows = t.orders.where("o_orderstatus = 'O'").select("o_orderkey", "o_orderpriority", "o_orderdate")
    page = rows.orderBy(F.desc("o_orderpriority"), F.asc("o_orderdate"), F.asc("o_orderkey")).offset(40).limit(20)
    return joins.with_single_row(page, rows.agg(F.count("*").alias("total")))


@query("""SELECT doc_id, CASE WHEN lang = source THEN [lang, 'main'] ELSE [lang, 'main', source] END AS labels, list_has_any([lang, source], ['en', 'web']) AS overlaps FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL""")
def merged_labels(t: Tables) -> DataFrame:
    """Unions of arrays in order, overlaps, and a main entry appended only if absent."""
    known = t.documents.where("lang is not null and source is not null")
    return known.select("doc_id", F.array_union(enrichment.appended(F.array("lang"), F.lit("main")), F.array("source")).alias("labels"), F.arrays_overlap(F.array("lang", "source"), F.array(F.lit("en"), F.lit("web"))).alias("overlaps"))
