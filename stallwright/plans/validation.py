"""Import reports on the driver tables, one scan each, and prices asked for in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pricing_sql
from ..operators import validation
from ..operators.validation import Check
from ..sources.tables import Tables
from .aggregations import PRICE_SQL
from .registry import query

#: What an import is expected to hold; the tables stand for the imported relations.
EXPECTED = {"latest_rows": 4, "variants": 2000, "assets": 900, "links": 100, "attributes": 50, "tiers": 25, "skus": 3000, "titled_skus": 40}

_METRICS = """m AS (SELECT
  (SELECT count(*) FROM lineitem WHERE l_orderkey = (SELECT arg_max(o_orderkey, (o_orderdate, o_orderkey)) FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')) AS latest_rows, (SELECT count(*) FROM lineitem) AS source_rows, (SELECT count(*) FROM orders) AS runs, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS completed_runs,
  (SELECT count(*) FROM part) AS variants, (SELECT count(*) FROM part WHERE p_brand <> 'Brand#1') AS shop_skus, (SELECT count(*) FROM supplier) AS spus, (SELECT count(*) FROM supplier WHERE s_acctbal >= 0) AS titled_spus, (SELECT count(*) FROM events) AS assets,
  (SELECT count(*) FROM documents WHERE lang = 'en') AS en_listings, (SELECT count(*) FROM documents WHERE lang = 'fr') AS fr_listings, (SELECT count(*) FROM documents WHERE lang = 'en' AND n_chars < 200) AS en_unknown, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS with_payload,
  (SELECT count(*) FROM documents) - (SELECT count(*) FROM (SELECT DISTINCT lang, source, sha256(text) FROM documents)) AS repeated_listings, (SELECT count(*) FROM labels) AS skus, (SELECT count(*) FROM labels WHERE quality = 1) AS titled_skus, (SELECT count(*) FROM labels WHERE toxic = 1) AS asins,
  (SELECT count(*) FROM pages) AS attributes, (SELECT count(*) FROM conversations WHERE role = 'user') AS links, (SELECT count(*) FROM conversations WHERE role = 'user' AND turn > 0) AS sku_links, (SELECT count(*) FROM nation) AS tiers)"""


def _sql_equal(name: str, metric: str, expected: object, otherwise: str = "FAIL") -> tuple[str, str, str, str]:
    return name, f"{metric} = {expected}", f"'expected ' || {expected} || ', got ' || {metric}", otherwise


def _sql_least(name: str, metric: str, least: int, otherwise: str = "FAIL") -> tuple[str, str, str, str]:
    return name, f"{metric} >= {least}", f"'at least {least}, got ' || {metric}", otherwise


_E = EXPECTED
_ORACLE = [
    _sql_equal("source_rows_of_latest_run", "latest_rows", _E["latest_rows"]),
    _sql_equal("variants", "variants", _E["variants"]),
    _sql_equal("products", "spus", 100),
    ("shop_sku_not_unique_key", "shop_skus > 0", "shop_skus || ' variants have a shop SKU'", "FAIL"),
    ("titles_filled", "titled_spus = spus", "titled_spus || '/' || spus || ' products have titles'", "WARN"),
    _sql_least("assets", "assets", _E["assets"], "WARN"),
    _sql_equal("listings_en", "en_listings", 400),
    ("skus_of_en", f"skus - asins - titled_skus >= {_E['skus']}", "'derived ' || (skus - asins - titled_skus)", "FAIL"),
    _sql_least("links", "links", _E["links"]),
    ("status_normalised", "en_unknown < 10", "(en_listings - en_unknown) || ' active, ' || en_unknown || ' unknown'", "WARN"),
    _sql_equal("listings_fr", "fr_listings", 100),
    _sql_least("skus_with_seller_sku", "titled_skus", _E["titled_skus"]),
    _sql_equal("attributes", "attributes", _E["attributes"]),
    _sql_least("links_by_sku", "sku_links", 50),
    _sql_equal("source_rows", "source_rows", 12590),
    _sql_equal("skus_with_asin", "asins", 87),
    _sql_equal("price_tiers", "tiers", _E["tiers"]),
    _sql_least("links_by_mapping", "sku_links", 61, "WARN"),
    ("runs_completed", "completed_runs = runs", "completed_runs || '/' || runs || ' runs completed'", "FAIL"),
    ("payload_kept", "true", "with_payload || ' listings have a payload'", "FAIL"),
    _sql_equal("no_repeated_listing", "repeated_listings", 0),
]


@query(f"WITH {_METRICS} " + " UNION ALL ".join(f"SELECT {i} AS no, '{n}' AS \"check\", CASE WHEN {p} THEN 'PASS' ELSE '{o}' END AS status, {d} AS detail FROM m" for i, (n, p, d, o) in enumerate(_ORACLE, 1)))
def import_report(t: Tables) -> DataFrame:
    """All checks of an import; each relation is scanned once (runs also for the latest)."""
    c = F.col
    done = c("o_orderstatus") == "F"
    latest = validation.latest_run(t.orders, "o_orderkey", "o_orderdate", done & (c("o_orderpriority") == "1-URGENT"))
    rows = t.lineitem.select("l_orderkey").join(F.broadcast(latest.withColumnRenamed("o_orderkey", "latest")), c("l_orderkey") == c("latest"), "left")
    english, all_rows = c("lang") == "en", F.lit(True)
    metrics = {
        "rows": validation.counted(rows, {"latest_rows": c("latest").isNotNull(), "source_rows": all_rows}),
        "runs": validation.counted(t.orders, {"runs": all_rows, "completed_runs": done}),
        "variants": validation.counted(t.part, {"variants": all_rows, "shop_skus": c("p_brand") != "Brand#1"}),
        "products": validation.counted(t.supplier, {"spus": all_rows, "titled_spus": c("s_acctbal") >= 0}),
        "assets": validation.counted(t.events, {"assets": all_rows}),
        "listings": validation.counted(
            t.documents.withColumn("external", F.sha2("text", 256)),
            {"en_listings": english, "fr_listings": c("lang") == "fr", "en_unknown": english & (c("n_chars") < 200), "with_payload": c("text").isNotNull()},
            ["lang", "source", "external"],
            "repeated_listings",
        ),
        "skus": validation.counted(t.labels, {"skus": all_rows, "titled_skus": c("quality") == 1, "asins": c("toxic") == 1}),
        "attributes": validation.counted(t.pages, {"attributes": all_rows}),
        "links": validation.counted(t.conversations, {"links": c("role") == "user", "sku_links": (c("role") == "user") & (c("turn") > 0)}),
        "tiers": validation.counted(t.nation, {"tiers": all_rows}),
    }
    text = lambda *parts: F.concat(*[F.lit(p) if p.startswith(" ") or p in ("/", "derived ") else c(p).cast("string") for p in parts])
    derived = c("skus") - c("asins") - c("titled_skus")
    checks = [
        Check.equal("source_rows_of_latest_run", "latest_rows", EXPECTED["latest_rows"]),
        Check.equal("variants", "variants", EXPECTED["variants"]),
        Check.equal("products", "spus", 100),
        Check("shop_sku_not_unique_key", c("shop_skus") > 0, text("shop_skus", " variants have a shop SKU")),
        Check("titles_filled", c("titled_spus") == c("spus"), text("titled_spus", "/", "spus", " products have titles"), "WARN"),
        Check.least("assets", "assets", EXPECTED["assets"], "WARN"),
        Check.equal("listings_en", "en_listings", 400),
        Check("skus_of_en", derived >= EXPECTED["skus"], F.concat(F.lit("derived "), derived.cast("string"))),
        Check.least("links", "links", EXPECTED["links"]),
        Check("status_normalised", c("en_unknown") < 10, F.concat((c("en_listings") - c("en_unknown")).cast("string"), F.lit(" active, "), c("en_unknown").cast("string"), F.lit(" unknown")), "WARN"),
        Check.equal("listings_fr", "fr_listings", 100),
        Check.least("skus_with_seller_sku", "titled_skus", EXPECTED["titled_skus"]),
        Check.equal("attributes", "attributes", EXPECTED["attributes"]),
        Check.least("links_by_sku", "sku_links", 50),
        Check.equal("source_rows", "source_rows", 12590),
        Check.equal("skus_with_asin", "asins", 87),
        Check.equal("price_tiers", "tiers", EXPECTED["tiers"]),
        Check.least("links_by_mapping", "sku_links", 61, "WARN"),
        Check("runs_completed", c("completed_runs") == c("runs"), text("completed_runs", "/", "runs", " runs completed")),
        Check("payload_kept", F.lit(True), text("with_payload", " listings have a payload")),
        Check.equal("no_repeated_listing", "repeated_listings", 0),
    ]
    names = "latest_rows source_rows runs completed_runs variants shop_skus spus titled_spus assets en_listings fr_listings en_unknown with_payload repeated_listings skus titled_skus asins attributes links sku_links tiers".split()
    return validation.report(list(metrics.values()), names, checks)


@query("""SELECT 'orders' AS name, 'runs' AS required_for, true AS present, count(*) AS n_rows FROM orders UNION ALL SELECT 'documents', 'listings', true, count(*) FROM documents UNION ALL SELECT 'refunds', 'returns', false, NULL UNION ALL SELECT 'pages', 'attributes', true, count(*) FROM pages""")
def relation_probe(t: Tables) -> DataFrame:
    """Whether relations are there, and their rows; a missing one is a finding."""
    return validation.probe(t.spark, lambda name: getattr(t, name), {"orders": "runs", "documents": "listings", "refunds": "returns", "pages": "attributes"})


@query(f"""WITH {PRICE_SQL} SELECT p_partkey, CASE WHEN cost > 0 AND fee IS NOT NULL THEN greatest(ex, 0)::DOUBLE END AS price_excl, CASE WHEN cost > 0 AND fee IS NOT NULL THEN greatest(round((ex + fee::DOUBLE) / 50) * 50, 0)::DOUBLE END AS price_incl,
(cost + coalesce(fee, 0))::DOUBLE AS tcogs FROM final""")
def pricing_by_sql_functions(t: Tables) -> DataFrame:
    """The prices of all parts, in SQL with the session's price functions."""
    pricing_sql.register(t.spark)
    return t.spark.sql(
        """WITH base AS (SELECT p_partkey, CAST(p_retailprice * 8 AS DECIMAL(18,2)) AS unit, CASE WHEN p_partkey % 13 <> 0 THEN CAST(p_size * 30 AS DECIMAL(18,2)) END AS fee,
             CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE CAST(p_retailprice * 7 AS DECIMAL(18,2)) END AS manual, CASE WHEN p_partkey % 14 <> 0 THEN CAST(p_retailprice * 8 AS DECIMAL(18,2)) END AS baseline,
             CASE p_type WHEN 'PROMO' THEN 'High' WHEN 'LARGE' THEN 'Moderate' END AS returns FROM {part}),
           costed AS (SELECT *, effective_cost_price(manual, baseline) AS cost FROM base)
           SELECT p_partkey, price_excl_shipping(unit, fee, cost, returns) AS price_excl, price_incl_shipping(unit, fee, cost, returns) AS price_incl, CAST(total_cost_price(cost, fee) AS DOUBLE) AS tcogs FROM costed""",
        part=t.part,
    )
