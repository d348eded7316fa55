"""Quality reviews: taxonomy, scopes, cycles, late findings, rollups, requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates, merges, ordering, quality
from ..sources.tables import Tables
from .registry import query

_TYPES = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in quality.ISSUE_TYPES)
_RANK = "CASE {0} WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"


@query(f"""WITH types(type, category, default_severity) AS (VALUES {_TYPES}), numbered AS (SELECT *, row_number() OVER (ORDER BY type) - 1 AS i FROM types),
raw AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN ' ' ELSE (SELECT type FROM numbered WHERE i = p_partkey % 27) END AS type, CASE p_size % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'awful' WHEN 2 THEN NULL ELSE 'low' END AS severity FROM part)
SELECT p_partkey, r.type, coalesce(CASE WHEN severity IN ('low', 'medium', 'high', 'critical') THEN severity END, 'medium') AS severity, category, default_severity FROM raw r JOIN types USING (type) WHERE trim(r.type) <> ''""")
def normalised_issues(t: Tables) -> DataFrame:
    """A model's issues with known types and severities, and what the taxonomy says."""
    types = quality.issue_types(t.spark)
    names = sorted(x[0] for x in quality.ISSUE_TYPES)
    kind = F.when(F.col("p_partkey") % 10 == 0, " ").otherwise(F.get(F.array(*map(F.lit, names)), (F.col("p_partkey") % 27).cast("int")))
    severity = F.when(F.col("p_size") % 4 == 0, "high").when(F.col("p_size") % 4 == 1, "awful").when(F.col("p_size") % 4 == 3, "low")
    found = t.part.select("p_partkey", quality.normal_issue(kind, severity).alias("i")).where("i is not null").select("p_partkey", "i.*")
    return found.join(types, "type").select("p_partkey", "type", "severity", "category", "default_severity")


_SCOPED = "SELECT p_partkey AS listing, p_brand AS spu, CASE WHEN p_size % 3 = 0 THEN 'paused' ELSE 'active' END AS status FROM part"


@query(f"""WITH l AS (SELECT * FROM ({_SCOPED}) q WHERE status = 'active'), heroes AS (SELECT DISTINCT p_brand AS spu FROM part WHERE p_retailprice > 1000), images AS (SELECT DISTINCT l_partkey AS listing FROM lineitem WHERE l_quantity > 45)
SELECT 'hero_products' AS scope, listing FROM l WHERE spu IN (SELECT spu FROM heroes) UNION ALL SELECT 'all_active', listing FROM l UNION ALL SELECT 'active_with_images', listing FROM l WHERE listing IN (SELECT listing FROM images)
UNION ALL SELECT 'curated', listing FROM l WHERE listing IN (SELECT listing FROM images) AND (spu IN (SELECT spu FROM heroes) OR NOT EXISTS (SELECT 1 FROM heroes))""")
def review_scopes(t: Tables) -> DataFrame:
    """The listings of each policy scope."""
    listings = t.part.select(F.col("p_partkey").alias("listing"), F.col("p_brand").alias("spu"), F.when(F.col("p_size") % 3 == 0, "paused").otherwise("active").alias("status"))
    heroes = t.part.where("p_retailprice > 1000").select(F.col("p_brand").alias("spu")).distinct()
    images = t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("listing")).distinct()
    parts = [quality.review_scope(listings, s, heroes, images).select(F.lit(s).alias("scope"), "listing") for s in ("hero_products", "all_active", "active_with_images", "curated")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("""WITH x AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'mercari' WHEN 1 THEN 'amazon' WHEN 2 THEN 'rakuten' ELSE 'ebay' END AS platform, CASE WHEN p_size % 5 = 0 THEN 'missing_mapping' ELSE 'title' END AS issue, CASE WHEN p_size % 7 = 0 THEN 'create_new' ELSE 'audit_existing_listing' END AS workflow, CASE WHEN p_size % 6 = 0 THEN 'Create_Mapping_Task' ELSE 'x' END AS finding FROM part)
SELECT p_partkey, CASE WHEN platform = 'ebay' THEN 'platform' WHEN issue = 'missing_mapping' THEN 'unresolved mapping' WHEN lower(finding) = 'create_mapping_task' THEN 'mapping in findings' WHEN workflow <> 'audit_existing_listing' THEN 'workflow' END AS refused,
  CASE platform WHEN 'amazon' THEN 'amazon_mapping_audit_v1' WHEN 'mercari' THEN 'mercari_listing_audit_v1' ELSE 'rakuten_listing_audit_v1' END AS profile FROM x""")
def review_eligibility(t: Tables) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    platform = F.when(k % 4 == 0, "mercari").when(k % 4 == 1, "amazon").when(k % 4 == 2, "rakuten").otherwise("ebay")
    findings = F.to_json(F.struct(F.when(size % 6 == 0, "Create_Mapping_Task").otherwise("x").alias("action")))
    refused = quality.may_be_reviewed(platform, F.when(size % 7 == 0, "create_new").otherwise("audit_existing_listing"), F.when(size % 5 == 0, "missing_mapping").otherwise("title"), F.lit(None).cast("string"), findings)
    return t.part.select("p_partkey", refused.alias("refused"), quality.profile_of(platform).alias("profile"))


@query("""WITH r AS (SELECT event_id, user_id AS listing, ts, value AS score, event_id % 3 AS n_issues, event_type = 'purchase' AS closed FROM events), c AS (SELECT *, coalesce(sum(closed::INTEGER) OVER (PARTITION BY listing ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS cycle FROM r),
b AS (SELECT *, first_value(score) OVER (PARTITION BY listing, cycle ORDER BY ts, event_id) AS baseline FROM c)
SELECT event_id, listing, cycle::BIGINT AS cycle, baseline, round(score - baseline, 6) AS delta, CASE WHEN closed THEN 'approved' WHEN n_issues > 0 THEN 'fix_needed' ELSE 'reviewed' END AS status FROM b""")
def quality_cycles(t: Tables) -> DataFrame:
    """Reviews in cycles, each against the first score of its cycle."""
    r = t.events.select("event_id", F.col("user_id").alias("listing"), "ts", F.col("value").alias("score"), (F.col("event_id") % 3).alias("n_issues"), (F.col("event_type") == "purchase").alias("closed"))
    c = quality.cycles(r, "listing", ["ts", "event_id"], "score", "n_issues", "closed")
    return c.select("event_id", "listing", F.col("cycle").cast("long").alias("cycle"), "baseline", F.round("delta", 6).alias("delta"), "status")


@query("""WITH was AS (SELECT p_partkey AS listing, md5(p_name) AS h FROM part), now_ AS (SELECT p_partkey AS listing, md5(CASE WHEN p_partkey % 4 = 0 THEN p_name || '!' ELSE p_name END) AS h FROM part)
SELECT listing FROM now_ JOIN was USING (listing) WHERE now_.h <> was.h AND listing NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)""")
def re_review_queue(t: Tables) -> DataFrame:
    """Listings that changed and have no open work item."""
    was = t.part.select(F.col("p_partkey").alias("listing"), F.md5("p_name").alias("old"))
    now = t.part.select(F.col("p_partkey").alias("listing"), F.md5(F.when(F.col("p_partkey") % 4 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name"))).alias("new"))
    changed = now.join(was, "listing").where("new <> old").select("listing")
    return merges.insert_new(t.lineitem.where("l_quantity = 50").select(F.col("l_partkey").alias("listing")), changed, ["listing"])


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN ['price', 'blurred'] ELSE ['price', 'title', 'blurred'] END ELSE CASE WHEN p_partkey % 2 = 0 THEN ['price'] ELSE ['price', 'title'] END END AS issues, p_size AS score, CASE WHEN p_partkey % 3 = 0 THEN 'full' ELSE 'technical' END AS completeness FROM part""")
def late_enrichment(t: Tables) -> DataFrame:
    """Issues of a slower review join a result without changing its score."""
    k = F.col("p_partkey")
    results = t.part.select("p_partkey", F.when(k % 2 == 0, F.array(F.lit("price"))).otherwise(F.array(F.lit("price"), F.lit("title"))).alias("issues"), F.col("p_size").alias("score"), F.lit("technical").alias("completeness"))
    late = t.part.where("p_partkey % 3 = 0").select("p_partkey", F.array(F.lit("price"), F.lit("blurred")).alias("issues"))
    return quality.late_findings(results, late, "p_partkey").select("p_partkey", "issues", "score", "completeness")


@query("""SELECT p_type AS policy, count(*) AS n_runs, count(*) FILTER (WHERE p_size % 3 = 0) AS reviewed, count(*) FILTER (WHERE p_size % 3 = 1) AS skipped, count(*) FILTER (WHERE p_size % 3 = 2) AS errors, coalesce(floor(avg(CASE WHEN p_size % 3 = 0 THEN p_size END) + 0.5), 0)::BIGINT AS mean_score,
  round(count(*) FILTER (WHERE p_size % 3 = 0) / count(*)::DOUBLE, 6) AS review_rate, round(avg(p_retailprice), 4) AS avg_runtime, coalesce(sum(CASE WHEN p_size % 3 = 0 THEN p_size END), 0)::BIGINT AS created, greatest(5, max(CASE p_size % 5 WHEN 0 THEN 10 WHEN 1 THEN 7 WHEN 2 THEN 5 WHEN 3 THEN 3 ELSE 0 END)) AS priority FROM part GROUP BY 1""")
def policy_rollup(t: Tables) -> DataFrame:
    """Runs of each policy: counts, rates, mean score and runtime, request priority."""
    size = F.col("p_size")
    state = lambda i: F.count_if(size % 3 == i)
    severity = F.when(size % 5 == 0, "critical").when(size % 5 == 1, "high").when(size % 5 == 2, "medium").when(size % 5 == 3, "low")
    score = F.when(size % 3 == 0, size)
    return t.part.groupBy(F.col("p_type").alias("policy")).agg(
        F.count("*").alias("n_runs"),
        state(0).alias("reviewed"),
        state(1).alias("skipped"),
        state(2).alias("errors"),
        F.coalesce(F.floor(F.avg(score) + 0.5), F.lit(0)).alias("mean_score"),
        F.round(state(0) / F.count("*"), 6).alias("review_rate"),
        F.round(F.avg("p_retailprice"), 4).alias("avg_runtime"),
        F.coalesce(F.sum(score), F.lit(0)).alias("created"),
        F.greatest(F.lit(quality.LEAST_PRIORITY), F.max(F.coalesce(quality.severity_weight(severity), F.lit(0)))).alias("priority"),
    )


@query("""WITH c AS (SELECT o_orderkey, o_orderpriority, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS resolved FROM orders)
SELECT o_orderpriority, count(*) AS candidates, count(*) FILTER (WHERE resolved) AS resolved, coalesce(list_sort(list(o_orderkey) FILTER (WHERE NOT resolved))[1:20], []) AS unresolved FROM c GROUP BY 1""")
def backfill_report(t: Tables) -> DataFrame:
    """Candidates, resolved ones, and the first 20 that weren't."""
    found = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.lit(True).alias("found")).distinct()
    c = t.orders.join(found, "o_orderkey", "left")
    counts = c.groupBy("o_orderpriority").agg(F.count("*").alias("candidates"), F.count("found").alias("resolved"))
    open_ = ordering.running_position(c.where("found is null").select("o_orderpriority", "o_orderkey"), ["o_orderpriority"], [F.asc("o_orderkey")], "place").where("place <= 20")
    first = open_.groupBy("o_orderpriority").agg(F.array_sort(F.collect_list("o_orderkey")).alias("unresolved"))
    return counts.join(first, "o_orderpriority", "left").withColumn("unresolved", F.coalesce("unresolved", F.array().cast("array<long>")))


@query("""WITH r AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN ' ' ELSE 'shop' || event_id % 40 END AS code, event_type AS kind, user_id AS who, CASE WHEN event_id % 17 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS sent, props, event_id % 19 = 0 AS extra FROM events),
n AS (SELECT code, kind, who, count(*) AS n FROM r GROUP BY 1, 2, 3)
SELECT event_id, CASE WHEN extra THEN 'unknown_field' WHEN trim(r.code) = '' THEN 'blank_code' WHEN length(r.code) > 6 THEN 'code_too_long' WHEN r.kind NOT IN ('view', 'click', 'purchase', 'signup') THEN 'unknown_kind' WHEN NOT ends_with(sent, 'Z') THEN 'bad_timestamp' WHEN strlen(props) > 8 THEN 'payload_too_large' WHEN n > 1 THEN 'duplicate' END AS error
FROM r JOIN n ON n.code = r.code AND n.kind = r.kind AND n.who = r.who""")
def request_validation(t: Tables) -> DataFrame:
    """The first thing that is wrong with each request, duplicates of an identity too."""
    from ..functions.text import zoned_timestamp

    i = F.col("event_id")
    code = F.when(i % 13 == 0, " ").otherwise(F.concat(F.lit("shop"), (i % 40).cast("string")))
    sent = F.when(i % 17 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    r = t.events.select("event_id", code.alias("code"), F.col("event_type").alias("kind"), F.col("user_id").alias("who"), sent.alias("sent"), "props", F.when(i % 19 == 0, F.array(F.lit("code"), F.lit("color"))).otherwise(F.array(F.lit("code"))).alias("fields"))
    rules = [
        ("unknown_field", F.exists("fields", lambda f: ~f.isin("code", "kind", "who", "sent", "props"))),
        ("blank_code", F.trim("code") == ""),
        ("code_too_long", F.length("code") > 6),
        ("unknown_kind", ~F.col("kind").isin("view", "click", "purchase", "signup")),
        ("bad_timestamp", ~zoned_timestamp(F.col("sent"))),
        ("payload_too_large", F.octet_length("props") > 8),
    ]
    return quality.first_error(r, rules, ["code", "kind", "who"]).select("event_id", "error")


@query("""SELECT event_id, event_type = 'signup' OR ts >= TIMESTAMP '2024-01-20' - INTERVAL 1 DAY * (event_id % 15) AS reusable, CASE WHEN event_type = 'error' THEN TIMESTAMP '2024-02-01' ELSE ts END AS updated_at, CASE WHEN event_type = 'error' THEN 'draft' ELSE event_type END AS stage FROM events""")
def reuse_and_backfill(t: Tables) -> DataFrame:
    """Captured benchmarks that may be used again; rows of one state rewritten and touched."""
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    mode = F.when(F.col("event_type") == "signup", "operator").otherwise("automatic")
    ok = quality.reusable(F.col("ts").cast("timestamp_ntz"), mode, F.col("event_id") % 15, at("2024-01-20"))
    rewritten = merges.update_where(t.events, F.col("event_type") == "error", {"event_type": F.lit("draft")}, "ts", at("2024-02-01"))
    return rewritten.join(t.events.select("event_id", ok.alias("reusable")), "event_id").select("event_id", "reusable", F.col("ts").cast("timestamp_ntz").alias("updated_at"), F.col("event_type").alias("stage"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, CASE WHEN event_id % 2 = 0 THEN 'yes' END AS seen, CASE WHEN event_id % 3 = 0 THEN -1 ELSE CAST(json_extract(props, '$.k') AS INTEGER) END AS patched FROM events""")
def json_merges(t: Tables) -> DataFrame:
    """A JSON object with a path set, and merged with others whose keys win."""
    k = lambda c: F.get_json_object(c, "$.k").cast("int")
    seen = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("seen"), F.lit("yes"))).otherwise(F.create_map().cast("map<string,string>"))
    patch = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("k"), F.lit("-1"))).otherwise(F.create_map().cast("map<string,string>"))
    merged = t.events.select("event_id", "props", aggregates.merged_json(F.col("props"), seen).alias("m"), aggregates.merged_json(F.col("props"), patch).alias("p"))
    return merged.select("event_id", k("m").alias("k"), F.get_json_object("m", "$.seen").alias("seen"), k("p").alias("patched"))
