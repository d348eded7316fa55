"""Reviews: validation, snapshots, issues and recommendations, claims, disposition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..operators import aggregates, merges, ordering
from ..sources.tables import Tables
from .registry import query
from .scores import grade


@query("""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 7 = 0 THEN 'abc' WHEN o_orderkey % 11 = 0 THEN '-3' ELSE '12.5' END AS price, CASE WHEN o_orderkey % 3 = 0 THEN '1.5' ELSE '4' END AS qty FROM orders)
SELECT o_orderkey, concat_ws('; ', CASE WHEN status = '' THEN 'missing status' END, CASE WHEN try_cast(price AS DOUBLE) IS NULL OR try_cast(price AS DOUBLE) < 0 THEN 'bad number price' END, CASE WHEN NOT regexp_full_match(qty, '[0-9]+') THEN 'bad integer qty' END) AS errors FROM r""")
def validation_rejects(t: Tables) -> DataFrame:
    """Rows with all that is wrong in them; '' for good ones."""
    from ..sources.files import reject_rows

    k = F.col("o_orderkey")
    df = t.orders.select("o_orderkey", F.when(k % 5 == 0, "").otherwise(F.col("o_orderstatus")).alias("status"), F.when(k % 7 == 0, "abc").when(k % 11 == 0, "-3").otherwise("12.5").alias("price"), F.when(k % 3 == 0, "1.5").otherwise("4").alias("qty"))
    return reject_rows(df, ["status"], ["price"], ["qty"]).select("o_orderkey", "errors")


@query("SELECT source, sha256(text) AS content_hash, min(doc_id) AS first_doc, count(*) AS n_seen FROM documents GROUP BY 1, 2")
def snapshot_scd(t: Tables) -> DataFrame:
    """A new snapshot of a source only for content that it didn't have before."""
    return t.documents.groupBy("source", F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n_seen"))


@query("SELECT doc_id, lang FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id AND quality = 1)")
def review_pending(t: Tables) -> DataFrame:
    """Documents that have no accepted review yet."""
    return merges.insert_new(t.labels.where("quality = 1").select("doc_id"), t.documents.select("doc_id", "lang"), ["doc_id"])


@query("""WITH a AS (SELECT l_orderkey, l_linenumber AS attempt, bool_or(l_returnflag <> 'R') AS valid FROM lineitem GROUP BY 1, 2), f AS (SELECT l_orderkey, min(attempt) FILTER (WHERE valid) AS first_valid, min(attempt) AS first, count(*) AS n_attempts FROM a GROUP BY 1)
SELECT l_orderkey, first_valid, CASE WHEN first_valid = first THEN 'valid' WHEN first_valid IS NOT NULL THEN 'repaired' WHEN n_attempts > 1 THEN 'invalid' ELSE 'failed' END AS disposition, n_attempts FROM f""")
def repair_attempts(t: Tables) -> DataFrame:
    """All attempts: valid at once, repaired later, invalid after several, failed with one."""
    a = t.lineitem.groupBy("l_orderkey", F.col("l_linenumber").alias("attempt")).agg(F.bool_or(F.col("l_returnflag") != "R").alias("valid"))
    f = a.groupBy("l_orderkey").agg(F.min(F.when(F.col("valid"), F.col("attempt"))).alias("first_valid"), F.min("attempt").alias("first"), F.count("*").alias("n_attempts"))
    state = F.when(F.col("first_valid") == F.col("first"), "valid").when(F.col("first_valid").isNotNull(), "repaired").when(F.col("n_attempts") > 1, "invalid").otherwise("failed")
    return f.select("l_orderkey", "first_valid", state.alias("disposition"), "n_attempts")


#: Issue types: condition, severity, category (of the line tables).
ISSUES = (("l_discount = 0 and l_tax = 0", "bare_line", "high", "pricing"), ("l_quantity < 2", "tiny_line", "low", "stock"), ("l_quantity > 49", "bulk_line", "medium", "stock"), ("l_returnflag = 'R' and l_discount = 0.1", "returned_sale", "critical", "returns"))
_ISSUE_SQL = "issues AS (" + " UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, l_partkey, '{n}' AS type, '{s}' AS severity, '{c}' AS category FROM lineitem WHERE {p}" for p, n, s, c in ISSUES) + ")"
_RANK_SQL = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"


def issues(t: Tables) -> DataFrame:
    """One pass over the lines; a row for each issue of a line."""
    found = F.array_compact(F.array(*[F.when(F.expr(p), F.struct(F.lit(n).alias("type"), F.lit(s).alias("severity"), F.lit(c).alias("category"))) for p, n, s, c in ISSUES]))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.explode(found).alias("i")).select("l_orderkey", "l_linenumber", "l_partkey", "i.*")


@query(f"WITH {_ISSUE_SQL} SELECT category, severity, count(*) AS n_issues, count(DISTINCT l_orderkey) AS n_orders FROM issues GROUP BY 1, 2")
def issue_report(t: Tables) -> DataFrame:
    return issues(t).groupBy("category", "severity").agg(F.count("*").alias("n_issues"), F.count_distinct("l_orderkey").alias("n_orders"))


@query(f"WITH {_ISSUE_SQL} SELECT l_orderkey, category, severity, count(*) AS n_issues, list_sort(list(type || ' of line ' || l_linenumber)) AS issues FROM issues GROUP BY 1, 2, 3")
def order_issue_lists(t: Tables) -> DataFrame:
    """Issues of each order by category and severity, with their list. An order has a
    bounded number of lines."""
    said = F.concat("type", F.lit(" of line "), F.col("l_linenumber").cast("string"))
    return issues(t).groupBy("l_orderkey", "category", "severity").agg(F.count("*").alias("n_issues"), F.array_sort(F.collect_list(said)).alias("issues"))


@query(f"""WITH {_ISSUE_SQL}, f AS (SELECT l_orderkey, type, min(category) AS category, min(l_linenumber) AS first_line, max({_RANK_SQL}) AS worst FROM issues GROUP BY 1, 2)
SELECT l_orderkey, type, first_line, CASE category WHEN 'pricing' THEN 'check_price' WHEN 'returns' THEN 'review_return' ELSE 'check_stock' END AS recommendation FROM f
UNION ALL SELECT l_orderkey, 'score', NULL, 'human_review' FROM f GROUP BY 1 HAVING sum(worst) >= 8""")
def fix_recommendations(t: Tables) -> DataFrame:
    """The first issue of each type gets an action; orders with many get a reviewer."""
    first = issues(t).groupBy("l_orderkey", "type").agg(F.min("category").alias("category"), F.min("l_linenumber").alias("first_line"), F.max(aggregates.severity_rank("severity")).alias("worst"))
    action = F.when(F.col("category") == "pricing", "check_price").when(F.col("category") == "returns", "review_return").otherwise("check_stock")
    human = first.groupBy("l_orderkey").agg(F.sum("worst").alias("s")).where("s >= 8")
    return first.select("l_orderkey", "type", "first_line", action.alias("recommendation")).unionByName(human.select("l_orderkey", F.lit("score").alias("type"), F.lit(None).cast("int").alias("first_line"), F.lit("human_review").alias("recommendation")))


@query("""WITH n AS (SELECT conv_id, turn, role, list_distinct(regexp_extract_all(text, '[0-9]+')) AS own, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM conversations)
SELECT conv_id, turn, len(own)::BIGINT AS n_numbers, len(list_filter(own, lambda x: NOT contains(coalesce(before, ''), x)))::BIGINT AS n_ungrounded FROM n""")
def grounding_check(t: Tables) -> DataFrame:
    """Numbers of a turn that the turn before doesn't have."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    df = t.conversations.select("conv_id", "turn", F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("own"), F.coalesce(before, F.lit("")).alias("before"))
    return df.select("conv_id", "turn", F.size("own").cast("long").alias("n_numbers"), F.size(F.filter("own", lambda x: ~F.contains(F.col("before"), x))).cast("long").alias("n_ungrounded"))


#: Claims that need evidence, by group (fixed values of this binding).
CLAIMS = {"insult": ("idiot", "moron", "trash"), "license": ("license", "public"), "stop": ("the", "and")}


@query("SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN {' OR '.join(f'contains(lower(text), {chr(39)}{x}{chr(39)})' for x in xs)} THEN '{g}' END" for g, xs in CLAIMS.items()) + ") AS claim_groups FROM documents")
def claim_groups(t: Tables) -> DataFrame:
    low = F.lower("text")
    return t.documents.select("doc_id", F.array_join(F.array_compact(F.array(*[F.when(text.n_terms(low, xs) > 0, F.lit(g)) for g, xs in CLAIMS.items()])), ",").alias("claim_groups"))


@query("""WITH s AS (SELECT part.*, list_filter(['S', 'M', 'L', 'XL'], lambda x: (x = 'S' AND p_size < 15) OR (x = 'M' AND p_size BETWEEN 10 AND 30) OR (x = 'L' AND p_size > 25) OR (x = 'XL' AND p_size > 45)) AS sizes FROM part)
SELECT p_brand, count(*) AS n_parts, round(avg((len(sizes) >= 2)::INTEGER), 6) AS multi_share, CASE WHEN avg((len(sizes) >= 2)::INTEGER) >= 0.5 THEN 'assorted' ELSE 'single' END AS strategy FROM s GROUP BY 1""")
def assortment_strategy(t: Tables) -> DataFrame:
    """Brands whose parts mostly come in several sizes."""
    s = F.col("p_size")
    sizes = F.array_compact(F.array(F.when(s < 15, F.lit("S")), F.when(s.between(10, 30), F.lit("M")), F.when(s > 25, F.lit("L")), F.when(s > 45, F.lit("XL"))))
    share = F.avg((F.size(sizes) >= 2).cast("int"))
    return t.part.groupBy("p_brand").agg(F.count("*").alias("n_parts"), F.round(share, 6).alias("multi_share"), F.when(share >= 0.5, "assorted").otherwise("single").alias("strategy"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 40 THEN 'active' WHEN l_quantity < 2 THEN 'sold_out' ELSE 'unknown' END AS by_quantity,
CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'active' WHEN l_returnflag IN ('A', 'N', 'R') THEN 'inactive' ELSE 'unknown' END AS by_flags FROM lineitem""")
def status_maps(t: Tables) -> DataFrame:
    q, r, s = F.col("l_quantity"), F.col("l_returnflag"), F.col("l_linestatus")
    flags = F.when((r == "N") & (s == "O"), "active").when(r.isin("A", "N", "R"), "inactive").otherwise("unknown")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.when(q > 40, "active").when(q < 2, "sold_out").otherwise("unknown").alias("by_quantity"), flags.alias("by_flags"))


@query("""SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_totalprice >= 400000 AND contains(lower(concat_ws(' ', o_orderpriority, o_orderstatus)), 'urgent') ORDER BY o_orderdate, o_orderkey LIMIT 25 OFFSET 50""")
def filtered_page(t: Tables) -> DataFrame:
    """Optional filters, a search over several fields, and a page by offset."""
    filters = [F.col("o_orderstatus").isin("O", "P"), F.col("o_totalprice") >= 400000, F.contains(F.lower(F.concat_ws(" ", "o_orderpriority", "o_orderstatus")), F.lit("urgent"))]
    df = t.orders
    for f in filters:
        df = df.where(f)
    return df.select("o_orderkey", "o_orderpriority", "o_orderdate").orderBy("o_orderdate", "o_orderkey").offset(50).limit(25)


@query("SELECT p_brand, coalesce(CASE WHEN p_type = 'PROMO' THEN NULL ELSE p_type END, 'none') AS scope, coalesce(max(p_size), 0) + 1 AS next_version FROM part GROUP BY 1, 2")
def next_versions(t: Tables) -> DataFrame:
    scope = F.when(F.col("p_type") != "PROMO", F.col("p_type"))
    return t.part.groupBy("p_brand", F.coalesce(scope, F.lit("none")).alias("scope")).agg((F.coalesce(F.max("p_size"), F.lit(0)) + 1).alias("next_version"))


@query("""WITH s AS (SELECT c_custkey, greatest(0, least(100, floor(c_acctbal / 100 + 0.5)))::BIGINT AS score FROM customer)
SELECT c_custkey, score, CASE WHEN score < 40 THEN 'critical' WHEN score < 60 THEN 'high' WHEN score < 80 THEN 'medium' ELSE 'low' END AS grade FROM s""")
def score_grades(t: Tables) -> DataFrame:
    score = text.clamp(text.js_round(F.col("c_acctbal") / 100)).cast("long")
    return t.customer.select("c_custkey", score.alias("score"), grade(score).alias("grade"))


@query("""SELECT c_custkey, c_acctbal FROM customer c WHERE c_acctbal > 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2001-06-01') ORDER BY c_acctbal, c_custkey LIMIT 50""")
def cooldown_selection(t: Tables) -> DataFrame:
    """The 50 lowest that weren't touched lately; a top-k report."""
    recent = t.orders.where(F.col("o_orderdate") >= F.lit("2001-06-01").cast("timestamp")).select(F.col("o_custkey").alias("c_custkey"))
    rested = merges.insert_new(recent, t.customer.where("c_acctbal > 0").select("c_custkey", "c_acctbal"), ["c_custkey"])
    return ordering.top(rested, [F.asc("c_acctbal"), F.asc("c_custkey")], 50)


@query("""WITH g AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'P') AS p, max(o_totalprice) AS top FROM orders GROUP BY 1), r AS (SELECT o_custkey, unnest(list_filter([CASE WHEN n < 8 THEN 'few_orders' END, CASE WHEN p > 4 THEN 'many_partial' END, CASE WHEN top > 490000 THEN 'high_order' END], lambda x: x IS NOT NULL)) AS reason FROM g)
SELECT reason, count(*) AS n FROM r GROUP BY 1""")
def reason_histogram(t: Tables) -> DataFrame:
    g = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.count_if(F.col("o_orderstatus") == "P").alias("p"), F.max("o_totalprice").alias("top"))
    reasons = F.array_compact(F.array(F.when(F.col("n_orders") < 8, F.lit("few_orders")), F.when(F.col("p") > 4, F.lit("many_partial")), F.when(F.col("top") > 490000, F.lit("high_order"))))
    return aggregates.histogram(g, reasons, "reason")
