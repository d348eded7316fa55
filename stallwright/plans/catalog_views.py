"""Boards, options, requests in order, windows, activation and fresh projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import views
from ..sources.tables import Tables
from .registry import query

_REQUESTS = "req AS (SELECT doc_id AS pos, CASE WHEN doc_id % 4 = 0 THEN '  ' || upper(source) || chr(9) WHEN doc_id % 4 = 1 THEN source || 'x' ELSE source END AS code FROM documents WHERE source IS NOT NULL), known AS (SELECT DISTINCT source AS code FROM documents WHERE doc_id % 7 < 3 AND source IS NOT NULL)"
_NORMAL = "lower(regexp_replace({0}, '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g'))"


def _requests(t: Tables) -> tuple[DataFrame, DataFrame]:
    named = t.documents.where("source is not null")
    code = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("  "), F.upper("source"), F.lit("\t"))).when(F.col("doc_id") % 4 == 1, F.concat("source", F.lit("x"))).otherwise(F.col("source"))
    return views.matched(named.select(F.col("doc_id").alias("pos"), code.alias("code")), named.where("doc_id % 7 < 3").select(F.col("source").alias("code")), "code")


@query(f"WITH {_REQUESTS} SELECT pos, r.code, min(k.code) AS known FROM req r JOIN known k ON {_NORMAL.format('r.code')} = {_NORMAL.format('k.code')} GROUP BY pos, r.code ORDER BY pos")
def matched_codes(t: Tables) -> DataFrame:
    """Requested codes that are known, case and outer white space ignored, in the order of the requests."""
    return _requests(t)[0].orderBy("pos")


@query(f"WITH {_REQUESTS} SELECT pos, {_NORMAL.format('code')} AS code FROM req WHERE {_NORMAL.format('code')} NOT IN (SELECT {_NORMAL.format('code')} FROM known) ORDER BY pos")
def unmatched_codes(t: Tables) -> DataFrame:
    """The requested codes that nothing is known of, in the order of the requests."""
    return _requests(t)[1].orderBy("pos")


@query("SELECT coalesce(nullif(CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END, ''), 'none') || '|' || coalesce(CASE WHEN value > 50 THEN 'dear' END, 'none') AS key, count(*) AS n FROM events GROUP BY 1")
def counts_by_composite_key(t: Tables) -> DataFrame:
    return views.composite_counts(t.events, F.when(F.col("event_id") % 5 == 0, "").otherwise(F.col("event_type")), F.when(F.col("value") > 50, "dear"))


@query("""SELECT 'lang' AS "column", list_sort(list(DISTINCT lang)) AS options FROM documents WHERE lang <> '' UNION ALL SELECT 'source', list_sort(list(DISTINCT source)) FROM documents WHERE source <> ''""")
def option_lists(t: Tables) -> DataFrame:
    """The values to choose from, for each filter."""
    return views.options(t.documents, ["lang", "source"])


_BOARD = ("inbox", "signup", "view", "click", "purchase", "error", "archive")


@query(f"""WITH c(place, status) AS (VALUES {', '.join(f"({i}, '{s}')" for i, s in enumerate(_BOARD, 1))}), r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events)
SELECT place::INTEGER AS place, status, (SELECT count(*) FROM events WHERE event_type = status) AS n, coalesce((SELECT list(event_id ORDER BY r) FROM r WHERE event_type = status AND r <= 5), []) AS first FROM c""")
def status_board(t: Tables) -> DataFrame:
    """Seven fixed columns with their counts and their five most valuable events."""
    return views.board(t.events, "event_type", _BOARD, "event_id", [F.desc("value"), F.asc("event_id")], 5)


@query("SELECT p_partkey, p_brand, p_type, p_size FROM part WHERE p_size > 10 AND p_type IS NOT NULL ORDER BY p_brand, p_type, p_size, p_partkey")
def active_options(t: Tables) -> DataFrame:
    """Options that are active, by three keys and then their number."""
    return t.part.where("p_size > 10 and p_type is not null").select("p_partkey", "p_brand", "p_type", "p_size").orderBy("p_brand", "p_type", "p_size", "p_partkey")


@query("""WITH e AS (SELECT event_id, ts AS event, CASE WHEN event_id % 9 = 0 THEN NULL ELSE ts - INTERVAL 1 HOUR * (event_id % 5) END AS s, ts + INTERVAL 1 HOUR * ((event_id % 7) - 2) AS e FROM events)
SELECT event_id, list_filter([CASE WHEN NOT coalesce(s < e, false) THEN 'window_order' END, CASE WHEN NOT coalesce(event <= e, false) THEN 'event_after_window' END, CASE WHEN NOT coalesce(event <= TIMESTAMP '2024-01-15' + INTERVAL 1 HOUR, false) THEN 'event_in_future' END], lambda x: x IS NOT NULL) AS faults FROM e""")
def window_faults(t: Tables) -> DataFrame:
    """Windows of observations checked against a fixed clock."""
    i, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    start, end = F.when(i % 9 != 0, F.timestamp_add("HOUR", -(i % 5), ts)), F.timestamp_add("HOUR", (i % 7) - 2, ts)
    return t.events.select("event_id", views.window_faults(start, end, ts, F.lit("2024-01-15").cast("timestamp")).alias("faults"))


@query("""WITH s AS (SELECT p_brand AS scope, p_partkey AS version, CASE WHEN p_size = 7 AND p_partkey % 5 = 0 THEN 'active' WHEN p_partkey % 3 = 0 THEN 'draft' ELSE 'retired' END AS status FROM part)
SELECT scope, version, NOT EXISTS (SELECT 1 FROM s x WHERE x.scope = s.scope AND x.status = 'active' AND x.version <> s.version) AS allowed FROM s WHERE status = 'draft'""")
def activation_gate(t: Tables) -> DataFrame:
    """Drafts that may become active, as no other version of their scope is."""
    status = F.when((F.col("p_size") == 7) & (F.col("p_partkey") % 5 == 0), "active").when(F.col("p_partkey") % 3 == 0, "draft").otherwise("retired")
    s = t.part.select(F.col("p_brand").alias("scope"), F.col("p_partkey").alias("version"), status.alias("status"))
    return views.activation(s.where("status = 'draft'").select("scope", "version"), s, ["scope"], F.col("status") == "active")


@query("""WITH last AS (SELECT o_orderpriority AS source, max(o_orderdate) AS last_run FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' GROUP BY 1), x AS (SELECT c_custkey, c_name, n_name, r_name, o_orderpriority AS source, count(*) AS n_orders FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
SELECT x.*, last_run, coalesce(last_run >= TIMESTAMP '2001-07-30' - INTERVAL 2 DAY, false) AS fresh FROM x LEFT JOIN last USING (source)""")
def projection_with_freshness(t: Tables) -> DataFrame:
    """A star projection of customers and sources, with the freshness of each source's last run."""
    c = F.col
    rows = t.customer.join(t.nation, c("c_nationkey") == c("n_nationkey")).join(t.region, c("n_regionkey") == c("r_regionkey"))
    counts = t.orders.groupBy("o_custkey", c("o_orderpriority").alias("source")).agg(F.count("*").alias("n_orders"))
    star = rows.join(counts, c("o_custkey") == c("c_custkey")).select("c_custkey", "c_name", "n_name", "r_name", "source", "n_orders")
    runs = t.orders.select(c("o_orderpriority").alias("source"), c("o_orderdate").alias("finished"), c("o_orderstatus").alias("status"))
    return views.fresh_projection(star, runs, "source", (c("status") == "F") & (c("source") != "5-LOW"), F.lit("2001-07-30").cast("timestamp_ntz"), "2 DAYS")
