"""Event tables as lifecycles: folds, replays, gates, promotion flow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lifecycle, merges
from ..sources.tables import Tables
from .registry import query

#: A user moves forward by these events, and falls back to the start by an error.
STEPS = {"new": ("signup", "error"), "signup": ("view", "error"), "view": ("click", "error"), "click": ("purchase", "error"), "purchase": ("error",), "error": ("signup",)}


@query("""WITH RECURSIVE e AS (SELECT user_id, event_type AS wanted, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, 0::BIGINT AS n, 'new' AS state, 0::BIGINT AS applied, 0::BIGINT AS refused FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT g.user_id, g.en, CASE WHEN ok THEN wanted ELSE state END, applied + ok::INTEGER, refused + (NOT ok)::INTEGER FROM (
    SELECT f.*, e.wanted, e.n AS en, coalesce((wanted = 'error' AND state <> 'error') OR (state = 'new' AND wanted = 'signup') OR (state = 'signup' AND wanted = 'view') OR (state = 'view' AND wanted = 'click') OR (state = 'click' AND wanted = 'purchase') OR (state = 'error' AND wanted = 'signup'), false) AS ok
    FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1) g)
SELECT user_id, state, applied, refused FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC) AS r FROM f) WHERE r = 1""")
def lifecycle_fold(t: Tables) -> DataFrame:
    return lifecycle.fold_runs(t.events.select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], "event_type", "new", STEPS)


@query("""WITH stored AS (SELECT event_id, sha256(event_type || '|' || user_id) AS h FROM events WHERE event_id % 4 <> 0),
inc AS (SELECT event_id, sha256(CASE WHEN event_id % 10 = 1 THEN 'x' ELSE event_type END || '|' || user_id) AS h FROM events WHERE event_id % 2 = 0 OR event_id % 10 = 1)
SELECT i.event_id, CASE WHEN s.h IS NULL THEN 'created' WHEN s.h = i.h THEN 'unchanged' ELSE 'updated' END AS outcome FROM inc i LEFT JOIN stored s USING (event_id)""")
def idempotent_replay(t: Tables) -> DataFrame:
    """A batch that is partly new, partly known and partly changed."""
    h = lambda kind: F.sha2(F.concat_ws("|", kind, F.col("user_id").cast("string")), 256).alias("h")
    stored = t.events.where("event_id % 4 <> 0").select("event_id", h(F.col("event_type")))
    incoming = t.events.where("event_id % 2 = 0 or event_id % 10 = 1").select("event_id", h(F.when(F.col("event_id") % 10 == 1, "x").otherwise(F.col("event_type"))))
    return merges.upsert_outcomes(stored, incoming, ["event_id"], "h").select("event_id", "outcome")


@query("""WITH w AS (SELECT event_id, ts, event_id // 1000 AS batch FROM events), b AS (SELECT batch, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (batch + 1) * 72 AS window_end FROM (SELECT DISTINCT batch FROM w))
SELECT batch::BIGINT AS batch, count(*) AS n_rows, count(*) FILTER (WHERE ts > window_end) AS n_leaking, CASE WHEN count(*) FILTER (WHERE ts > window_end) > 0 THEN 'rejected' ELSE 'accepted' END AS verdict FROM w JOIN b USING (batch) GROUP BY 1""")
def window_gate(t: Tables) -> DataFrame:
    """Batches with a declared end: one leaking row rejects the whole batch."""
    from ..streaming.ingest import gate

    df = t.events.withColumn("batch", F.floor(F.col("event_id") / 1000).cast("long"))
    end = F.timestamp_add("HOUR", (F.col("batch") + 1) * 72, F.lit("2024-01-01").cast("timestamp"))
    return gate(df.withColumn("window_end", end), "batch", "ts", "window_end")


@query("""WITH c AS (SELECT p_partkey, floor(p_retailprice * 0.95::DOUBLE * 100 + 0.5) / 100 AS price FROM part WHERE p_size > 0 AND p_type = 'PROMO'), d AS (SELECT *, CASE WHEN price > 950 THEN 'approve' ELSE 'review' END AS decision FROM c),
a AS (SELECT * FROM d WHERE decision = 'approve' AND p_partkey % 2 = 0)
SELECT p_partkey, price, decision, CASE WHEN a.p_partkey IS NOT NULL THEN 'executed' WHEN decision = 'approve' THEN 'waiting' ELSE 'held' END AS stage FROM d LEFT JOIN (SELECT p_partkey FROM a) a USING (p_partkey)""")
def promotion_flow(t: Tables) -> DataFrame:
    """Candidates, decisions, approvals, executions; each step adds only what is new."""
    from ..functions.pricing import promotion_price

    candidates = t.part.where("p_size > 0 and p_type = 'PROMO'").select("p_partkey", promotion_price(F.col("p_retailprice")).alias("price"))
    decided = candidates.withColumn("decision", F.when(F.col("price") > 950, "approve").otherwise("review"))
    approved = decided.where("decision = 'approve' and p_partkey % 2 = 0").select("p_partkey").withColumn("__done", F.lit(True))
    j = decided.join(approved, "p_partkey", "left")
    return j.select("p_partkey", "price", "decision", F.when(F.col("__done"), "executed").when(F.col("decision") == "approve", "waiting").otherwise("held").alias("stage"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'replay' WHEN p_partkey % 11 = 1 THEN 'taken' WHEN p_size * 2 < 75 THEN 'not_eligible' WHEN p_partkey % 3 = 0 THEN 'stale' ELSE 'claimed' END AS outcome FROM part""")
def publish_claims(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    claim = F.when(k % 11 == 0, "me").when(k % 11 == 1, "other")
    outcome = lifecycle.claim_outcome(F.lit(3), F.when(k % 3 == 0, 2).otherwise(3), F.col("p_size") * 2, claim, F.lit("me"))
    return t.part.select("p_partkey", outcome.alias("outcome"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'missing' WHEN p_partkey % 4 = 0 THEN 'drift' ELSE 'same' END AS observation FROM part""")
def observation_drift(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    expected = t.part.where("p_partkey % 9 <> 0").select("p_partkey", "p_name", "p_brand")
    observed = t.part.select("p_partkey", F.when(k % 5 == 0, "").otherwise(F.col("p_name")).alias("p_name"), F.when(k % 4 == 0, "other").otherwise(F.col("p_brand")).alias("p_brand"))
    return lifecycle.reconcile(expected, observed, "p_partkey", ["p_name", "p_brand"])
