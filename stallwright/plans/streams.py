"""Batch twins of the streams: late findings, pending ones, snapshot history, of all events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import late
from ..sources.tables import Tables
from .registry import query

#: How long after a result its findings may come.
BOUND = "180 SECONDS"
_RESULTS = """k AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
results AS (SELECT event_id AS result_id, CASE WHEN k % 7 <> 0 THEN event_id END AS request_id, ts, value AS score, CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN 'technical_only' WHEN 2 THEN 'technical_ocr' WHEN 3 THEN 'technical_ocr_marketplace' WHEN 4 THEN 'full_review' ELSE 'other' END AS completeness FROM k WHERE event_type IN ('view', 'click', 'purchase')),
findings AS (SELECT event_id - 1 AS finding_request, ts AS found_at, k AS fk, event_type AS found_type FROM k WHERE event_type <> 'error'),
j AS (SELECT r.*, f.found_at, found_type, f.found_at IS NOT NULL AS applied, f.found_at IS NOT NULL AND fk % 3 <> 0 AND fk % 11 <> 0 AS enriched FROM results r LEFT JOIN findings f ON finding_request = request_id AND found_at >= ts AND found_at <= ts + INTERVAL 180 SECOND)"""


def review_results(events: DataFrame) -> DataFrame:
    """Views, clicks and purchases as results of a first review; some ask for no second."""
    k = F.get_json_object("props", "$.k").cast("int")
    first = F.array(F.struct(F.lit("technical").alias("type"), F.lit("low").alias("severity"), F.lit(1.0).alias("confidence"), F.lit("technical").alias("source"), F.lit("").alias("evidence"), F.lit("").alias("operator_note")))
    known = F.when(k % 6 == 1, "technical_only").when(k % 6 == 2, "technical_ocr").when(k % 6 == 3, "technical_ocr_marketplace").when(k % 6 == 4, "full_review").when(k % 6 == 5, "other")
    asked = events.where(F.col("event_type").isin("view", "click", "purchase"))
    return asked.select(F.col("event_id").alias("result_id"), F.when(k % 7 != 0, F.col("event_id")).alias("request_id"), "ts", first.alias("issues"), known.alias("completeness"), F.col("value").alias("score"))


def review_findings(events: DataFrame) -> DataFrame:
    """Each event as the answer to the request of the one before it."""
    k, kind = F.get_json_object("props", "$.k").cast("int"), F.col("event_type")
    listed = F.concat(F.lit('[{"type": " blur ", "severity": "high", "evidence": 5}, {"type": "", "severity": "low"}, {"type": "text_'), kind, F.lit('", "severity": "awful", "operator_note": "look"}, '), "props", F.lit(", 7]"))
    body = F.when(k % 11 == 0, "oops [").when(k % 3 == 0, "[]").otherwise(listed)
    return events.select((F.col("event_id") - 1).alias("finding_request"), F.col("ts").alias("found_at"), F.when(kind == "error", "failed").otherwise("completed").alias("status"), body.alias("body"))


def flat(enriched: DataFrame) -> DataFrame:
    each = lambda name: F.col(f"issues.{name}").alias(f"{name}s")
    return enriched.select("result_id", "n_enriched", "completeness", "applied", "score", each("type"), each("severity"), each("operator_note"))


@query(f"""WITH {_RESULTS} SELECT result_id, CASE WHEN enriched THEN 2 ELSE 0 END AS n_enriched, CASE WHEN enriched AND (completeness IS NULL OR completeness LIKE 'technical%') THEN 'technical_ocr_qwen' ELSE completeness END AS completeness, applied, score,
  CASE WHEN enriched THEN ['technical', 'blur', 'text_' || found_type] ELSE ['technical'] END AS types, CASE WHEN enriched THEN ['low', 'high', 'medium'] ELSE ['low'] END AS severitys, CASE WHEN enriched THEN ['', 'Qwen flagged: blur', 'look'] ELSE [''] END AS operator_notes FROM j""")
def late_findings_enriched(t: Tables) -> DataFrame:
    """Findings that came in time, appended to their results; the score stays."""
    return flat(late.enriched(review_results(t.events), review_findings(t.events), BOUND))


@query(f"WITH {_RESULTS} SELECT result_id, request_id, ts FROM j WHERE NOT applied AND request_id IN (SELECT finding_request FROM findings)")
def pending_findings(t: Tables) -> DataFrame:
    """Results whose findings came after their time and wait to be applied."""
    findings = review_findings(t.events)
    return late.pending(late.enriched(review_results(t.events), findings, BOUND), findings)


def captures(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("listing"), "ts", F.col("event_id").alias("id"), F.sha2("event_type", 256).alias("hash"))


@query("""WITH c AS (SELECT user_id AS listing, ts, event_id AS id, sha256(event_type) AS hash FROM events), ch AS (SELECT *, lag(hash) OVER (PARTITION BY listing ORDER BY ts, id) AS before FROM c QUALIFY before IS NULL OR before <> hash),
s AS (SELECT *, first_value(id) OVER (PARTITION BY listing, hash ORDER BY ts, id) AS snapshot FROM ch)
SELECT listing, ts AS valid_from, lead(ts) OVER w AS valid_to, hash, snapshot, snapshot = id AS is_new, lag(snapshot) OVER w AS replaced FROM s WINDOW w AS (PARTITION BY listing ORDER BY ts, id)""")
def snapshot_history(t: Tables) -> DataFrame:
    """Which snapshot held when: a content that comes back is no new snapshot."""
    order = Window.partitionBy("listing").orderBy("ts", "id")
    changes = captures(t.events).withColumn("before", F.lag("hash").over(order)).where("before is null or before <> hash")
    known = changes.withColumn("snapshot", F.first("id").over(Window.partitionBy("listing", "hash").orderBy("ts", "id")))
    return known.select("listing", F.col("ts").alias("valid_from"), F.lead("ts").over(order).alias("valid_to"), "hash", "snapshot", (F.col("snapshot") == F.col("id")).alias("is_new"), F.lag("snapshot").over(order).alias("replaced"))
