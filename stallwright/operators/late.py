"""Findings of a slower review that reach a result late, or never.

The functions work on tables and on streams alike; on streams, watermarks on both sides
and the time bound keep the join's state small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Confidence of late issues, known severities and the one that stands for others, and
#: completeness: what counts as full already, and what becomes the full one (fixed values).
CONFIDENCE, SEVERITIES, OTHER_SEVERITY = 0.7, ("low", "medium", "high", "critical"), "medium"
FULL, UPGRADED, UPGRADES = ("technical_ocr_qwen", "full_review"), "technical_ocr_qwen", ("technical_ocr", "technical_ocr_marketplace", "technical_only")
SOURCE = "qwen_visual"
ISSUE = "struct<type:string,severity:string,confidence:double,source:string,evidence:string,operator_note:string>"


def late_issues(body: Column) -> Column:
    """A JSON list of findings as issues: those without a type go, unknown severities and
    missing notes get their defaults. No list: no issues."""
    text = lambda x, name: F.when(F.schema_of_variant(F.try_variant_get(x, f"$.{name}", "variant")) == "STRING", F.try_variant_get(x, f"$.{name}", "string"))

    def issue(x: Column) -> Column:
        kind, severity = F.trim(text(x, "type")), text(x, "severity")
        return F.when(
            F.length(kind) > 0,
            F.struct(
                kind.alias("type"),
                F.when(severity.isin(*SEVERITIES), severity).otherwise(OTHER_SEVERITY).alias("severity"),
                F.lit(CONFIDENCE).alias("confidence"),
                F.lit(SOURCE).alias("source"),
                F.coalesce(text(x, "evidence"), F.lit("")).alias("evidence"),
                F.coalesce(text(x, "operator_note"), F.concat(F.lit("Qwen flagged: "), kind)).alias("operator_note"),
            ),
        )

    listed = F.try_variant_get(F.try_parse_json(body), "$", "array<variant>")
    return F.coalesce(F.array_compact(F.transform(listed, issue)), F.array().cast(f"array<{ISSUE}>"))


def upgraded(completeness: Column) -> Column:
    return F.when(completeness.isNull() | completeness.isin(*UPGRADES), UPGRADED).otherwise(completeness)


def enriched(results: DataFrame, findings: DataFrame, bound: str) -> DataFrame:
    """results(result_id, request_id, ts, issues, completeness, score) with the findings
    (finding_request, found_at, status, body) of their requests that come within ``bound``
    after them: issues appended as advice, completeness upgraded if any issue came, applied
    if the findings are complete; the score stays. Results without a request, or whose
    findings fail or never come, are as they were, not applied.

    A request has one finding. Of streams, both need a watermark on ts and found_at; that
    of the findings moves with completed ones, as the filter is pushed below it."""
    near = (F.col("finding_request") == F.col("request_id")) & (F.col("found_at") >= F.col("ts")) & (F.col("found_at") <= F.col("ts") + F.expr(f"INTERVAL {bound}"))
    j = results.join(findings.where("status = 'completed'").select("finding_request", "found_at", late_issues(F.col("body")).alias("more")), near, "left_outer")
    more = F.coalesce("more", F.array().cast(f"array<{ISSUE}>"))
    return j.select(
        "result_id", "request_id", "ts", "found_at", F.concat("issues", more).alias("issues"), F.size(more).cast("long").alias("n_enriched"),
        F.when(F.size(more) > 0, upgraded(F.col("completeness"))).otherwise(F.col("completeness")).alias("completeness"), "score", F.col("found_at").isNotNull().alias("applied"),
    )


def pending(results: DataFrame, findings: DataFrame) -> DataFrame:
    """(result_id, request_id, ts) of results not applied whose request is completed by now:
    what a later pass has to apply."""
    done = findings.where("status = 'completed'").select(F.col("finding_request").alias("request_id"))
    return results.where("not applied").select("result_id", "request_id", "ts").join(done, "request_id", "left_semi").select("result_id", "request_id", "ts")
