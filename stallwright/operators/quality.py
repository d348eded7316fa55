"""Quality reviews of listings: issue types, scopes, cycles, late findings, requests."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Issue types with category and default severity (fixed values).
ISSUE_TYPES = (
    ("broken_image_url", "image_technical", "high"),
    ("image_slow_load", "image_technical", "low"),
    ("image_low_resolution", "image_technical", "medium"),
    ("duplicate_url", "image_content", "medium"),
    ("duplicate_content", "image_content", "low"),
    ("missing_main_image", "image_content", "critical"),
    ("image_count_low", "image_content", "high"),
    ("image_gap", "image_content", "low"),
    ("image_text_overlay", "image_compliance", "medium"),
    ("image_watermark", "image_compliance", "high"),
    ("image_size_noncompliant", "image_compliance", "medium"),
    ("title_too_short", "content_quality", "high"),
    ("title_spammy", "content_quality", "medium"),
    ("description_missing", "content_quality", "high"),
    ("description_too_short", "content_quality", "medium"),
    ("missing_dimensions", "content_quality", "medium"),
    ("missing_material", "content_quality", "low"),
    ("missing_required_fields", "compliance", "high"),
    ("forbidden_claims", "compliance", "critical"),
    ("category_mismatch", "compliance", "high"),
    ("weak_main_image", "conversion", "high"),
    ("no_lifestyle_image", "conversion", "medium"),
    ("no_scale_reference", "conversion", "low"),
    ("no_detail_closeup", "conversion", "low"),
    ("price_anomaly", "operational", "high"),
    ("stock_mismatch", "operational", "medium"),
    ("status_inconsistent", "operational", "medium"),
)
#: Scores that issues of a type lower (fixed values).
AFFECTED_SCORES = {
    "broken_image_url": ("technical", "operationalRisk"),
    "image_slow_load": ("technical",),
    "image_low_resolution": ("technical", "image"),
    "duplicate_url": ("image",),
    "duplicate_content": ("image",),
    "missing_main_image": ("image", "conversion", "operationalRisk"),
    "image_count_low": ("image", "conversion"),
    "image_gap": ("image",),
    "image_text_overlay": ("compliance",),
    "image_watermark": ("compliance",),
    "image_size_noncompliant": ("compliance", "technical"),
    "title_too_short": ("content", "conversion"),
    "title_spammy": ("content",),
    "description_missing": ("content", "conversion"),
    "description_too_short": ("content",),
    "missing_dimensions": ("content", "compliance"),
    "missing_material": ("content",),
    "missing_required_fields": ("compliance", "operationalRisk"),
    "forbidden_claims": ("compliance", "operationalRisk"),
    "category_mismatch": ("compliance", "conversion"),
    "weak_main_image": ("conversion", "image"),
    "no_lifestyle_image": ("conversion",),
    "no_scale_reference": ("conversion",),
    "no_detail_closeup": ("conversion",),
    "price_anomaly": ("operationalRisk", "compliance"),
    "stock_mismatch": ("operationalRisk",),
    "status_inconsistent": ("operationalRisk",),
}
SEVERITIES = ("low", "medium", "high", "critical")
#: Weight of a severity in a review request's priority, and the least one (fixed values).
SEVERITY_WEIGHTS, LEAST_PRIORITY = {"critical": 10, "high": 7, "medium": 5, "low": 3}, 5
#: States in which a quality cycle is open (fixed values).
OPEN_CYCLES = ("not_reviewed", "review_queued", "reviewed", "fix_needed", "fix_in_progress", "fix_ready_for_review", "re_review_queued", "improved")


def issue_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ISSUE_TYPES, "type string, category string, default_severity string")


def affected_scores(issues: DataFrame, by: str) -> DataFrame:
    """issues(by, type) -> (by, score, n_issues): the scores that its issues lower."""
    rows = [(t, s) for t, scores in AFFECTED_SCORES.items() for s in scores]
    known = F.broadcast(issues.sparkSession.createDataFrame(rows, "type string, score string"))
    return issues.join(known, "type").groupBy(by, "score").agg(F.count("*").alias("n_issues"))


def model_issues(body: Column) -> Column:
    """Issues in a model's JSON object: those with a text as type and a known severity
    (medium if there's none), image places that are numbers only, notes filled in."""
    text = lambda x, name: F.when(F.schema_of_variant(F.try_variant_get(x, f"$.{name}", "variant")) == "STRING", F.try_variant_get(x, f"$.{name}", "string"))
    given = lambda x, name: F.try_variant_get(x, f"$.{name}", "variant")
    numeric = lambda v: F.schema_of_variant(v).rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)")

    def issue(x: Column) -> Column:
        kind = text(x, "type")
        missing = given(x, "severity").isNull() | F.is_variant_null(given(x, "severity"))
        severity = F.when(missing, "medium").otherwise(text(x, "severity"))
        places = F.transform(F.filter(F.try_variant_get(x, "$.affected_image_indexes", "array<variant>"), numeric), lambda v: F.try_variant_get(v, "$", "double"))
        note = F.coalesce(text(x, "operator_note"), F.concat(F.lit("visual review flagged: "), kind))
        kept = (kind != "") & severity.isin(*SEVERITIES)
        return F.when(kept, F.struct(kind.alias("type"), severity.alias("severity"), F.coalesce(places, F.array().cast("array<double>")).alias("images"), F.coalesce(text(x, "evidence"), F.lit("")).alias("evidence"), note.alias("note")))

    listed = F.try_variant_get(F.try_parse_json(body), "$.issues", "array<variant>")
    return F.coalesce(F.array_compact(F.transform(listed, issue)), F.array().cast("array<struct<type:string,severity:string,images:array<double>,evidence:string,note:string>>"))


def open_or_new_cycles(triggers: DataFrame, stored: DataFrame, key: Sequence[str]) -> DataFrame:
    """triggers(key ..., at, source), stored(key ..., cycle, status, created_at) -> one row a
    key: its latest stored cycle in an open state, or a new one that the first trigger
    makes (``is_new``, status not_reviewed, created_from), named by a hash of key and time.
    A second trigger of a key finds the cycle of the first."""
    first = triggers.groupBy(*key).agg(F.min(F.struct("at", "source")).alias("t"), F.count("*").alias("n_triggers"))
    last = stored.where(F.col("status").isin(*OPEN_CYCLES)).groupBy(*key).agg(F.max(F.struct("created_at", "cycle", "status")).alias("s"))
    j = first.join(last, list(key), "left")
    new = F.col("s").isNull()
    name = F.substring(F.sha2(F.concat_ws(":", *[F.col(k).cast("string") for k in key], F.unix_micros(F.col("t.at").cast("timestamp")).cast("string")), 256), 1, 16)
    return j.select(*key, F.when(new, name).otherwise(F.col("s.cycle")).alias("cycle"), F.when(new, "not_reviewed").otherwise(F.col("s.status")).alias("status"), new.alias("is_new"), F.when(new, F.col("t.source")).alias("created_from"), "n_triggers")


def normal_issue(type_: Column, severity: Column) -> Column:
    """(type, severity) of a model's issue: null without a type, medium without a known
    severity."""
    t = F.nullif(F.trim(type_), F.lit(""))
    return F.when(t.isNotNull(), F.struct(t.alias("type"), F.when(severity.isin(*SEVERITIES), severity).otherwise("medium").alias("severity")))


def severity_weight(severity: Column) -> Column:
    out = F.lit(0)
    for name, weight in SEVERITY_WEIGHTS.items():
        out = F.when(severity == name, weight).otherwise(out)
    return out


def review_scope(listings: DataFrame, scope: str, heroes: DataFrame, images: DataFrame) -> DataFrame:
    """Active listings(listing, spu, status) in a policy's scope: of hero SPUs, all, with
    images, or (``curated`` and any other) with images and of hero SPUs, if there are
    any. heroes(spu), images(listing); the sets join, whatever their size."""
    active = listings.where("status = 'active'")
    of_heroes, with_images = active.join(heroes, "spu", "left_semi"), active.join(images, "listing", "left_semi")
    if scope == "hero_products":
        return of_heroes
    if scope == "all_active":
        return active
    if scope == "active_with_images":
        return with_images
    some = heroes.limit(1).agg((F.count("*") > 0).alias("__heroes"))
    return with_images.join(F.broadcast(some)).join(heroes.select("spu", F.lit(True).alias("__hero")).distinct(), "spu", "left").where("__hero or not __heroes").select(listings.columns)


def may_be_reviewed(platform: Column, workflow: Column, issue: Column, action: Column, findings: Column) -> Column:
    """null for a work item that a model may review, else why not."""
    unresolved = (issue == "missing_mapping") | (action == "create_mapping_task")
    named = F.contains(F.lower(findings), F.lit("missing_mapping")) | F.contains(F.lower(findings), F.lit("create_mapping_task"))
    return F.when(~F.coalesce(platform.isin("rakuten", "amazon", "mercari"), F.lit(False)), "platform").when(F.coalesce(unresolved, F.lit(False)), "unresolved mapping").when(F.coalesce(named, F.lit(False)), "mapping in findings").when(~workflow.eqNullSafe(F.lit("audit_existing_listing")), "workflow")


def profile_of(platform: Column) -> Column:
    return F.when(platform == "amazon", "amazon_mapping_audit_v1").when(platform == "mercari", "mercari_listing_audit_v1").otherwise("rakuten_listing_audit_v1")


def cycles(reviews: DataFrame, listing: str, order: Sequence[str], score: str, n_issues: str, closed: str) -> DataFrame:
    """Reviews of a listing in order belong to its open cycle; a review that closes it
    (approves) is its last. Per review: cycle number, baseline (the cycle's first
    score), delta to it, and the status after it. A listing has a bounded number of
    reviews."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(listing).orderBy(*order)
    numbered = reviews.withColumn("cycle", F.coalesce(F.sum(F.col(closed).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1)
    own = Window.partitionBy(listing, "cycle").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    based = numbered.withColumn("baseline", F.first(score).over(own))
    status = F.when(F.col(closed), "approved").when(F.col(n_issues) > 0, "fix_needed").otherwise("reviewed")
    return based.withColumn("delta", F.col(score) - F.col("baseline")).withColumn("status", status)


def late_findings(results: DataFrame, late: DataFrame, key: str) -> DataFrame:
    """results(key, issues array, completeness, score) with the late(key, issues) of a
    slower review appended as advice; completeness becomes full, the score stays."""
    l = late.select(key, F.col("issues").alias("__more"))  # noqa: E741
    j = results.join(l, key, "left")
    issues = F.when(F.col("__more").isNull(), F.col("issues")).otherwise(F.array_union("issues", F.col("__more")))
    return j.withColumn("issues", issues).withColumn("completeness", F.when(F.col("__more").isNotNull(), "full").otherwise(F.col("completeness"))).drop("__more")


def first_error(df: DataFrame, rules: Sequence[tuple[str, Column]], identity: Sequence[str]) -> DataFrame:
    """Adds ``error``: the first rule that a request breaks, else ``duplicate`` where its
    identity stands in several requests, else null."""
    n = df.groupBy(*[F.col(c).alias(f"__{c}") for c in identity]).agg(F.count("*").alias("__n"))
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in identity])
    out = F.when(F.col("__n") > 1, "duplicate")
    for name, broken in reversed(rules):
        out = F.when(F.coalesce(broken, F.lit(False)), name).otherwise(out)
    return df.join(n, on).select(*df.columns, out.alias("error"))


def reusable(captured: Column, mode: Column, days: Column, now: Column) -> Column:
    """Whether a captured benchmark may be used again: an operator's always."""
    return F.coalesce((mode == "operator") | (captured >= F.timestamp_add("DAY", -days, now)), F.lit(False))
