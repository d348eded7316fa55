"""The listing lifecycle as a fold of commands over a listing's stored state.

A command is refused or applied by what is stored when it arrives (revision, stage,
score, claim), so a listing's commands are folded in their order; listings are
independent of each other. A listing has a bounded number of commands.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least score for publishing, and the largest that may be written (fixed values).
LEAST_SCORE, LARGEST_SCORE = 75, 94
STATE = "stage string, revision long, origin string, score double, scored long, edit_key string, claim long, claim_key string, external string, published long, drift boolean"
#: Outcomes that change what is stored; all others leave it as it is.
CHANGES = ("created", "updated", "written", "claimed", "finalized", "released", "retired", "restored", "recovered", "observed")


def answer(s: Column, c: Column) -> Column:
    """The outcome of command c (kind, key, expected, total, claim, external, drift) on
    state s. A null ``expected`` or ``claim`` stands for the stored one."""
    open_ = s.stage.isin("draft", "enhanced")
    current = F.coalesce(c.expected, s.revision) == s.revision
    own_claim = s.claim.isNotNull() & (F.coalesce(c.claim, s.claim) == s.claim)
    pending = s.stage == "publish_pending"
    known_elsewhere = s.external.isNotNull() & (s.external != c.external)
    draft = F.when(s.stage.isNull(), "created").when(s.stage.isin("published", "retired") | (s.origin != "source"), "protected").otherwise("unchanged")
    edit = F.when(~open_, "stale").when(s.edit_key.eqNullSafe(c.key), "replay").when(~current, "stale").otherwise("updated")
    score = F.when(~current | c.total.isNull() | ~c.total.between(0, LARGEST_SCORE), "stale").otherwise("written")
    claim = (
        F.when(s.claim.isNotNull() & s.claim_key.eqNullSafe(c.key), "replay")
        .when(~open_, "not_eligible")
        .when(~current | ~s.scored.eqNullSafe(s.revision), "stale")
        .when(F.coalesce(s.score, F.lit(0.0)) < LEAST_SCORE, "not_eligible")
        .when(s.claim.isNotNull(), "stale")
        .otherwise("claimed")
    )
    finalize = (
        F.when(s.external.eqNullSafe(c.external) & (s.stage == "published"), "replay")
        .when(~own_claim, "claim_not_found")
        .when(known_elsewhere, "identity_conflict")
        .when(~pending, "claim_not_found")
        .otherwise("finalized")
    )
    release = F.when(~own_claim, "claim_not_found").when(~pending, "not_pending").otherwise("released")
    retire = F.when(s.stage == "retired", "unchanged").when(s.stage != "published", "not_published").when(~current, "stale").otherwise("retired")
    restore = F.when(s.stage != "retired", "not_retired").otherwise("restored")
    recovery = pending & s.claim.isNotNull() & c.external.isNotNull() & ~known_elsewhere
    observe = F.when(recovery, "recovered").otherwise("observed")
    out = F.when(c.kind == "draft", draft).when(s.stage.isNull(), "not_found")
    for kind, found in {"edit": edit, "score": score, "claim": claim, "finalize": finalize, "release": release, "retire": retire, "restore": restore, "observe": observe}.items():
        out = out.when(c.kind == kind, found)
    return out.otherwise("unknown")


def after(s: Column, c: Column, outcome: Column) -> Column:
    """What is stored after an outcome."""
    was = lambda *names: outcome.isin(*names)
    none = lambda kind: F.lit(None).cast(kind)
    rescored = was("updated", "restored")
    unclaimed = was("updated", "finalized", "released", "restored")
    stage = {"created": "draft", "updated": "enhanced", "claimed": "publish_pending", "finalized": "published", "released": "enhanced", "retired": "retired", "restored": "draft", "recovered": "published"}
    new_stage = s.stage
    for name, x in stage.items():
        new_stage = F.when(outcome == name, x).otherwise(new_stage)
    seen = was("observed", "recovered")
    return F.struct(
        new_stage.alias("stage"),
        F.when(outcome == "created", F.lit(1).cast("long")).when(rescored, s.revision + 1).otherwise(s.revision).alias("revision"),
        F.when(outcome == "created", "source").when(outcome == "updated", "edited").otherwise(s.origin).alias("origin"),
        F.when(rescored, none("double")).when(outcome == "written", c.total).otherwise(s.score).alias("score"),
        F.when(rescored, none("long")).when(outcome == "written", s.revision).otherwise(s.scored).alias("scored"),
        F.when(outcome == "updated", c.key).otherwise(s.edit_key).alias("edit_key"),
        F.when(unclaimed, none("long")).when(outcome == "claimed", c.id).otherwise(s.claim).alias("claim"),
        F.when(was("finalized", "released", "recovered"), none("string")).when(outcome == "claimed", c.key).otherwise(s.claim_key).alias("claim_key"),
        F.when(outcome == "finalized", c.external).when(seen, F.coalesce(c.external, s.external)).otherwise(s.external).alias("external"),
        F.when(was("finalized", "recovered"), s.revision).otherwise(s.published).alias("published"),
        F.when(outcome == "finalized", F.lit(False)).when(seen, F.coalesce(c.drift, F.lit(False))).otherwise(s.drift).alias("drift"),
    )


def fold_commands(commands: DataFrame, listing: str, order: Sequence[str]) -> DataFrame:
    """commands(listing, order ..., id, kind, key, expected, total, claim, external,
    drift) -> per listing its state and ``outcomes``, an array of (id, outcome) in order."""
    fields = ["id", "kind", "key", "expected", "total", "claim", "external", "drift"]
    seq = F.array_sort(F.collect_list(F.struct(*order, F.struct(*fields).alias("c"))))
    zero = F.struct(F.from_json(F.lit("{}"), STATE).alias("s"), F.array().cast("array<struct<id:long,outcome:string>>").alias("outcomes"))

    def step(acc: Column, e: Column) -> Column:
        bound = F.transform(F.array(answer(acc.s, e.c)), lambda o: F.struct(after(acc.s, e.c, o).alias("s"), F.concat(acc.outcomes, F.array(F.struct(e.c.id.alias("id"), o.alias("outcome")))).alias("outcomes")))
        return F.element_at(bound, 1)

    return commands.groupBy(listing).agg(F.aggregate(seq, zero, step).alias("f")).select(listing, "f.s.*", "f.outcomes")
