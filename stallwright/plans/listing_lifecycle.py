"""Commands on listings (drafts, edits, scores, claims, publication) from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import listing_state
from ..sources.tables import Tables
from .registry import query

#: An event as a command: its type and number choose what is asked for.
_COMMANDS = """SELECT user_id AS listing, ts, event_id AS id,
  CASE event_type WHEN 'signup' THEN CASE WHEN event_id % 6 = 0 THEN 'observe' ELSE 'draft' END WHEN 'view' THEN 'edit' WHEN 'click' THEN 'score' WHEN 'purchase' THEN 'claim'
    ELSE CASE event_id % 4 WHEN 0 THEN 'finalize' WHEN 1 THEN 'release' WHEN 2 THEN 'retire' ELSE 'restore' END END AS kind,
  'k' || CAST(event_id % 5 AS VARCHAR) AS key, CASE WHEN event_id % 8 = 0 THEN 1 END AS expected, CASE WHEN value > 100 THEN 80 ELSE floor(value) END AS total,
  CASE WHEN event_id % 9 = 0 THEN -1 END AS claim, CASE WHEN event_id % 11 <> 0 THEN 'x' || CAST(user_id % 3 AS VARCHAR) ELSE 'other' END AS external, event_id % 2 = 0 AS drift FROM events"""


def _commands(t: Tables) -> DataFrame:
    i, kind = F.col("event_id"), F.col("event_type")
    error = F.when(i % 4 == 0, "finalize").when(i % 4 == 1, "release").when(i % 4 == 2, "retire").otherwise("restore")
    what = F.when(kind == "signup", F.when(i % 6 == 0, "observe").otherwise("draft")).when(kind == "view", "edit").when(kind == "click", "score").when(kind == "purchase", "claim").otherwise(error)
    return t.events.select(
        F.col("user_id").alias("listing"),
        "ts",
        i.alias("id"),
        what.alias("kind"),
        F.concat(F.lit("k"), (i % 5).cast("string")).alias("key"),
        F.when(i % 8 == 0, F.lit(1).cast("long")).alias("expected"),
        F.when(F.col("value") > 100, 80.0).otherwise(F.floor("value").cast("double")).alias("total"),
        F.when(i % 9 == 0, F.lit(-1).cast("long")).alias("claim"),
        F.when(i % 11 != 0, F.concat(F.lit("x"), (F.col("user_id") % 3).cast("string"))).otherwise("other").alias("external"),
        (i % 2 == 0).alias("drift"),
    )


#: The state machine by recursion over a listing's numbered commands: first the outcome
#: of each, then the stored row it leaves.
_MACHINE = f"""WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY listing ORDER BY ts, id) AS n FROM ({_COMMANDS}) q),
m AS (
  SELECT listing, 0::BIGINT AS n, NULL::VARCHAR AS stage, NULL::BIGINT AS revision, NULL::VARCHAR AS origin, NULL::DOUBLE AS score, NULL::BIGINT AS scored, NULL::VARCHAR AS edit_key,
    NULL::BIGINT AS claim, NULL::VARCHAR AS claim_key, NULL::VARCHAR AS external, NULL::BIGINT AS published, NULL::BOOLEAN AS drift, NULL::BIGINT AS id, NULL::VARCHAR AS outcome FROM (SELECT DISTINCT listing FROM c)
  UNION ALL
  SELECT listing, cn,
    CASE o WHEN 'created' THEN 'draft' WHEN 'restored' THEN 'draft' WHEN 'updated' THEN 'enhanced' WHEN 'released' THEN 'enhanced' WHEN 'claimed' THEN 'publish_pending' WHEN 'finalized' THEN 'published' WHEN 'recovered' THEN 'published' WHEN 'retired' THEN 'retired' ELSE stage END,
    CASE WHEN o = 'created' THEN 1 WHEN o IN ('updated', 'restored') THEN revision + 1 ELSE revision END,
    CASE o WHEN 'created' THEN 'source' WHEN 'updated' THEN 'edited' ELSE origin END,
    CASE WHEN o IN ('updated', 'restored') THEN NULL WHEN o = 'written' THEN total ELSE score END,
    CASE WHEN o IN ('updated', 'restored') THEN NULL WHEN o = 'written' THEN revision ELSE scored END,
    CASE WHEN o = 'updated' THEN ckey ELSE edit_key END,
    CASE WHEN o IN ('updated', 'restored', 'finalized', 'released') THEN NULL WHEN o = 'claimed' THEN cid ELSE claim END,
    CASE WHEN o IN ('finalized', 'released', 'recovered') THEN NULL WHEN o = 'claimed' THEN ckey ELSE claim_key END,
    CASE WHEN o = 'finalized' THEN cexternal WHEN o IN ('observed', 'recovered') THEN coalesce(cexternal, external) ELSE external END,
    CASE WHEN o IN ('finalized', 'recovered') THEN revision ELSE published END,
    CASE WHEN o = 'finalized' THEN false WHEN o IN ('observed', 'recovered') THEN cdrift ELSE drift END, cid, o
  FROM (SELECT m.* EXCLUDE (id, outcome), c.n AS cn, c.id AS cid, c.key AS ckey, c.total, c.external AS cexternal, c.drift AS cdrift,
    CASE WHEN c.kind = 'draft' THEN CASE WHEN stage IS NULL THEN 'created' WHEN stage = 'published' OR stage = 'retired' OR origin = 'edited' THEN 'protected' ELSE 'unchanged' END
      WHEN stage IS NULL THEN 'not_found'
      WHEN c.kind = 'edit' THEN CASE WHEN stage NOT IN ('draft', 'enhanced') THEN 'stale' WHEN edit_key = c.key THEN 'replay' WHEN c.expected <> revision THEN 'stale' ELSE 'updated' END
      WHEN c.kind = 'score' THEN CASE WHEN c.expected <> revision OR c.total < 0 OR c.total > 94 THEN 'stale' ELSE 'written' END
      WHEN c.kind = 'claim' THEN CASE WHEN m.claim IS NOT NULL AND claim_key = c.key THEN 'replay' WHEN stage NOT IN ('draft', 'enhanced') THEN 'not_eligible' WHEN c.expected <> revision OR scored IS NULL OR scored <> revision THEN 'stale'
        WHEN score IS NULL OR score < 75 THEN 'not_eligible' WHEN m.claim IS NOT NULL THEN 'stale' ELSE 'claimed' END
      WHEN c.kind = 'finalize' THEN CASE WHEN m.external = c.external AND stage = 'published' THEN 'replay' WHEN m.claim IS NULL OR c.claim <> m.claim THEN 'claim_not_found' WHEN m.external <> c.external THEN 'identity_conflict' WHEN stage <> 'publish_pending' THEN 'claim_not_found' ELSE 'finalized' END
      WHEN c.kind = 'release' THEN CASE WHEN m.claim IS NULL OR c.claim <> m.claim THEN 'claim_not_found' WHEN stage <> 'publish_pending' THEN 'not_pending' ELSE 'released' END
      WHEN c.kind = 'retire' THEN CASE WHEN stage = 'retired' THEN 'unchanged' WHEN stage <> 'published' THEN 'not_published' WHEN c.expected <> revision THEN 'stale' ELSE 'retired' END
      WHEN c.kind = 'restore' THEN CASE WHEN stage <> 'retired' THEN 'not_retired' ELSE 'restored' END
      ELSE CASE WHEN stage = 'publish_pending' AND m.claim IS NOT NULL AND (m.external IS NULL OR m.external = c.external) THEN 'recovered' ELSE 'observed' END END AS o
    FROM m JOIN c ON c.listing = m.listing AND c.n = m.n + 1) q)"""


def _folded(t: Tables) -> DataFrame:
    return listing_state.fold_commands(_commands(t), "listing", ["ts", "id"])


def _outcomes(t: Tables, *kinds: str) -> DataFrame:
    asked = _commands(t).select("id", "kind").where(F.col("kind").isin(*kinds))
    return asked.join(_folded(t).select("listing", F.inline("outcomes")), "id").select("listing", "id", "kind", "outcome")


def _outcome_sql(*kinds: str) -> str:
    return f"{_MACHINE} SELECT m.listing, m.id, c.kind, m.outcome FROM m JOIN c ON c.id = m.id WHERE c.kind IN ({', '.join(repr(k) for k in kinds)})"


@query(f"""{_MACHINE} SELECT listing, stage, revision, origin, score, scored, edit_key, claim, claim_key, external, published, drift FROM (SELECT *, row_number() OVER (PARTITION BY listing ORDER BY n DESC) AS r FROM m) WHERE r = 1""")
def listing_states(t: Tables) -> DataFrame:
    """What is stored of each listing after all commands."""
    return _folded(t).drop("outcomes")


@query(_outcome_sql("draft", "edit"))
def draft_and_edit_outcomes(t: Tables) -> DataFrame:
    """Drafts are created, unchanged or protected; edits replay, are stale or apply."""
    return _outcomes(t, "draft", "edit")


@query(_outcome_sql("score"))
def score_write_outcomes(t: Tables) -> DataFrame:
    return _outcomes(t, "score")


@query(_outcome_sql("claim"))
def claim_outcomes(t: Tables) -> DataFrame:
    """Claims against stored revision, score and claim."""
    return _outcomes(t, "claim")


@query(_outcome_sql("finalize", "release", "retire", "restore"))
def publication_outcomes(t: Tables) -> DataFrame:
    return _outcomes(t, "finalize", "release", "retire", "restore")


@query(_outcome_sql("observe"))
def observation_outcomes(t: Tables) -> DataFrame:
    """Observations, with the recovery of a publication under a live claim."""
    return _outcomes(t, "observe")
