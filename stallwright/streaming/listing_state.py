"""The listing state machine as a stream: commands wait for the watermark, so that those
of a listing are answered in event-time order however their micro-batches are shuffled.

The machine is operators.listing_state once more, for one command at a time; the tests
hold both against each other.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.listing_state import LARGEST_SCORE, LEAST_SCORE, STATE

FIELDS = tuple(f.split()[0] for f in STATE.split(", "))
COMMAND = "at long, id long, kind string, key string, expected long, total double, claim long, external string, drift boolean"
_NAMES = tuple(f.split()[0] for f in COMMAND.split(", "))
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OPEN = ("draft", "enhanced")
_STAGE_AFTER = {"created": "draft", "updated": "enhanced", "claimed": "publish_pending", "finalized": "published", "released": "enhanced", "retired": "retired", "restored": "draft", "recovered": "published"}


def answered(s: dict, c: dict) -> str:
    """The outcome of a command on what is stored of a listing."""
    kind, stage = c["kind"], s["stage"]
    if kind == "draft":
        return "created" if stage is None else "protected" if stage in ("published", "retired") or s["origin"] != "source" else "unchanged"
    if stage is None:
        return "not_found"
    current = c["expected"] is None or c["expected"] == s["revision"]
    own_claim = s["claim"] is not None and c["claim"] in (None, s["claim"])
    elsewhere = s["external"] is not None and c["external"] is not None and s["external"] != c["external"]
    if kind == "edit":
        return "stale" if stage not in _OPEN else "replay" if s["edit_key"] == c["key"] else "updated" if current else "stale"
    if kind == "score":
        return "written" if current and c["total"] is not None and 0 <= c["total"] <= LARGEST_SCORE else "stale"
    if kind == "claim":
        if s["claim"] is not None and s["claim_key"] == c["key"]:
            return "replay"
        if stage not in _OPEN:
            return "not_eligible"
        if not current or s["scored"] != s["revision"]:
            return "stale"
        return "not_eligible" if (s["score"] or 0) < LEAST_SCORE else "stale" if s["claim"] is not None else "claimed"
    if kind == "finalize":
        if s["external"] == c["external"] and stage == "published":
            return "replay"
        return "claim_not_found" if not own_claim else "identity_conflict" if elsewhere else "finalized" if stage == "publish_pending" else "claim_not_found"
    if kind == "release":
        return "claim_not_found" if not own_claim else "released" if stage == "publish_pending" else "not_pending"
    if kind == "retire":
        return "unchanged" if stage == "retired" else "not_published" if stage != "published" else "retired" if current else "stale"
    if kind == "restore":
        return "restored" if stage == "retired" else "not_retired"
    if kind == "observe":
        return "recovered" if stage == "publish_pending" and s["claim"] is not None and c["external"] is not None and not elsewhere else "observed"
    return "unknown"


def stored_after(s: dict, c: dict, outcome: str) -> dict:
    """What is stored after an outcome."""
    n = s | {"stage": _STAGE_AFTER.get(outcome, s["stage"])}
    if outcome == "created":
        n |= {"revision": 1, "origin": "source"}
    elif outcome == "updated":
        n |= {"revision": s["revision"] + 1, "origin": "edited", "score": None, "scored": None, "edit_key": c["key"], "claim": None}
    elif outcome == "written":
        n |= {"score": c["total"], "scored": s["revision"]}
    elif outcome == "claimed":
        n |= {"claim": c["id"], "claim_key": c["key"]}
    elif outcome == "finalized":
        n |= {"claim": None, "claim_key": None, "external": c["external"], "published": s["revision"], "drift": False}
    elif outcome == "released":
        n |= {"claim": None, "claim_key": None}
    elif outcome == "restored":
        n |= {"revision": s["revision"] + 1, "score": None, "scored": None, "claim": None}
    elif outcome in ("observed", "recovered"):
        n |= {"external": c["external"] if c["external"] is not None else s["external"], "drift": bool(c["drift"])}
        if outcome == "recovered":
            n |= {"claim_key": None, "published": s["revision"]}
    return n


class ListingMachine(StatefulProcessor):
    """A listing's stored row as value state, its commands ahead of the watermark as list
    state, and a timer for the earliest of them."""

    def __init__(self, listing: str):
        self.listing = listing

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stored = handle.getValueState("stored", STATE)
        self.held = handle.getListState("held", COMMAND)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [tuple(r[n] for n in _NAMES) for r in rows]
        waiting = list(self.handle.listTimers())
        self.held.appendList(new)
        first = min(c[0] for c in new)
        due = -(-first // 1000)  # a watermark has milliseconds
        if not waiting or due < min(waiting):
            for t in waiting:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(max(due, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted((tuple(c) for c in self.held.get()), key=lambda c: (c[0], c[1]))
        ready = [c for c in held if c[0] <= upto]
        rest = held[len(ready) :]
        if rest:
            self.held.put(rest)
            self.handle.registerTimer(max(-(-rest[0][0] // 1000), timerValues.getCurrentWatermarkInMs() + 1))
        else:
            self.held.clear()
        state = dict(zip(FIELDS, self.stored.get() if self.stored.exists() else (None,) * len(FIELDS), strict=True))
        out = []
        for c in (dict(zip(_NAMES, c, strict=True)) for c in ready):
            outcome = answered(state, c)
            state = stored_after(state, c, outcome)
            out.append(Row(**{self.listing: key[0], "at": c["at"], "id": c["id"], "kind": c["kind"], "outcome": outcome}, **state))
        if ready:
            self.stored.update(tuple(state[f] for f in FIELDS))
        return iter(out)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.stored.update(tuple(initialState[f] for f in FIELDS))

    def close(self) -> None:
        pass


def durable_state(spark: SparkSession) -> None:
    """The state store that lists, maps and timers of a key need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


def stream_commands(commands: DataFrame, listing: str, ts: str, late: str, stored: DataFrame | None = None) -> DataFrame:
    """commands(listing, ts, id, kind, key, expected, total, claim, external, drift) as a
    stream -> for each command, once the watermark (``late`` behind the newest) has passed
    it: listing, at (microseconds), id, kind, outcome, and the listing's row after it.

    ``stored`` (listing and the columns of STATE, as the batch fold gives them) is where
    the first batch starts from. A command later than the watermark is dropped by Spark,
    so ``late`` has to cover the source's disorder. A listing holds the commands of that
    time only. A timestamp without a zone is in the session's. Needs durable_state()."""
    kind = commands.schema[listing].dataType.simpleString()
    timed = commands.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).withColumn("at", F.unix_micros(ts))
    start = None if stored is None else stored.select(listing, *FIELDS).groupBy(listing)
    schema = f"{listing} {kind}, at long, id long, kind string, outcome string, {STATE}"
    return timed.groupBy(listing).transformWithState(ListingMachine(listing), schema, "Append", "EventTime", start)
