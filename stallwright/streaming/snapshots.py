"""Snapshot history as a stream: contents seen before make no new snapshot."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "at long, hash string, snapshot long, is_new boolean, replaced long"


class History(StatefulProcessor):
    """All hashes of a listing with their snapshots, and the snapshot that holds now."""

    def __init__(self, listing: str):
        self.listing = listing

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "hash string", "snapshot long")
        self.now = handle.getValueState("now", "hash string, snapshot long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        current = self.now.get() if self.now.exists() else (None, None)
        for r in sorted(rows, key=lambda r: (r["at"], r["id"])):
            if r["hash"] == current[0]:
                continue
            seen = self.known.getValue((r["hash"],)) if self.known.containsKey((r["hash"],)) else None
            snapshot = seen[0] if seen else r["id"]
            if not seen:
                self.known.updateValue((r["hash"],), (snapshot,))
            yield Row(**{self.listing: key[0], "at": r["at"], "hash": r["hash"], "snapshot": snapshot, "is_new": not seen, "replaced": current[1]})
            current = (r["hash"], snapshot)
        self.now.update(current)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.known.updateValue((initialState["hash"],), (initialState["snapshot"],))
        if initialState["is_current"]:
            self.now.update((initialState["hash"], initialState["snapshot"]))

    def close(self) -> None:
        pass


def stream_history(captures: DataFrame, listing: str, ts: str, stored: DataFrame | None = None) -> DataFrame:
    """captures(listing, ts, id, hash) as a stream, a listing's in their order -> a row each
    time its content changes: at (microseconds), hash, snapshot (the id of the capture that
    had the content first), is_new (false: it's back at a known snapshot) and the snapshot
    replaced. A hash is never null.

    ``stored`` (listing, hash, snapshot, is_current), a row for each stored snapshot, is
    known from the start. Needs the state store of listing_state.durable_state()."""
    kind = captures.schema[listing].dataType.simpleString()
    timed = captures.withColumn("at", F.unix_micros(F.col(ts).cast("timestamp")))
    start = None if stored is None else stored.select(listing, "hash", "snapshot", "is_current").groupBy(listing)
    return timed.groupBy(listing).transformWithState(History(listing), f"{listing} {kind}, {OUT}", "Append", "None", start)
