"""The lifecycle fold as a stateful stream; the same results as operators.lifecycle.fold
where a key's events arrive in order."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import DataFrame

STATE = "state string, applied long, refused long"


def stream_fold(events: DataFrame, key: str, order: Sequence[str], wanted: str, start: str, table: Mapping[str, Sequence[str]]) -> DataFrame:
    """Emits a key's state after each micro-batch that has events of it. State is one
    short row for each key; a batch's events of a key are applied in order."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = events.schema[key].dataType.simpleString()
    moves = {k: set(v) for k, v in table.items()}

    def run(k: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        current, applied, refused = state.get if state.exists else (start, 0, 0)
        for want in pd.concat(list(batches)).sort_values(list(order))[wanted]:
            if want in moves.get(current, ()):
                current, applied = want, applied + 1
            else:
                refused += 1
        state.update((current, applied, refused))
        yield pd.DataFrame({key: [k[0]], "state": [current], "applied": [applied], "refused": [refused]})

    return events.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)
