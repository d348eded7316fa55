"""Micro-batch ingestion: window gates, idempotent rows, queue claims."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import merges


def gate(df: DataFrame, batch: str, ts: str, window_end: str) -> DataFrame:
    """(batch, n_rows, n_leaking, verdict): a batch with a row after its declared end is
    rejected as a whole; nothing is dropped silently."""
    leaking = F.count_if(F.col(ts) > F.col(window_end))
    verdict = F.when(leaking > 0, "rejected").otherwise("accepted")
    return df.groupBy(batch).agg(F.count("*").alias("n_rows"), leaking.alias("n_leaking"), verdict.alias("verdict"))


def ingest_batch(read_stored: Callable[[], DataFrame], write: Callable[[DataFrame], None], log: Callable[[DataFrame], None], keys: list[str], row_hash: str):
    """A function for foreachBatch: each row is created, updated or unchanged against
    what is stored; changed rows are written before the log says so, so that a batch
    that is run again finds its rows stored and logs them unchanged."""

    def run(batch: DataFrame, batch_id: int) -> None:
        newest = batch.dropDuplicates([*keys, row_hash])
        outcomes = merges.upsert_outcomes(read_stored(), newest, keys, row_hash).withColumn("batch_id", F.lit(batch_id))
        outcomes = outcomes.persist()
        write(outcomes.where("outcome <> 'unchanged'").drop("outcome", "batch_id"))
        log(outcomes.select(*keys, "outcome", "batch_id"))
        outcomes.unpersist()

    return run


def windowed_counts(events: DataFrame, ts: str, by: list[str], late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Beyond the catalog operators: counts in tumbling windows with a watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), *by).agg(F.count("*").alias("n_events")).select(F.col("w.start").alias("window_start"), *by, "n_events")


def work_queue(requests: Callable[[], DataFrame], work: Callable[[DataFrame], DataFrame], store: Callable[[DataFrame], None], most: int):
    """A function for foreachBatch over a ticking stream: each batch takes the ``most``
    queued requests(id, status, priority) of the highest priority, oldest ids first, and
    stores what ``work`` makes of them (id, status succeeded or failed). There is one
    writer, so no two batches claim a request; a batch that is run again finds its
    requests settled and takes the next. Requests without an answer are failed."""

    def run(tick: DataFrame, batch_id: int) -> None:
        queued = requests().where("status = 'queued'").orderBy(F.desc("priority"), "id").limit(most).select("id", "priority")
        answers = work(queued).select("id", F.when(F.col("status").isin("succeeded", "failed"), F.col("status")).alias("answer"))
        store(queued.join(answers, "id", "left").select("id", F.coalesce("answer", F.lit("failed")).alias("status"), "priority"))

    return run
