"""Streams give what the batch operators give on the same rows."""

from pyspark.sql import functions as F

from stallwright.operators import lifecycle
from stallwright.plans.lifecycle import STEPS
from stallwright.streaming.ingest import gate, ingest_batch, windowed_counts, work_queue
from stallwright.streaming.lifecycle import stream_fold

from .conftest import SMALL


def _slices(spark, tables, tmp_path, n=3):
    events = tables.events.select("user_id", "ts", "event_id", "event_type")
    total = events.count()
    for i in range(n):
        part = events.where((F.col("event_id") * n / total).cast("int") == i)
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    return events, spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def test_stream_fold_equals_batch_fold(spark, tables, tmp_path):
    events, stream = _slices(spark, tables, tmp_path, 1)
    out = stream_fold(stream, "user_id", ["ts", "event_id"], "event_type", "new", STEPS)
    q = out.writeStream.outputMode("update").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r.user_id: (r.state, r.applied, r.refused) for r in spark.table("folded").collect()}
    want = {r.user_id: (r.state, r.applied, r.refused) for r in lifecycle.fold(events, "user_id", ["ts", "event_id"], "event_type", "new", STEPS).collect()}
    assert got == want


def test_ingest_is_idempotent(spark, tmp_path):
    store, logs = str(tmp_path / "store"), str(tmp_path / "log")
    schema = "k long, h string"
    spark.createDataFrame([], schema).write.parquet(store)
    run = ingest_batch(lambda: spark.read.schema(schema).parquet(store), lambda df: df.write.mode("append").parquet(store), lambda df: df.write.mode("append").parquet(logs), ["k"], "h")
    batch = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], schema)
    run(batch, 0)
    run(batch, 1)  # the same batch again
    assert spark.read.parquet(store).count() == 2
    assert sorted((r.k, r.outcome) for r in spark.read.parquet(logs).where("batch_id = 1").collect()) == [(1, "unchanged"), (2, "unchanged")]


def test_gate_rejects_whole_batches(spark):
    df = spark.createDataFrame([(1, 5, 10), (1, 11, 10), (2, 1, 10)], "b int, ts int, e int")
    assert sorted(tuple(r) for r in gate(df, "b", "ts", "e").collect()) == [(1, 2, 1, "rejected"), (2, 1, 0, "accepted")]


def test_windowed_counts_in_batch(spark, tables):
    got = windowed_counts(tables.events, "ts", ["event_type"]).agg(F.sum("n_events").alias("n")).first().n
    assert got == tables.events.count()


def test_work_queue_settles_each_request_once(spark, tmp_path):
    settled, ticks = str(tmp_path / "settled"), str(tmp_path / "ticks")
    schema = "id long, status string, priority int"
    spark.createDataFrame([], schema).write.parquet(settled)
    first = spark.createDataFrame([(i, "queued", i % 3) for i in range(7)] + [(8, "failed", 9)], schema)
    for i in range(3):
        spark.range(i, i + 1).coalesce(1).write.mode("append").parquet(ticks)
    requests = lambda: first.join(spark.read.schema(schema).parquet(settled), "id", "left_anti")
    work = lambda q: q.where("id <> 5").select("id", F.when(F.col("id") == 2, "failed").otherwise("succeeded").alias("status"))
    run = work_queue(requests, work, lambda df: df.write.mode("append").parquet(settled), 3)
    q = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(ticks).writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted((r.id, r.status) for r in spark.read.parquet(settled).collect())
    assert got == [(0, "succeeded"), (1, "succeeded"), (2, "failed"), (3, "succeeded"), (4, "succeeded"), (5, "failed"), (6, "succeeded")]
