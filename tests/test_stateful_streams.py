"""Stateful streams over shuffled micro-batches give what their batch twins give."""

import itertools
import os
import shutil

import pytest
from pyspark.sql import functions as F

from stallwright.operators import late, listing_state
from stallwright.plans import listing_lifecycle, streams
from stallwright.streaming import listing_state as machine
from stallwright.streaming import snapshots

FAR = "2030-01-01"


@pytest.fixture(autouse=True)
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    machine.durable_state(spark)
    yield
    spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def put(parts, folder):
    """The single files of the parts, in their order by time."""
    for i, part in enumerate(parts):
        for f in part.glob("*.parquet"):
            shutil.copy(f, folder / f"{i}.parquet")
            os.utime(folder / f"{i}.parquet", (1_700_000_000 + 60 * i,) * 2)


def in_batches(spark, df, tmp_path, label, order, n=3, last=None):
    """A stream that reads df in n files, rows dealt by a hash of ``order``; then ``last``."""
    folder = tmp_path / label
    df = df.cache()
    for i in range(n):
        df.where(F.pmod(F.xxhash64(*order), F.lit(n)) == i).coalesce(1).write.parquet(str(folder / f"{i}"))
    if last is not None:
        last.coalesce(1).write.parquet(str(folder / f"{n}"))
    parts = sorted(folder.iterdir())
    flat = tmp_path / f"{label}-in"
    flat.mkdir()
    put(parts, flat)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(flat))


def collected(spark, stream, tmp_path, name):
    q = stream.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"ck-{name}")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def test_machine_agrees_with_the_fold_on_every_pair_of_state_and_command(spark):
    stages = [None, "draft", "enhanced", "publish_pending", "published", "retired"]
    states = [
        (s, None if s is None else 3, o, sc, scored, "k1", claim, "k1" if claim else None, ext, None, False)
        for s, o, sc, scored, claim, ext in itertools.product(stages, ["source", "edited"], [None, 80.0], [3, 2], [None, 7], [None, "x"])
    ]
    kinds = ["draft", "edit", "score", "claim", "finalize", "release", "retire", "restore", "observe", "other"]
    commands = [(0, 9, kind, key, expected, total, claim, ext, True) for kind, key, expected, total, claim, ext in itertools.product(kinds, ["k1", "k2"], [None, 2], [50.0, 99.0], [None, 8], [None, "x", "y"])]
    pairs = [(s, c) for s in states for c in commands]
    df = spark.createDataFrame(pairs, f"s struct<{listing_state.STATE.replace(' ', ':').replace(',:', ',')}>, c struct<{machine.COMMAND.replace(' ', ':').replace(',:', ',')}>")
    outcome = listing_state.answer(F.col("s"), F.col("c"))
    rows = df.select("s", "c", outcome.alias("o")).select("s", "c", "o", listing_state.after(F.col("s"), F.col("c"), F.col("o")).alias("n")).collect()
    assert len(rows) == len(pairs)
    for r in rows:
        s, c = r.s.asDict(), r.c.asDict()
        assert machine.answered(s, c) == r.o, (s, c)
        assert machine.stored_after(s, c, r.o) == r.n.asDict(), (s, c, r.o)


def _sentinel(df, **values):
    row = df.limit(1)
    for name in df.columns:
        if name in values:
            row = row.withColumn(name, F.lit(values[name]).cast(df.schema[name].dataType))
    return row


@pytest.mark.parametrize("from_stored", [False, True])
def test_listing_states_and_outcomes_over_shuffled_batches(spark, tables, tmp_path, from_stored):
    commands = listing_lifecycle._commands(tables).withColumn("total", F.col("total").cast("double"))
    middle = commands.agg(F.percentile_approx("id", 0.4)).first()[0]  # ids ascend with time
    before, after = commands.where(F.col("id") < middle), commands.where(F.col("id") >= middle)
    stored = listing_state.fold_commands(before, "listing", ["ts", "id"]) if from_stored else None
    rows = after if from_stored else commands
    stream = in_batches(spark, rows, tmp_path, "commands", ["id"], last=_sentinel(rows, listing=-1, ts=FAR))
    got = collected(spark, machine.stream_commands(stream, "listing", "ts", "60 days", stored), tmp_path, f"machine_{from_stored}").where("listing >= 0")
    folded = listing_state.fold_commands(commands, "listing", ["ts", "id"])
    wanted = folded.select("listing", F.inline("outcomes"))
    if from_stored:
        wanted = wanted.join(rows.select("id"), "id")
    assert sorted((r.id, r.outcome) for r in got.collect()) == sorted((r.id, r.outcome) for r in wanted.collect())
    fields = machine.FIELDS
    last = got.groupBy("listing").agg(F.max_by(F.struct(*fields), F.struct("at", "id")).alias("s")).select("listing", "s.*")
    states = folded.join(rows.select("listing").distinct(), "listing").select("listing", *fields)
    assert sorted(map(str, last.collect())) == sorted(map(str, states.collect()))


def test_late_findings_as_a_join_of_streams(spark, tables, tmp_path):
    results, findings = streams.review_results(tables.events), streams.review_findings(tables.events)
    left = in_batches(spark, results, tmp_path, "results", ["result_id"], last=_sentinel(results, result_id=-1, request_id=-5, ts=FAR)).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "60 days")
    right = in_batches(spark, findings, tmp_path, "findings", ["found_at"], last=_sentinel(findings, finding_request=-9, found_at=FAR, status="completed")).withColumn("found_at", F.col("found_at").cast("timestamp")).withWatermark("found_at", "60 days")
    got = collected(spark, streams.flat(late.enriched(left, right, streams.BOUND)), tmp_path, "late").where("result_id >= 0")
    wanted = streams.late_findings_enriched(tables)
    assert sorted(map(str, got.select(wanted.columns).collect())) == sorted(map(str, wanted.collect()))
    assert {r.applied for r in wanted.select("applied").collect()} == {True, False}


def test_snapshots_a_b_a(spark, tmp_path):
    schema = "listing string, ts timestamp, id long, hash string"
    rows = [("l", "2024-01-01", 1, "A"), ("l", "2024-01-02", 2, "B"), ("l", "2024-01-03", 3, "A"), ("m", "2024-01-01", 4, "A"), ("m", "2024-01-02", 5, "A"), ("s", "2024-01-02", 6, "X"), ("s", "2024-01-03", 7, "Y")]
    df = spark.createDataFrame(rows, "listing string, ts string, id long, hash string").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = tmp_path / "in"
    folder.mkdir()
    for i, day in enumerate(("2024-01-01", "2024-01-02", "2024-01-03")):
        df.where(F.col("ts") == day).coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
    put([tmp_path / f"p{i}" for i in range(3)], folder)
    stored = spark.createDataFrame([("s", "X", 0, False), ("s", "W", -1, True)], "listing string, hash string, snapshot long, is_current boolean")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    got = collected(spark, snapshots.stream_history(stream, "listing", "ts", stored), tmp_path, "snapshots")
    rows = sorted((r.listing, r["at"], r.hash, r.snapshot, r.is_new, r.replaced) for r in got.collect())
    assert [(a, *b) for a, _, *b in rows] == [("l", "A", 1, True, None), ("l", "B", 2, True, 1), ("l", "A", 1, False, 2), ("m", "A", 4, True, None), ("s", "X", 0, False, -1), ("s", "Y", 7, True, 0)]


def test_snapshot_history_equals_its_batch_twin(spark, tables, tmp_path):
    captures = streams.captures(tables.events)
    parts = captures.select("id").agg(F.max("id")).first()[0] // 3 + 1
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):  # a listing's captures arrive in their order
        captures.where(F.floor(F.col("id") / parts) == i).coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
    put([tmp_path / f"p{i}" for i in range(3)], folder)
    stream = spark.readStream.schema(captures.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    got = collected(spark, snapshots.stream_history(stream, "listing", "ts"), tmp_path, "history")
    wanted = streams.snapshot_history(tables).select("listing", F.unix_micros(F.col("valid_from").cast("timestamp")).alias("at"), "hash", "snapshot", "is_new", "replaced")
    assert sorted(map(str, got.select(wanted.columns).collect())) == sorted(map(str, wanted.collect()))
