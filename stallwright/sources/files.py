"""Delimited and JSON exports, landing of raw rows, unpivoting of wide slots."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def column_name(name: str) -> str:
    """Lower case; white space and round brackets become single underscores; one at
    either end goes."""
    name = re.sub("_+", "_", re.sub(r"[\s()（）]+", "_", name.lstrip("﻿").strip().lower()))
    return re.sub("^_|_$", "", name)


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """Tab if the header has more tabs than commas, else a comma."""
    first = spark.read.text(path).limit(1).collect()
    head = first[0].value if first else ""
    return "\t" if head.count("\t") > head.count(",") else ","


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, trim: bool = True) -> DataFrame:
    """All cells as strings, trimmed unless told otherwise, missing ones ''; quoted cells may hold delimiters,
    doubled quotes and line ends; of equal headers the last counts; blank rows go."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', sep=delimiter or sniff_delimiter(spark, path), inferSchema=False)
    raw = raw.toDF(*[f"c{i}" for i in range(len(raw.columns))]) if raw.columns else raw
    header = spark.read.csv(path, header=False, multiLine=True, quote='"', escape='"', sep=delimiter or sniff_delimiter(spark, path)).limit(1).collect()
    names = [column_name(x or "") for x in header[0]] if header else []
    last = {name: i for i, name in enumerate(names)}
    cell = F.trim if trim else lambda c: c
    df = raw.select(*[cell(F.coalesce(f"c{i}", F.lit(""))).alias(name) for name, i in last.items()])
    return df.where(F.concat_ws("", *[F.col(f"`{c}`") for c in df.columns]) != "")


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a JSON array in a file; anything else in the file is an error."""
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    checked = whole.select(F.when(F.col("value").startswith("["), F.col("value")).otherwise(F.raise_error(F.lit("not a JSON array"))).alias("value"))
    return checked.select(F.explode(F.from_json("value", f"array<struct<{schema}>>")).alias("r")).select("r.*")


def reject_rows(df: DataFrame, required: Sequence[str], numeric: Sequence[str] = (), whole: Sequence[str] = ()) -> DataFrame:
    """Adds ``errors``: what is missing or malformed in a row, joined; '' for a good one."""
    c = lambda x: F.col(f"`{x}`").cast("string")
    tests = [F.when(F.coalesce(F.trim(c(x)), F.lit("")) == "", F.lit(f"missing {x}")) for x in required]
    tests += [F.when(c(x).isNotNull() & (c(x).try_cast("double").isNull() | (c(x).try_cast("double") < 0)), F.lit(f"bad number {x}")) for x in numeric]
    tests += [F.when(c(x).isNotNull() & ~c(x).rlike("^[0-9]+$"), F.lit(f"bad integer {x}")) for x in whole]
    return df.withColumn("errors", F.array_join(F.array_compact(F.array(*tests)), "; "))


def _shared(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a temporary one
    where the session has none and runs on this machine alone."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-landed-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one; it goes when the session's JVM ends."""
    at = f"{_shared(spark)}/{label}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def land_raw(df: DataFrame, run_id: str, order: Sequence[str], source_key: str | None = None) -> DataFrame:
    """Raw rows of a run: (run_id, row_index, source_key, row_hash, raw, status). The
    index counts rows by ``order`` (make it total) from 1 without gaps, by a range sort
    and not in one task. The sorted rows are checkpointed with their places before they
    are counted: a second evaluation would draw other range bounds."""
    spark = df.sparkSession
    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    key = F.col(source_key).cast("string") if source_key else F.lit(None).cast("string")
    ordered = df.select(*order, key.alias("source_key"), body.alias("raw")).repartitionByRange(*order).sortWithinPartitions(*order)
    part = F.spark_partition_id()
    placed = ordered.select("source_key", "raw", part.alias("part"), (F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)).alias("at"))
    _shared(spark)
    placed = placed.checkpoint()
    # One row for each partition.
    before = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = before.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    out = placed.join(F.broadcast(before), "part")
    return out.select(F.lit(run_id).alias("run_id"), (F.col("before") + F.col("at") + 1).alias("row_index"), "source_key", F.substring(F.sha2("raw", 256), 1, 16).alias("row_hash"), "raw", F.lit("pending").alias("status"))


def unpivot_slots(df: DataFrame, keys: Sequence[str], slots: Sequence[tuple[int, str, str]]) -> DataFrame:
    """(slot, field, column) -> rows (keys, slot, field, value); blank values are skipped."""
    cells = F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(f).alias("field"), F.col(f"`{c}`").cast("string").alias("value")) for i, f, c in slots])
    return df.select(*keys, F.explode(cells).alias("s")).select(*keys, "s.*").where("value is not null and trim(value) <> ''")


def json_line(*cs: Column) -> Column:
    """A row's fields as one JSON object, nulls kept."""
    return F.to_json(F.struct(*cs), {"ignoreNullFields": "false"})


def write_report(df: DataFrame, folder: str, summary: DataFrame | None = None) -> None:
    """A report as JSON lines, a file for each partition, and its one-row summary (a
    single small file) beside them. Replaces an earlier report in the folder."""
    df.write.mode("overwrite").json(f"{folder}/rows", ignoreNullFields=False)
    if summary is not None:
        summary.limit(1).coalesce(1).write.mode("overwrite").json(f"{folder}/summary", ignoreNullFields=False)
