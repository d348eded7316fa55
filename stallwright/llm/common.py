"""Shared helpers of the training-data operators: durable intermediates, word
splitting, and file access from tasks."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six ASCII white-space characters;
#: bytes.split() without arguments splits on exactly this set.
SPACES = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``; a temporary one is set
    only where the session has none and runs on this machine alone (tests). On a
    cluster without the setting this is an error: executors share no local folder."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path of any store."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


#: Tables written inside each open scratch(), innermost last.
_scratches: list[list[tuple[SparkSession, str]]] = []


def written(df: DataFrame, label: str, path: str | None = None, outer: bool = False) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: cuts the
    lineage, and a lost executor costs no recomputation. An intermediate goes with the
    scratch() it is written in (``outer``: with the one around that), or when the
    session's JVM ends; one with a ``path`` stays."""
    spark = df.sparkSession
    at = path or fresh_path(spark, label)
    df.write.parquet(at)
    if not path:
        store, p = _hadoop(spark, at)
        store.deleteOnExit(p)
        if held := _scratches[: len(_scratches) - outer]:
            held[-1].append((spark, at))
    return spark.read.schema(df.schema).parquet(at)


@contextmanager
def scratch():
    """What is written inside goes at the end, when all that reads it has been written."""
    _scratches.append([])
    try:
        yield
    finally:
        for spark, at in _scratches.pop():
            store, p = _hadoop(spark, at)
            store.delete(p, True)


def words_column(text: Column, lower: bool = False) -> Column:
    """JVM-side words of a text (null: no words)."""
    text = F.coalesce(text, F.lit(""))
    if lower:
        text = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """UTF-8 words of a text (null: none); ``lower`` folds A-Z only."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


#: This process's model with its caches, by what makes it and its path.
_models: dict[tuple[Callable, str], object] = {}


def worker_model(make: Callable, path: str):
    """make(path), once for each worker process, so its caches outlive a task. A process
    holds one model: that of another stage goes first."""
    if (make, path) not in _models:
        release_models()
        _models[make, path] = make(path)
    return _models[make, path]


def release_models() -> None:
    """For tasks of stages that follow one with a model: its memory goes back, instead of
    staying with the worker process beside what these tasks need."""
    if _models:
        _models.clear()
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps freed memory otherwise
        if trim:
            trim(0)


def slices(batches: Iterator, rows: int = 1_000) -> Iterator:
    """Arrow batches in slices of so many rows, without copies: what a task makes of a
    slice is bounded, whatever the session's batch size."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def open_out(uri: str):
    """Output stream for a URI of any store pyarrow knows; makes the folder."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None)


def open_in(uri: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def hashed_sample(df: DataFrame, n: int, *columns: str) -> DataFrame:
    """About n rows of df (all of fewer), by a hash of the columns: the same rows each
    time, without sorting or sending any."""
    rows = df.count()
    if rows <= n:
        return df
    return df.where(F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) < int(n / rows * (1 << 40)))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
