"""Exact removal of repeated word windows through a compacted De Bruijn graph.

The windows of a text (token k-mers, k = ``window`` words) fall into runs that share
the smallest hash of the shorter k-mers inside them. A run is a maximal unbranched
piece of the De Bruijn graph that can be cut out of a text without knowing any other
text, so equal stretches give equal runs whatever stands around them: runs are the
graph's edges. Only runs whose minimum also occurs elsewhere are looked at further.

* Edges that always follow one another are compacted into paths: joins of every
  edge with its only successor find the joints that don't branch, and a document
  then has one row for a path instead of one for each edge.
* A path's source is the smallest document that has it. The words at the source's and
  at each copy's coordinates are read again and compared, by a 128-bit BLAKE2b digest,
  before a span counts as repeated.
* Where one minimum stands in different runs (the ends of a repeat, or an edit in a
  copy), one document for each distinct run compares the windows themselves, under two
  independent 64-bit hashes. So it is with the runs of paths whose words differ.

So hashes of 64 bits only bring candidates together: that they may collide costs work,
not right results. Aggregates are written before they are joined, so that Spark can
split the rows of a hot passage.

No pair of documents is ever formed, so a passage in n documents costs n rows.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, words_of, written

WINDOW = 50
#: Words of the k-mers whose hashes cut a text into runs.
SEED_WORDS = 13
#: Bits of the hashes that bring runs together (tests narrow them).
RUN_BITS = 64
#: Rows of an output batch.
BATCH_ROWS = 100_000

_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * _MUL[3]
    x = (x ^ (x >> np.uint64(27))) * _MUL[4]
    return x ^ (x >> np.uint64(31))


def _doubled(h: np.ndarray, most: int) -> dict[int, np.ndarray]:
    """Hashes of all runs of 1, 2, 4 ... words up to ``most``."""
    out, size = {1: h}, 1
    while 2 * size <= most and len(out[size]) > size:
        x = out[size]
        out[2 * size] = _mix(x[:-size] * _MUL[0] + x[size:] + np.uint64(size))
        size *= 2
    return out


def rolled(powers: dict[int, np.ndarray], size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, from those of powers of two."""
    bits = [1 << b for b in reversed(range(size.bit_length())) if size >> b & 1]
    n = len(powers[1]) - size + 1
    out, at = powers[bits[0]][:n], bits[0]
    for b in bits[1:]:
        out = _mix(out * _MUL[1] + powers[b][at : at + n])
        at += b
    return _mix(out ^ _MUL[2])


def _sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    done = 1
    while 2 * done <= size:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return x if done == size else np.minimum(x[: len(x) - (size - done)], x[size - done :])


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return _mix(np.fromiter((xxh64_intdigest(w, seed) for w in words) if seed else map(xxh64_intdigest, words), np.uint64, len(words)))


def window_hashes(words: list[bytes], window: int, seed: int = 0) -> np.ndarray:
    if len(words) < window:
        return np.empty(0, np.uint64)
    return rolled(_doubled(word_hashes(words, seed), window), window)


def span_digest(words: list[bytes]) -> tuple[int, int]:
    """BLAKE2b of the words, as two signed 64-bit integers."""
    return struct.unpack("<qq", hashlib.blake2b(b" ".join(words), digest_size=16).digest())


def text_runs(words: list[bytes], window: int, seed: int, bits: int = RUN_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimum, run hash, first window, number of windows) of each run."""
    if len(words) < window:
        return (*np.empty((2, 0), np.uint64), *np.empty((2, 0), np.int64))
    powers = _doubled(word_hashes(words), window)
    low = _sliding_min(rolled(powers, seed), window - seed + 1)
    whole = rolled(powers, window)
    starts = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
    sizes = np.diff(starts, append=len(low))
    offset = (np.arange(len(low)) - np.repeat(starts, sizes)).astype(np.uint64)
    runs = _mix(np.add.reduceat(_mix(whole + offset * _MUL[5]), starts) + sizes.astype(np.uint64) * _MUL[6])
    drop = np.uint64(64 - bits)
    return low[starts] >> drop, runs >> drop, starts, sizes


def graph_edges(docs: DataFrame, window: int, seed: int, bits: int = RUN_BITS) -> DataFrame:
    """docs(rid, doc_id, text) -> (m, e, rid, doc_id, at, n): edge e with minimum m
    starts at window ``at`` of the row and has n windows."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for lo in range(0, b.num_rows, 256):  # bounded output batches
                part = b.slice(lo, 256)
                found = [text_runs(words_of(t.as_py()), window, seed, bits) for t in part.column(2)]
                counts = np.array([len(x[0]) for x in found])
                m, e, at, n = (np.concatenate(x) for x in zip(*found, strict=True))
                rid = np.repeat(part.column(0).to_numpy(zero_copy_only=False), counts)
                doc = np.repeat(part.column(1).to_numpy(zero_copy_only=False), counts)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (m.view(np.int64), e.view(np.int64), rid, doc, at.astype(np.int32), n.astype(np.int32))], ["m", "e", "rid", "doc_id", "at", "n"])

    return docs.where("doc_id is not null").select("rid", "doc_id", "text").mapInArrow(run, "m long, e long, rid long, doc_id long, at int, n int")


def _read_again(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """wanted(doc_id, rid, at, n, m, whole) -> (m, w, v, doc_id, rid, at, n, whole): the
    digest of a whole span's words, else the two hashes of each of its windows."""
    names = ["m", "w", "v", "doc_id", "rid", "at", "n", "whole"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list[tuple] = []

        def emit():
            m, w, v, doc, rid, at, n, whole = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            return pa.RecordBatch.from_arrays([*map(pa.array, (m, w, v, doc, rid, at.astype(np.int32), n.astype(np.int32), whole.astype(bool)))], names)

        size = 0
        for b in batches:
            for rid, doc, text, runs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                words, runs = words_of(text.as_py()), runs.as_py()
                parts = []
                if spans := [r for r in runs if r["whole"]]:
                    w, v = zip(*[span_digest(words[r["at"] : r["at"] + r["n"] + window - 1]) for r in spans], strict=True)
                    parts.append(([r["m"] for r in spans], w, v, [r["at"] for r in spans], [r["n"] for r in spans], [1] * len(spans)))
                if single := [r for r in runs if not r["whole"]]:
                    at = np.concatenate([np.arange(r["at"], r["at"] + r["n"]) for r in single])
                    w, v = (window_hashes(words, window, seed).view(np.int64)[at] for seed in (0, 1))
                    parts.append((np.repeat([r["m"] for r in single], [r["n"] for r in single]), w, v, at, np.ones(len(at)), np.zeros(len(at))))
                for m, w, v, at, n, whole in parts:
                    held.append((np.array(m, np.int64), np.array(w, np.int64), np.array(v, np.int64), np.full(len(at), doc), np.full(len(at), rid), np.array(at, np.int64), np.array(n, np.int64), np.array(whole)))
                    size += len(at)
                if size >= BATCH_ROWS:
                    yield emit()
                    size = 0
        if held:
            yield emit()

    runs = wanted.groupBy("doc_id", "rid").agg(F.collect_list(F.struct("at", "n", "m", "whole")).alias("runs"))  # a row's own runs
    read = docs.join(runs, ["doc_id", "rid"]).select("rid", "doc_id", "text", "runs")
    return read.mapInArrow(run, "m long, w long, v long, doc_id long, rid long, at int, n int, whole boolean")


def repeated_spans(docs: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS, bits: int = RUN_BITS) -> DataFrame:
    """docs(rid, doc_id, text) -> (doc_id, rid, at, n): windows at .. at + n - 1 of the
    row start in a document with a smaller doc_id, too. Spans may overlap."""
    runs = written(graph_edges(docs, window, seed, bits), "substring-edges")
    spread = runs.groupBy("m").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min("e").alias("e0"), F.max("e").alias("e1"))
    shared = written(spread.where("low < high").select("m", (F.col("e0") != F.col("e1")).alias("mixed")), "substring-minima")
    edges = written(runs.join(shared, "m").select("m", F.xxhash64("m", "e").alias("e"), "rid", "doc_id", "at", "n", "mixed").distinct(), "substring-shared")

    # Joints that don't branch: e is always followed by one edge, which follows nothing else.
    order = Window.partitionBy("doc_id", "rid").orderBy("at")
    after = F.when(F.lead("at").over(order) == F.col("at") + F.col("n"), F.lead("e").over(order))
    out = edges.select("e", after.alias("next")).groupBy("e").agg(F.count("*").alias("n_e"), F.count("next").alias("n_next"), F.min("next").alias("next"), F.max("next").alias("other"))
    out = written(out, "substring-joints")
    only = out.where("n_e = n_next and next = other").select("next", "n_e")
    inner = only.join(out.select(F.col("e").alias("next"), F.col("n_e").alias("n_all")), "next").where("n_e = n_all").select(F.col("next").alias("e"), F.lit(True).alias("inner"))
    inner = written(inner, "substring-inner")
    steps = edges.join(inner, "e", "left").select("m", "e", "rid", "doc_id", "at", "n", F.coalesce("inner", F.lit(False)).alias("inner"))
    steps = steps.withColumn("path", F.sum(F.when(F.col("inner"), 0).otherwise(1)).over(order))
    paths = steps.groupBy("doc_id", "rid", "path").agg(F.min("at").alias("at"), F.sum("n").cast("int").alias("n"), F.min(F.when(~F.col("inner"), F.col("e"))).alias("head"), F.collect_list(F.struct("at", "n", "m")).alias("runs"))
    paths = written(paths, "substring-paths")
    heads = written(paths.groupBy("head").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("head"), "substring-heads")
    spans = paths.join(heads, "head").select("doc_id", "rid", "at", "n", F.col("head").alias("m"), F.lit(True).alias("whole"))
    # One document for each distinct run with a shared minimum compares single windows.
    mixed = edges.where("mixed")
    first = written(mixed.groupBy("e").agg(F.min("doc_id").alias("first")), "substring-first")
    wanted = mixed.join(first, "e").where("doc_id = first").select("doc_id", "rid", "at", "n", "m", F.lit(False).alias("whole"))
    read = written(_read_again(docs, spans.unionByName(wanted), window), "substring-words")

    # Source coordinates: the same words stand in a smaller document.
    same = read.where("whole").groupBy("m", "w", "v", "n").agg(F.min("doc_id").alias("source"))
    same = written(same, "substring-sources")
    found = written(read.where("whole").join(same, ["m", "w", "v", "n"]), "substring-verified")
    copied = found.where("doc_id > source").select("doc_id", "rid", "at", "n")
    single = read.where("not whole")
    # Paths of one head whose words differ: their runs, too, are compared by windows.
    apart = written(same.groupBy("m").agg(F.count("*").alias("k")).where("k > 1").select("m"), "substring-apart")
    if not apart.isEmpty():
        own = found.where("doc_id = source").join(apart, "m", "left_semi").select("doc_id", "rid", "at", F.col("m").alias("head"))
        more = paths.join(own, ["doc_id", "rid", "at", "head"]).select("doc_id", "rid", F.inline("runs")).select("*", F.lit(False).alias("whole")).distinct()
        single = single.unionByName(written(_read_again(docs, more, window), "substring-apart-words")).distinct()
    lows = single.groupBy("m", "w", "v").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    lows = written(lows.drop("high"), "substring-lows")
    alone = single.join(lows, ["m", "w", "v"]).where("doc_id > low").select("doc_id", "rid", "at", F.lit(1).alias("n"))
    return copied.unionByName(alone)


def _rows(docs: DataFrame) -> DataFrame:
    """rid tells rows with the same doc_id and other texts apart."""
    return docs.select(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def without_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS, bits: int = RUN_BITS) -> DataFrame:
    """docs(doc_id, text, ...) -> per row: doc_id, n_words, n_removed, kept_sha256,
    kept_text (the words kept, joined by a space).

    A word is removed if a window of ``window`` words covers it whose word sequence
    also starts in a document with a smaller doc_id; windows are judged on the input.
    Null texts have no words. Rows without a doc_id are neither sources nor cut.
    Repeated rows have equal ids, so they aren't each other's source; each comes back.
    An empty table gives an empty result; other columns are ignored."""
    rows = _rows(docs)
    spans = repeated_spans(rows, window, seed, bits).groupBy("doc_id", "rid").agg(F.collect_list(F.struct("at", "n")).alias("spans"))  # a row's own spans

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            n_words, n_removed, sha, kept = [], [], [], []
            for text, cut in zip(b.column(1), b.column(2), strict=True):
                words = words_of(text.as_py())
                n_words.append(len(words))
                if cut.is_valid:
                    edge = np.zeros(len(words) + 1, np.int32)
                    for s in cut.as_py():
                        edge[s["at"]] += 1
                        edge[s["at"] + s["n"] + window - 1] -= 1
                    keep = np.cumsum(edge[:-1]) == 0
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                n_removed.append(n_words[-1] - len(words))
                whole = b" ".join(words)
                sha.append(hashlib.sha256(whole).hexdigest())
                kept.append(whole.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    joined = rows.join(spans, ["doc_id", "rid"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir)).drop("kept_text")


QUERIES = {"op9_substring_dedup": op9_substring_dedup}
SQL: dict[str, str] = {}
