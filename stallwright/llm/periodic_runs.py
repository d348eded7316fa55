"""Periodic runs of words: stretches that repeat with a period, found whole.

A run of period d has many words equal to that d places on. For each text the number
of such matches is counted for all lags at once, exactly: frequent words by an
autocorrelation with Fourier transforms, rare ones by the differences of all pairs of
their positions. Only lags with enough matches for a run are scanned for islands of
consecutive matches.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, words_column

#: A run has at least LEAST_WORDS words and LEAST_PERIODS periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Texts worked on together, up to so many words (or one text).
CHUNK_WORDS = 100_000
#: Numbers in one block of transforms.
BLOCK = 1 << 22
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _transform_size(n: int) -> int:
    return 1 << (2 * n - 1).bit_length()


def _heavy_from(n: int) -> int:
    """Words more frequent than this in a text of n words are counted by transforms: their
    pairs would cost more."""
    size = _transform_size(max(n, 1))
    return max(16, math.isqrt(size * size.bit_length()) // 4)


def _heavy_matches(ids: np.ndarray, heavy: np.ndarray, lags: int) -> np.ndarray:
    """Matches of the heavy words at lags 0 to lags - 1. The sums are whole numbers of at
    most len(ids), far within the precision of the transforms."""
    size = _transform_size(len(ids))
    power = np.zeros(size // 2 + 1)
    step = max(1, BLOCK // size)
    for at in range(0, len(heavy), step):
        marks = (ids == heavy[at : at + step, None]).astype(np.float64)
        spectrum = np.fft.rfft(marks, size)
        power += (spectrum.real**2 + spectrum.imag**2).sum(0)
    return np.rint(np.fft.irfft(power, size)[:lags]).astype(np.int64)


def lag_matches(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each text of word numbers: the number of matches at each lag up to a
    LEAST_PERIODS-th of its length (at lag 0: not counted)."""
    lengths = np.array([len(t) for t in texts])
    lags = lengths // LEAST_PERIODS + 1
    base = np.cumsum(lags) - lags
    counts = np.zeros(int(lags.sum()), np.int64)
    light, of, offset = [], [], 0
    for i, ids in enumerate(texts):
        if len(ids) < LEAST_WORDS:
            continue
        freq = np.bincount(ids)
        heavy = np.flatnonzero(freq > _heavy_from(len(ids)))
        if len(heavy):
            counts[base[i] : base[i] + lags[i]] += _heavy_matches(ids, heavy, lags[i])
        rare = (freq > 1) & (freq <= _heavy_from(len(ids)))
        at = np.flatnonzero(rare[ids])
        order = at[np.argsort(ids[at], kind="stable")]
        light.append(np.stack([ids[order] + offset, order]))
        of.append(np.full(len(order), i))
        offset += len(freq)
    if light:
        (word, place), text = np.concatenate(light, 1), np.concatenate(of)
        #: How many places of its own word follow each place.
        end = np.searchsorted(word, word, "right")
        at, k = np.arange(len(word)), 1
        while len(at := at[at + k < end[at]]):
            lag = place[at + k] - place[at]
            near = lag < lags[text[at]]
            counts += np.bincount(base[text[at[near]]] + lag[near], minlength=len(counts))
            k += 1
    return [counts[b : b + n] for b, n in zip(base, lags, strict=True)]


def _has_island(ids: np.ndarray, lag: int, least: int) -> bool:
    """Whether there may be ``least`` matches in a row: such an island holds a whole block
    of half as many at a multiple of that, so blocks that fail at once are all it takes
    for most lags."""
    half = least // 2
    at = np.arange(0, len(ids) - lag - half + 1, half)
    for _ in range(half):
        at = at[ids[at] == ids[at + lag]]
        if not len(at):
            return False
        at += 1
    return True


def runs_of(ids: np.ndarray, matches: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs by start, then period; period the smallest.

    Lags ascend, so a stretch met before has its smallest period already. A run of
    period q is also an island at each multiple of q that leaves it another q words;
    its matches there are taken off, so that multiples aren't scanned for it."""
    left, found = matches.copy(), {}
    lags = np.arange(len(left))
    least = np.maximum(LEAST_WORDS - lags, (LEAST_PERIODS - 1) * lags)
    for lag in np.flatnonzero(left >= least).tolist():
        if lag == 0 or left[lag] < least[lag] or not _has_island(ids, lag, int(least[lag])):
            continue
        same = np.zeros(len(ids) - lag + 2, np.int8)
        same[1:-1] = ids[lag:] == ids[:-lag]
        edges = np.flatnonzero(np.diff(same))
        for start, end in edges.reshape(-1, 2)[edges[1::2] - edges[::2] >= least[lag]].tolist():
            length = end - start + lag
            if (start, length) not in found:
                found[start, length] = lag
                multiples = np.arange(lag, min(length - lag, len(left) - 1) + 1, lag)
                left[multiples] -= length - multiples
    return sorted((start, length, period) for (start, length), period in found.items())


def _numbers(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def _row(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    if runs:
        start, length, period = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
        best = (start, length, period, 1000 * length // period)
        kept = np.ones(len(words), bool)
        for s, n, p in runs:
            kept[s + p : s + n] = False
        words = [words[i] for i in np.flatnonzero(kept)]
    else:
        best = (None,) * 4
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()
    return (len(runs), *best, hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest())


def _chunks(rows: Iterator) -> Iterator[list[tuple]]:
    held, size = [], 0
    for doc_id, text in rows:
        words = (text or b"").split()
        if held and size + len(words) > CHUNK_WORDS:
            yield held
            held, size = [], 0
        held.append((doc_id, words))
        size += len(words)
    if held:
        yield held


def periodic_runs(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> one row for each of its rows: doc_id, n_runs, the run of
    the greatest length/period (start, length, period, exponent_milli; ties: the smallest
    start, then period), SHA-256 of all runs, and of the words left when each run keeps
    its first period only.

    A null text has no words. Rows with equal or null ids stay apart, an empty table gives
    none, other columns are ignored. There's no shuffle: texts are independent, and a
    text of n words takes memory in proportion to n and time near n log n, unless words
    are so few that matches without order abound."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([(name, getattr(pa, {"long": "int64"}.get(kind, kind))()) for name, kind in map(str.split, SCHEMA.split(", "))])
        for b in batches:
            for chunk in _chunks(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                texts = [_numbers(words) for _, words in chunk]
                rows = [(doc_id, *_row(words, runs_of(ids, m))) for (doc_id, words), ids, m in zip(chunk, texts, lag_matches(texts), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, SCHEMA)


def with_planted_periods(text: Column, doc_id: Column) -> Column:
    """The texts of op12's contract: where h = crc32(doc_id) ends on 0, the words from a on
    repeat with period p; g = h div 10, a = g mod n, p = 1 + (n - a) div (3 + g mod 8)."""
    g = F.floor(F.crc32(doc_id.cast("string").cast("binary")) / 10).cast("long")
    words = F.array(F.struct(words_column(text).alias("w"), g.alias("g")))
    at = F.transform(words, lambda s: F.struct(s.w.alias("w"), F.pmod(s.g, F.size(s.w)).alias("a"), s.g.alias("g")))
    at = F.transform(at, lambda s: F.struct(s.w.alias("w"), s.a.alias("a"), (1 + F.floor((F.size(s.w) - s.a) / (3 + F.pmod(s.g, F.lit(8))))).alias("p")))
    planted = F.transform(at, lambda s: F.concat_ws(" ", F.transform(s.w, lambda w, i: F.when(i < s.a, w).otherwise(F.element_at(s.w, (1 + s.a + F.pmod(i - s.a, s.p)).cast("int"))))))[0]
    return F.when((F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0) & text.rlike("[^\\x20\\x09-\\x0D]"), planted).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return periodic_runs(docs.select("doc_id", with_planted_periods(F.col("text"), F.col("doc_id")).alias("text")))


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
SQL: dict[str, str] = {}
