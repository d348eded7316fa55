"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each text. The counts
of all vote patterns over all texts are few, whatever the corpus; expectation-
maximisation over them estimates how each labeller votes on good and on bad texts,
and so the posterior of each pattern. A linear scorer over hashed words learns the
posterior labels on a bounded sample, and scores every text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, hashed_sample, written
from .quality import base_measures

#: Frequent function words of English, French, German and Spanish (fixed values).
FUNCTION_WORDS = frozenset(
    x.encode()
    for x in (
        "the of and to in a is that it for was on are as with his they at be this have from or had by but not what all were when we there can an your which their if will "
        "de la le et les des en un une que est pour qui dans par sur au avec ce pas plus ne se son "
        "der die und das den von zu mit sich auf für ist im dem nicht ein eine als auch es an er "
        "el los y del las por con para su al lo como más o pero sus"
    ).split()
)
LABELLERS = ("length", "symbols", "capitals", "marks", "lines", "repeats", "variety", "sentences", "function_words")
PATTERNS = 3 ** len(LABELLERS)
_SPACE, _MARK = (np.isin(np.arange(256), list(x)) for x in (b" \t\n\v\f\r", b"!#*$%&|"))
#: The scorer is fitted on about FIT_DOCS texts, chosen by a hash, whole and of any length.
FIT_DOCS = 20_000
BUCKETS, EPOCHS, RATE, L2 = 1 << 15, 6, 0.5, 1e-6
KEEP = 0.5
#: How labellers vote on bad and on good texts, before any is seen (bad, none, good).
PRIOR, PRIOR_SHARE = np.array([[0.6, 0.0, 0.4], [0.02, 0.0, 0.98]]), 0.05
COLUMNS = "doc_id long, pattern int, label_probability double, score double, kept boolean"


class Profile:
    """What the labellers and the scorer look at in one text."""

    def __init__(self, text: str | None):
        raw = (text or "").encode("utf-8", "surrogatepass")
        self.measures = base_measures(text)
        self.lower = Counter(raw.lower().split())
        at = np.frombuffer(raw, np.uint8)
        space = np.append(True, np.append(_SPACE[at], True))
        self.firsts = at[space[:-2] & ~space[1:-1]]
        self.lasts = at[~space[1:-1] & space[2:]]
        edge = np.flatnonzero(space[1:] != space[:-1])
        self.sizes = edge[1::2] - edge[::2]
        accented = (at[:-1] == 0xC3) & (at[1:] >= 0x80) & (at[1:] <= 0x9E)
        self.capitals = int(np.count_nonzero((at >= 65) & (at <= 90)) + np.count_nonzero(accented))
        self.ends = sum(map(raw.count, (b".", b"!", b"?"))) or 0.5
        self.lines = raw.count(b"\n") + 1

    def votes(self) -> list[int]:
        """Votes of the LABELLERS (1 good, -1 bad, 0 none). Each asks for enough text
        to judge by; a text without words is bad to the first alone."""
        words, chars, symbols, dup_lines, repeats = self.measures
        n = len(words)
        if n == 0:
            return [-1] + [0] * (len(LABELLERS) - 1)

        def vote(bad: bool, good: bool, enough: int = 1) -> int:
            return 0 if n < enough else -1 if bad else int(good)

        capitals = self.capitals / chars
        marked = np.count_nonzero(_MARK[self.lasts]) / n
        function = sum(self.lower[w] for w in FUNCTION_WORDS & self.lower.keys()) / n
        variety = len(self.lower) / n
        return [
            vote(n < 3, n >= 60),
            vote(symbols > 0.1 * n, symbols <= 0.01 * n),
            vote(capitals > 0.25, capitals < 0.12, 5),
            vote(marked > 0.15, marked < 0.03, 5),
            vote(dup_lines > 0.4 * self.lines, dup_lines == 0, 30),
            vote(repeats > 0.4 * n, repeats <= 0.05 * n, 20),
            vote(variety < 0.2, variety > 0.35, 40),
            vote(not 2 <= n / self.ends <= 80, 4 <= n / self.ends <= 40, 30),
            vote(function < 0.03, function > 0.1, 20),
        ]

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashed features, of unit length: the words without case, the first and last
        bytes of words, and their lengths."""
        found = np.zeros(BUCKETS)
        at = np.fromiter(map(crc32, self.lower), np.int64, len(self.lower)) & (BUCKETS - 1)
        np.add.at(found, at, np.fromiter(self.lower.values(), np.int64, len(self.lower)))
        kept = [at]
        for kind, values in ((b"first", self.firsts), (b"last", self.lasts), (b"size", np.minimum(self.sizes, 40))):
            counts = np.bincount(values)
            seen = np.flatnonzero(counts)
            at = np.array([crc32(b"%d" % x, crc32(kind)) for x in seen.tolist()], np.int64) & (BUCKETS - 1)
            np.add.at(found, at, counts[seen])
            kept.append(at)
        at = np.unique(np.concatenate(kept))
        x = np.sqrt(found[at])
        return at, x / max(np.sqrt((x * x).sum()), 1e-12)


def pattern_of(v: list[int]) -> int:
    return sum((x + 1) * 3**i for i, x in enumerate(v))


def fit_labellers(counts: np.ndarray, rounds: int = 300, prior: float = 0.8) -> tuple[np.ndarray, np.ndarray]:
    """counts of each pattern -> (posterior of "good" of each pattern, accuracies:
    labellers x {bad, good} x {voted bad, no vote: 1, voted good}).

    Starts from the balance of the votes. PRIOR, worth PRIOR_SHARE of the texts, says
    that a labeller is right rather than wrong, which keeps the two classes from
    standing for anything else and gives patterns never seen a posterior, too."""
    seen = np.flatnonzero(counts)
    all_votes = np.arange(PATTERNS)[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    balance = (all_votes - 1).sum(axis=1)
    rates = np.full((len(LABELLERS), 2, 3), 0.5)
    share = prior

    def posterior(which: np.ndarray) -> np.ndarray:
        logs = [np.log(s) + sum(np.log(rates[j, y, all_votes[which, j]]) for j in range(len(LABELLERS))) for y, s in ((0, 1 - share), (1, share))]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))

    against = (all_votes[seen] == 0).sum(axis=1)
    good = 1 / (1 + np.exp(-(0.5 * balance[seen] - 2.0 * against + 1.0)))
    for _ in range(rounds if len(seen) else 0):
        for y, w in ((0, counts[seen] * (1 - good)), (1, counts[seen] * good)):
            for j in range(len(LABELLERS)):
                had = np.bincount(all_votes[seen, j], weights=w, minlength=3) + PRIOR_SHARE * counts.sum() * PRIOR[y]
                rates[j, y] = had / (had[0] + had[2])
                rates[j, y, 1] = 1.0  # no vote says nothing
        share = float(np.clip((counts[seen] * good).sum() / counts.sum(), 0.05, 0.95))
        new = posterior(seen)
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return posterior(np.arange(PATTERNS)), rates


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
    """Logistic regression on soft labels, by AdaGrad; the last weight is the bias.
    The two classes weigh alike, however many texts each has."""
    w, g = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-8)
    total = sum(y for _, _, y in rows)
    weight = (len(rows) / max(2 * (len(rows) - total), 1e-9), len(rows) / max(2 * total, 1e-9))
    order = np.random.default_rng(1)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            p = 1 / (1 + np.exp(-np.clip(w[at] @ x + w[-1], -30, 30)))
            slope = (1 - y) * min(weight[0], 20) * p - y * min(weight[1], 20) * (1 - p)
            step = slope * x + L2 * w[at]
            g[at] += step * step
            w[at] -= RATE * step / np.sqrt(g[at])
            g[-1] += slope * slope
            w[-1] -= RATE * slope / np.sqrt(g[-1])
    return w


def vote_patterns(docs: DataFrame) -> DataFrame:
    """docs(text) -> (pattern, n), every text counted."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pattern_of(Profile(t.as_py()).votes()) for t in b.column(0)], pa.int32())], ["pattern"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "pattern int").groupBy("pattern").agg(F.count("*").alias("n"))


def fit(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of each pattern from all texts, scorer weights from the sample)"""
    counts = np.zeros(PATTERNS)
    for pattern, n in vote_patterns(docs).collect():  # at most PATTERNS rows
        counts[pattern] = n
    posterior, _ = fit_labellers(counts)
    sample = hashed_sample(docs, FIT_DOCS, "doc_id", "text").select(F.col("text").cast("string").alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        rows = []
        for pdf in batches:
            for text in pdf["text"]:
                p = Profile(text)
                rows.append((*p.features(), float(posterior[pattern_of(p.votes())])))
        yield pd.DataFrame({"w": [fit_scorer(rows).astype("<f8").tobytes()]})

    weights = written(sample.repartition(1).sortWithinPartitions(F.xxhash64("text")).mapInPandas(run, "w binary"), "quality-weights").first()
    return posterior, np.frombuffer(bytes(weights.w), "<f8") if weights else np.zeros(BUCKETS + 1)


def classify(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None, keep: float = KEEP) -> DataFrame:
    """docs(doc_id, text, ...) -> per row: its vote pattern, the posterior of that
    pattern, the scorer's probability of a good text, and ``kept`` (at least ``keep``).

    A null text is an empty one. Repeated rows count and come back each; an empty table
    gives an empty result; other columns are ignored. Whole texts are read."""
    posterior, w = model or fit(docs)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            patterns, scores = [], []
            for text in b.column(1):
                p = Profile(text.as_py())
                at, x = p.features()
                patterns.append(pattern_of(p.votes()))
                scores.append(float(1 / (1 + np.exp(-np.clip(w[at] @ x + w[-1], -30, 30)))) if p.lower else 0.0)
            score = np.array(scores, np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(patterns, pa.int32()), pa.array(posterior[np.array(patterns, np.int64)]), pa.array(score), pa.array(score >= keep)], [c.split()[0] for c in COLUMNS.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, COLUMNS)


def op10_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir))


QUERIES = {"op10_weak_quality": op10_weak_quality}
SQL: dict[str, str] = {}
