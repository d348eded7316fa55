"""SimHash near-duplicate groups by the generalised pigeonhole principle.

Bits that go together over the corpus share a partition; dynamic programming
gives each partition its own threshold (-1: not probed) so that the thresholds
sum to ``distance - partitions + 1``; every pair within ``distance`` then agrees
within the threshold of one partition at least. One side of the join enumerates
a partition's values within the threshold, the other side has the value itself,
and the join verifies the whole distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, release_models, words_of, written
from .components import connected_components

BITS = 64
SEED = 42
#: Relative costs: a shuffled and sorted row, and a candidate met in the join.
ROW_COST, CANDIDATE_COST = 1.0, 0.03


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash: a bit is 1 if it is set in over half of the shingles' XXH64."""
    import xxhash

    words = words_of(text, lower=True)
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest = xxhash.xxh64_digest
    ones, n = np.zeros(BITS, np.int64), len(words) - shingle + 1
    for start in range(0, n, 1 << 15):  # bounded memory for very long texts
        part = words[start : start + (1 << 15) + shingle - 1]
        raw = b"".join([digest(b" ".join(x), SEED) for x in zip(*(part[i:] for i in range(shingle)), strict=False)])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fp long: the fingerprint's bits)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        release_models()
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def bit_moments(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Over all rows: their number, and how often each two bits are both set."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        total = np.zeros((BITS, BITS))
        for pdf in batches:
            raw = pdf["fp"].to_numpy(np.int64).astype(">i8").view(np.uint8).reshape(-1, 8)
            x = np.unpackbits(raw, axis=1).astype(np.float32)
            for i in range(0, len(x), 1 << 16):  # exact in float32
                total += x[i : i + (1 << 16)].T @ x[i : i + (1 << 16)]
        yield pd.DataFrame({"at": np.arange(BITS * BITS), "n": total.ravel().astype(np.int64)})

    rows = fps.select("fp").mapInPandas(run, "at int, n long").groupBy("at").agg(F.sum("n")).collect()  # 4,096 rows
    both = np.zeros(BITS * BITS)
    for at, n in rows:
        both[at] = n
    return fps.count(), both.reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of like width; each starts at the bit with the strongest ties
    that is left and takes the bits most correlated with it (bit 0: the highest)."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    left, groups = set(range(BITS)), []
    for i in range(m):
        width = BITS // m + (i < BITS % m)
        group = [max(sorted(left), key=lambda b: corr[b, sorted(left)].sum())]
        left.remove(group[0])
        while len(group) < width:
            group.append(max(sorted(left), key=lambda b: corr[b, group].sum()))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def close_share(n: int, both: np.ndarray, bits: list[int], most: int) -> float:
    """Estimated share of pairs within ``most`` differing bits of a partition: a
    beta-binomial with the mean and variance that the second moments of all
    fingerprints give for the number of differing bits."""
    p11 = both[np.ix_(bits, bits)] / max(n, 1)
    p = np.diag(p11)
    p10 = np.maximum(p[:, None] - p11, 0)
    p01, p00 = p10.T, np.maximum(1 - p[:, None] - p[None, :] + p11, 0)
    differ = 2 * (p11 * p00 + p10 * p01)  # both bits differ between two random rows
    d, w = 2 * p * (1 - p), len(bits)
    np.fill_diagonal(differ, d)
    mean, var = d.sum(), (differ - np.outer(d, d)).sum()
    q = min(max(mean / w, 1e-6), 1 - 1e-6)
    extra = (var / (w * q * (1 - q)) - 1) / max(w - 1, 1)
    rho = min(max(extra, 1e-6), 0.999)
    a, b = q * (1 / rho - 1), (1 - q) * (1 / rho - 1)
    beta = lambda x, y: math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y)
    return sum(math.exp(math.log(math.comb(w, k)) + beta(k + a, w - k + b) - beta(a, b)) for k in range(most + 1))


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Dynamic programming: costs[i][t + 1] for threshold t >= -1 of partition i;
    the cheapest thresholds that sum to ``total``."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, own in enumerate(row, start=-1):
                if s + t not in step or c + own < step[s + t][0]:
                    step[s + t] = (c + own, [*ts, t])
        best = step
    return best[total]


def plan(n: int, both: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    """Probed partitions with their thresholds, for the cheapest number of partitions."""
    found = []
    for m in range(2, distance + 2):
        groups = group_bits(n, both, m)
        costs = [[0.0] + [n * ROW_COST * (1 + sum(math.comb(len(g), k) for k in range(t + 1))) + n * n / 2 * close_share(n, both, g, t) * CANDIDATE_COST for t in range(min(distance, len(g)) + 1)] for g in groups]
        cost, ts = allocate(costs, distance - m + 1)
        found.append((cost, [(g, t) for g, t in zip(groups, ts, strict=True) if t >= 0]))
    return min(found, key=lambda x: x[0])[1]


def _mask(bits: tuple[int, ...] | list[int]) -> int:
    """Signed 64-bit mask of the bits (0: the highest)."""
    x = sum(1 << (BITS - 1 - b) for b in bits)
    return x - (1 << BITS) if x >> (BITS - 1) else x


def close_pairs(fps: DataFrame, distance: int = 3) -> DataFrame:
    """fps(fp long, node long), each fp once -> (a, b) nodes of all pairs of
    different fingerprints within ``distance`` bits (repeats possible)."""
    if distance == 0:
        return fps.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    n, both = bit_moments(fps)
    probes, index = [], []
    for i, (bits, t) in enumerate(plan(n, both, distance)):
        whole = F.col("fp").bitwiseAND(F.lit(_mask(bits)))
        flips = [_mask(x) for k in range(t + 1) for x in combinations(bits, k)]
        keys = F.explode(F.transform(F.array(*map(F.lit, flips)), lambda x, w=whole: w.bitwiseXOR(x))) if t else whole
        probes.append(fps.select(F.lit(i).alias("part"), keys.alias("key"), F.col("fp").alias("fa"), F.col("node").alias("a")))
        index.append(fps.select(F.lit(i).alias("part"), whole.alias("key"), F.col("fp").alias("fb"), F.col("node").alias("b")))
    union = lambda xs: xs[0] if len(xs) == 1 else union([xs[0].union(xs[1]), *xs[2:]])
    near = (F.col("fa") < F.col("fb")) & (F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= distance)
    x, y = union(probes), union(index)
    return x.join(y, (x.part == y.part) & (x.key == y.key) & near).select("a", "b")


def near_duplicate_groups(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """docs(doc_id, text, ...) -> per row: doc_id, fingerprint (16 hex digits),
    component_id (smallest doc_id reachable over links of at most ``distance``
    differing bits).

    Copies share a fingerprint and count as one node, so a group of copies of any
    size adds one row to the search. Null and empty texts have fingerprint zero and
    link like any other; rows with a null doc_id keep their fingerprint and take the
    component of the others. Repeated rows come back as often as they are in docs;
    an empty table gives an empty result; other columns are ignored."""
    fps = written(fingerprints(docs, shingle), "simhash-fps")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    known = nodes.where("node is not null")
    parts = connected_components(close_pairs(known, distance))
    of = nodes.join(parts, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """The row with the smallest doc_id of each group (see one_row_each). Rows without a
    doc_id can't be told apart and stay."""
    groups = near_duplicate_groups(docs.where("doc_id is not null"), shingle, distance)
    first = groups.where("doc_id = component_id").select("doc_id")
    kept = one_row_each(docs.join(first.distinct(), "doc_id", "left_semi").select(docs.columns))
    return kept.unionByName(docs.where("doc_id is null")).select(docs.columns)


def one_row_each(docs: DataFrame) -> DataFrame:
    """One row for each doc_id and text; of several the one whose other columns, from
    left to right, are the smallest (nulls first). Other texts under an equal doc_id stay."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    if not rest:
        return docs.distinct()
    return docs.groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("rest")).select("doc_id", "text", "rest.*").select(docs.columns)


def op2_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(documents(spark, sf_dir), shingle=3, distance=3)


QUERIES = {"op2_simhash_neardup": op2_simhash_neardup}
SQL: dict[str, str] = {}
