"""Near copies by MinHash bands, verified by the exact Jaccard similarity.

The pipeline's near-duplicate stage: documents whose sets of five-word shingles have a
similarity of 0.8 or more, beside those that op2 groups. Equal sets are one node. The
bands are taken in groups: in a bucket (an equal band) the nodes of other components
than that of its smallest node are compared with that node, and what is similar joins
its component before the next group, so a large group of near copies is compared a few
times a node and makes no square of pairs. Nodes of different components that still
share a bucket at the end meet once more in an exact prefix join: sets of a similarity
of 0.8 share one of the rarest fifth of their shingles, so copies with many edits of
their own meet nobody. Pairs are compared where the bitmaps of their sets allow 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import release_models, scratch, slices, words_of, written
from .components import connected_components

SHINGLE = 5
SIMILARITY = 0.8
#: A pair of similarity s meets with 1 - (1 - s ** ROWS) ** BANDS: at 0.8 all but 7 in a million.
BANDS, ROWS = 30, 5
#: Bands of the rounds: most near copies meet in the first few.
ROUNDS = ((0, 3), (3, 9), (9, 30))
#: Bits of a set's bitmap. Two bitmaps differ in no more bits than the sets in elements.
BITMAP = 4_096
SEED = 42
_RNG = np.random.default_rng(SEED)
_MULTIPLY = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64, endpoint=False) | np.uint64(1)
_ADD = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64, endpoint=False)
_MIX = _RNG.integers(0, 1 << 64, ROWS, np.uint64, endpoint=False) | np.uint64(1)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted, different XXH64 of a text's shingles (all words, if fewer)."""
    import xxhash

    words, digest = words_of(text, lower=True), xxhash.xxh64_intdigest
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    return np.unique(np.array([digest(b" ".join(x), SEED) for x in zip(*(words[i:] for i in range(shingle)), strict=False)], np.uint64))


def least_values(hashes: np.ndarray) -> np.ndarray:
    """The least values under BANDS * ROWS multiply-shift hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1 << 10):  # bounded memory for very long texts
        x = hashes[i : i + (1 << 10), None] * _MULTIPLY + _ADD
        least = np.minimum(least, (x ^ (x >> np.uint64(29))).min(axis=0))
    return least ^ (least >> np.uint64(32))


def bands(least: np.ndarray) -> np.ndarray:
    """A key for each band."""
    mixed = least.reshape(BANDS, ROWS) * _MIX
    return (mixed ^ (mixed >> np.uint64(31))).sum(axis=1, dtype=np.uint64)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """A bit for each of BITMAP ranges of hashes that has one, as integers."""
    at = hashes >> np.uint64(64 - (BITMAP - 1).bit_length())
    out = np.zeros(BITMAP // 64, np.uint64)
    np.bitwise_or.at(out, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
    return out


def apart(x: Column, y: Column) -> Column:
    """In how many bits two bitmaps differ."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, k: n + k)


def signatures(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, same: equal for equal sets, keys: one a band);
    texts without words have none."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        release_models()
        for b in slices(batches):
            rows = [(i, s) for i, s in zip(b.column(0).to_pylist(), (shingle_set(t.as_py()) for t in b.column(1)), strict=True) if len(s)]
            same = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for _, s in rows], np.uint64).view(np.int64)
            keys = [bands(least_values(s)).view(np.int64) for _, s in rows]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array(same), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "same", "keys"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, same long, keys array<long>")


def shingle_sets(met: DataFrame, docs: DataFrame) -> DataFrame:
    """met(node, same), distinct, of documents and their sets' hashes -> a written table
    (node, same, s: the set, bits: its bitmap). Only those documents are read again."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        release_models()
        for b in slices(batches):
            found = [shingle_set(t.as_py()) for t in b.column(1)]
            same = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in found], np.uint64).view(np.int64)
            longs = lambda xs: pa.array([x.view(np.int64) for x in xs], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(same), longs(found), longs(map(bitmap, found))], ["node", "same", "s", "bits"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(met.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = written(texts.mapInArrow(run, "node long, same long, s array<long>, bits array<long>"), "copies-sets")
    if not sets.groupBy("node", "same").agg(F.count("*").alias("n")).where("n > 1").isEmpty():  # repeated rows
        sets = written(sets.dropDuplicates(["node", "same"]), "copies-sets")
    return sets


def verified(pairs: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """pairs(a, b, sa, sb), a written table of documents and their sets' hashes ->
    (a, b) of the similar ones."""
    one = pairs.select(F.col("a").alias("node"), F.col("sa").alias("same")).distinct()
    sets = shingle_sets(one.union(pairs.select("b", "sb").distinct()).distinct(), docs)
    x = pairs.join(sets.select(F.col("node").alias("b"), F.col("same").alias("sb"), F.col("s").alias("y")), ["b", "sb"])
    x = x.join(sets.select(F.col("node").alias("a"), F.col("same").alias("sa"), F.col("s").alias("x")), ["a", "sa"])
    both = F.size(F.array_intersect("x", "y"))
    return x.where(both >= similarity * (F.size("x") + F.size("y") - both)).select("a", "b")


def similar_sets(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text, ...) -> (doc_id, node: the smallest document with an equal
    shingle set), and links (a, b) between nodes whose components are those of all
    pairs of the given similarity (0.8 or more). Copies are one node, so they make no
    links. Both are written tables."""
    with scratch():
        signed = written(signatures(docs), "copies-signed")
        nodes = written(signed.groupBy("same").agg(F.min("doc_id").alias("node"), F.min_by("keys", "doc_id").alias("keys")), "copies-nodes")
        places = written(signed.join(nodes.select("same", "node"), "same").select("doc_id", "node").distinct(), "copies-places", outer=True)
        empty = nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
        links = written(empty, "copies-links")
        for low, high in ROUNDS:
            placed = written(_buckets(nodes, _labels(links), low, high), "copies-buckets")
            star = placed.where("c <> head.c").select(F.col("head.node").alias("a"), "node", F.col("head.same").alias("sa"), "same").distinct()
            star = written(star.toDF("a", "b", "sa", "sb"), "copies-star")
            links = written(links.union(verified(star, docs, similarity)), "copies-links")
        # Nodes that no round has joined, and those whose buckets they share.
        parts = connected_components(links).withColumnRenamed("component", "c")
        apart_still = written(_buckets(nodes, parts, 0, BANDS).where("n > 2").select("node", "same", "c").distinct(), "copies-open")
        prefixes = _prefixes(apart_still, docs, similarity)
        x, y = prefixes.alias("x"), prefixes.alias("y")
        # Sets of n and m elements differ in (n + m) (1 - similarity) / (1 + similarity) at most.
        most = (F.col("x.n") + F.col("y.n")) * ((1 - similarity) / (1 + similarity)) + 1e-6
        met = (F.col("x.h") == F.col("y.h")) & (F.col("x.c") < F.col("y.c")) & (F.abs(F.col("x.n") - F.col("y.n")) <= most) & (apart(F.col("x.bits"), F.col("y.bits")) <= most)
        rest = x.join(y, met).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.same").alias("sa"), F.col("y.same").alias("sb")).distinct()
        rest = written(rest, "copies-rest")
        return places, written(links.union(verified(rest, docs, similarity)), "copies-linked", outer=True)


def _prefixes(open_nodes: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """(h, node, same, c, n, bits): the n - ceil(similarity * n) + 1 rarest shingles of
    each node's set of n, by their number of these nodes. Two sets of that similarity
    have one of them in common. A written table."""
    sets = shingle_sets(open_nodes.select("node", "same"), docs)
    counts = written(sets.select(F.explode("s").alias("h")).groupBy("h").agg(F.count("*").alias("f")), "copies-shingles")
    ranked = sets.select("node", "same", F.size("s").alias("n"), F.explode("s").alias("h")).join(counts, "h")
    rarest = ranked.groupBy("node", "same").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("f", "h"))).alias("hs"))  # a set's own shingles
    first = F.slice("hs", F.lit(1), F.col("n") - F.ceil(similarity * F.col("n")).cast("int") + 1)
    # A shingle of one node brings it together with nobody.
    several = F.filter(first, lambda x: x.f > 1)
    own = open_nodes.join(sets.select("node", "same", "bits"), ["node", "same"])
    return written(rarest.select("node", "same", "n", F.explode(several).alias("x")).join(own, ["node", "same"]).select("x.h", "node", "same", "c", "n", "bits"), "copies-prefixes")


def _labels(links: DataFrame) -> DataFrame:
    """(node, c): of linked nodes the smallest neighbour's smallest neighbour. Nodes with
    one label are in one component; a component may have several, and is then compared
    more often than it has to be."""
    both = links.union(links.select("b", "a")).toDF("node", "other")
    near = written(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("c")), "copies-near")
    far = near.select(F.col("node").alias("c"), F.col("c").alias("farther"))
    return near.join(far, "c").select("node", F.least("c", "farther").alias("c"))


def _buckets(nodes: DataFrame, parts: DataFrame, low: int, high: int) -> DataFrame:
    """Rows (band, key, node, same, c, head, n) of the buckets of the bands low ..
    high - 1 that hold nodes of several parts (node, c); n is the bucket's number of
    nodes, head its smallest one."""
    parts = written(parts.select("node", "c"), "copies-parts")
    of = nodes.join(parts, "node", "left").select("same", "node", F.coalesce("c", "node").alias("c"), F.slice("keys", low + 1, high - low).alias("keys"))
    rows = written(of.select("same", "node", "c", F.posexplode("keys").alias("band", "key")), "copies-rows")
    heads = rows.groupBy("band", "key").agg(F.min(F.struct("node", "same", "c")).alias("head"), F.count("*").alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    heads = written(heads.where("c0 < c1").drop("c0", "c1"), "copies-heads")
    return rows.join(heads, ["band", "key"])


def keep_one(docs: DataFrame) -> DataFrame:
    """The row with the smallest doc_id of each group of documents that op2 groups or
    that are similar, chains included. Rows with an equal doc_id stay or go together;
    those with an equal text, too, are one row (see simhash.one_row_each). Rows without
    a doc_id can't be told apart and stay. Null and empty texts are near each other
    (op2's fingerprint zero). An empty table gives an empty result; other columns stay."""
    known = docs.where("doc_id is not null")
    with scratch():
        close = simhash.near_duplicate_groups(known).select(F.col("doc_id").cast("long"), F.col("component_id").alias("group")).distinct()
        places, links = similar_sets(known)
        both = written(close.join(places, "doc_id", "left"), "copies-placed")
        parts = written(connected_components(both.select(F.col("node").alias("a"), F.col("group").alias("b")).distinct().union(links)), "copies-parts")
        later = both.join(parts, both.group == parts.node, "left").where(F.col("doc_id") > F.coalesce("component", "group")).select("doc_id")
        later = written(later.distinct(), "copies-later", outer=True)
    kept = simhash.one_row_each(known.join(later, "doc_id", "left_anti").select(docs.columns))
    return kept.unionByName(docs.where("doc_id is null")).select(docs.columns)
