"""Ranked lexical search over a clustered index, exact.

Recursive graph bisection of the document-term graph puts documents that share terms
side by side. It's fitted on a bounded sample: each bisection leaves a weight for each
hashed term, by which every document finds its place in the order. The ordered
documents are cut into shards with an inverted index each, and a term's largest impact
in a shard bounds what the shard can add to a score. An item visits the shards from the
greatest bound down, in rounds, until no bound left reaches its last ranked score.
Postings hold places in a shard; its list of ids maps them back to doc_id for ties.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, hashed_sample, scratch, written

#: Letters and digits of ASCII (A-Z folded) and all other characters make terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: The bisection: sampled documents, hashed terms, levels, and exchanges a level.
SAMPLE_DOCS, FEATURES, LEVELS, EXCHANGES = 4_096, 1 << 15, 6, 10
#: A cluster's documents fall into so many ranges of the margin; a task gets ranges of
#: about so many bytes of text.
SLICES, TASK_BYTES = 16, 16 << 20
#: A shard is closed at so many documents or postings (or at one document).
SHARD_DOCS, SHARD_POSTINGS = 4_096, 1_000_000
RANKED = 50
#: An item visits this many times as many shards in each round as before it.
WIDER = 8
INDEX = "shard long, term binary, bound long, places binary, counts binary"


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def _features(terms) -> np.ndarray:
    return np.unique(np.fromiter(map(zlib.crc32, terms), np.int64, len(terms)) % FEATURES)


def _cost(degree: np.ndarray, n: int) -> np.ndarray:
    """Bits for the gaps of a term that is in ``degree`` of n documents."""
    return degree * np.log2(n / (degree + 1))


def bisect(docs: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
    """Recursive bisection of documents (arrays of features): for each node of a binary tree
    in level order a threshold and a weight a feature; a document goes right where the sum
    of its weights is above the threshold. Halves swap the documents whose move gains
    most, in pairs, as long as a pair gains."""
    tree: list[tuple[float, np.ndarray]] = []
    level = [np.arange(len(docs))]
    for _ in range(LEVELS):
        below = []
        for members in level:
            half = len(members) // 2
            left, right = members[:half], members[half:]
            degrees = lambda side: np.bincount(np.concatenate([docs[i] for i in side]) if len(side) else np.empty(0, np.int64), minlength=FEATURES).astype(np.float64)
            sums = lambda side, v: np.array([v[docs[i]].sum() for i in side])
            weight = np.zeros(FEATURES)
            if half:
                for _ in range(EXCHANGES):
                    a, b, n, m = degrees(left), degrees(right), len(left), len(right)
                    now = _cost(a, n) + _cost(b, m)
                    to_right = np.where(a > 0, now - _cost(np.maximum(a - 1, 0), n) - _cost(b + 1, m), 0)
                    to_left = np.where(b > 0, now - _cost(a + 1, n) - _cost(np.maximum(b - 1, 0), m), 0)
                    gain_l, gain_r = sums(left, to_right), sums(right, to_left)
                    by_l, by_r = np.argsort(-gain_l, kind="stable"), np.argsort(-gain_r, kind="stable")
                    k = min(len(left), len(right))
                    swaps = int((np.cumprod(gain_l[by_l[:k]] + gain_r[by_r[:k]] > 1e-9)).sum())
                    if not swaps:
                        break
                    left[by_l[:swaps]], right[by_r[:swaps]] = right[by_r[:swaps]], left[by_l[:swaps]].copy()
                a, b, n, m = degrees(left), degrees(right), len(left), len(right)
                weight = _cost(a + 1, n) - _cost(a, n) - _cost(b + 1, m) + _cost(b, m)
            threshold = float(np.median(sums(members, weight))) if len(members) else 0.0
            tree.append((threshold, weight.astype(np.float32)))
            below += [left, right]
        level = below
    return tree


def fitted_bisection(docs: DataFrame) -> list[tuple[float, bytes]]:
    """bisect() of about SAMPLE_DOCS documents, chosen by a hash; only their hashed terms
    meet in the task that fits, and 2^LEVELS - 1 nodes reach the driver."""

    def features(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            found = [_features(set(terms_of(t))).astype("<u2").tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], ["place", "features"])

    def fit(batches: Iterator) -> Iterator:
        import pyarrow as pa

        rows = sorted(r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        tree = bisect([np.frombuffer(f, "<u2").astype(np.int64) for _, f in rows])
        yield pa.RecordBatch.from_pydict({"node": list(range(len(tree))), "threshold": [t for t, _ in tree], "weight": [w.tobytes() for _, w in tree]})

    sample = hashed_sample(docs.where("text is not null"), SAMPLE_DOCS, "doc_id", "text")
    sampled = sample.select(F.xxhash64("doc_id", "text").alias("place"), "text").mapInArrow(features, "place long, features binary")
    nodes = sampled.repartition(1).mapInArrow(fit, "node long, threshold double, weight binary").collect()
    return [(r.threshold, bytes(r.weight)) for r in sorted(nodes)] or [(0.0, bytes(4 * FEATURES))] * (2**LEVELS - 1)


def placed(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with a term, each with n (terms with repeats), cluster (its leaf of
    the bisection) and margin (its sum of weights at the last level)."""
    tree = docs.sparkSession.sparkContext.broadcast(fitted_bisection(docs))

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        thresholds = [t for t, _ in tree.value]
        weights = [np.frombuffer(w, np.float32) for _, w in tree.value]
        for b in batches:
            kept, out = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                terms = terms_of(text)
                if not terms:
                    continue
                features, node, sum_ = _features(set(terms)), 0, 0.0
                while node < len(weights):
                    sum_ = float(weights[node][features].sum(dtype=np.float64))
                    node = 2 * node + 1 + (sum_ > thresholds[node])
                kept.append(i)
                out.append((len(terms), node - len(weights), sum_))
            if out:
                n, cluster, margin = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([*b.take(pa.array(kept)).columns, pa.array(n, pa.int64()), pa.array(cluster, pa.int32()), pa.array(margin, pa.float64())], ["doc_id", "text", "n", "cluster", "margin"])

    return docs.mapInArrow(place, "doc_id long, text binary, n long, cluster int, margin double")


def _shard_rows(shard: int, ids: list, lengths: list[int], terms: list[bytes], counts: list[int], sizes: list[int], n_docs: int, n_terms: int):
    """An index row for each term of a shard, and one of a null term with the shard's ids,
    length norms and null ids."""
    import pyarrow as pa

    norms = np.array([100 - 50 + 50 * n * n_docs // n_terms for n in lengths], np.int64)
    coded = pa.array(terms, pa.binary()).dictionary_encode()
    of = coded.indices.to_numpy()
    order = np.argsort(of, kind="stable")
    tf, place = np.array(counts, np.int64)[order], np.repeat(np.arange(len(ids)), sizes)[order]
    starts = np.searchsorted(of[order], np.arange(len(coded.dictionary) + 1)).astype(np.int32)
    bounds = np.maximum.reduceat(_impact(tf, norms[place]), starts[:-1])
    packed = lambda values: pa.Array.from_buffers(pa.binary(), len(bounds), [None, pa.py_buffer((starts * values.itemsize).astype(np.int32)), pa.py_buffer(values)])
    names = ["shard", "term", "bound", "places", "counts"]
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bounds), shard), pa.int64()), coded.dictionary, pa.array(bounds, pa.int64()), packed(place.astype("<u2")), packed(tf.astype("<u4"))], names)
    known = np.array([0 if i is None else i for i in ids], "<i8").tobytes() + norms.astype("<i8").tobytes()
    yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([None], pa.binary()), pa.array([len(ids)]), pa.array([known]), pa.array([bytes(i is None for i in ids)])], names)


def _impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1_000 * tf + 20 * norm)


def _dealt(ordered: DataFrame) -> DataFrame:
    """A written table of placed documents, dealt to tasks by their order in parts of about
    TASK_BYTES of text: neighbouring ranges of the margin (its approximate quantiles in
    each cluster) share a task, and a range that is larger, of many copies or of long
    texts, is split by row. 2^LEVELS * SLICES sizes are all that is gathered."""
    edges = [i / SLICES for i in range(1, SLICES)]
    cuts = ordered.groupBy("cluster").agg(F.percentile_approx("margin", edges).alias("cuts"))
    sliced = ordered.join(F.broadcast(cuts), "cluster").withColumn("slice", F.size(F.filter("cuts", lambda c: c < F.col("margin")))).drop("cuts")
    sizes = sliced.groupBy("cluster", "slice").agg(F.sum(F.octet_length("text")).alias("bytes"))
    before = F.sum("bytes").over(Window.orderBy("cluster", "slice")) - F.col("bytes")
    parts = sizes.select("cluster", "slice", F.floor(before / TASK_BYTES).alias("first"), F.ceil(F.col("bytes") / TASK_BYTES).alias("pieces"))
    last = parts.agg(F.max(F.col("first") + F.col("pieces"))).first()[0]
    dealt = sliced.withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(parts), ["cluster", "slice"])
    return dealt.repartitionById(int(last or 1), (F.col("first") + F.pmod("row", "pieces")).cast("int"))


class LexicalIndex:
    """The written index, and the sums over all documents that scores need."""

    def __init__(self, rows: DataFrame, n_docs: int, n_terms: int):
        self.rows, self.n_docs, self.n_terms = rows, n_docs, n_terms


def build_index(docs: DataFrame) -> LexicalIndex:
    """docs(doc_id, text, ...) -> an index of every row with a term.

    Equal texts have equal places in the order of (cluster, margin), and copies fill as
    many shards as they need. A shard's arrays are all that a task holds. Null texts and those without a term are in no ranking; null and repeated
    ids are rows of their own; other columns are ignored."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    ordered = written(placed(docs), "placed")
    n_docs, n_terms = ordered.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()

    def shards(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 32
        held: tuple[list, ...] = ([], [], [], [], [])
        ids, lengths, terms, counts, sizes = held
        for b in batches:
            for doc_id, text, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = Counter(terms_of(text))
                ids.append(doc_id)
                lengths.append(n)
                terms.extend(found.keys())
                counts.extend(found.values())
                sizes.append(len(found))
                if len(ids) == SHARD_DOCS or len(terms) >= SHARD_POSTINGS:
                    yield from _shard_rows(shard, *held, n_docs, n_terms)
                    shard += 1
                    for x in held:
                        x.clear()
        if ids:
            yield from _shard_rows(shard, *held, n_docs, n_terms)

    by = ["cluster", "margin", "doc_id"]
    rows = _dealt(ordered).sortWithinPartitions(*by).select("doc_id", "text", "n").mapInArrow(shards, INDEX)
    return LexicalIndex(written(rows, "lexical-index"), n_docs, n_terms)


def item_terms(items: DataFrame) -> DataFrame:
    """items(item_id, text) -> item (a number for each row), item_id, term, once each."""

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            found = [sorted(set(terms_of(t))) for t in b.column(2).to_pylist()]
            at = pa.array(np.repeat(np.arange(b.num_rows), list(map(len, found))))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array([t for f in found for t in f], pa.binary())], ["item", "item_id", "term"])

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id"), F.col("text").cast("string").cast("binary"))
    kind = items.schema["item_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"item long, item_id {kind}, term binary")


def _best_of_shard(ranked: int):
    def best(postings, visits):
        """All scores of a shard's documents for the items that visit it, the best kept."""
        import pyarrow as pa

        lists, ids, norms, null = {}, np.empty(0, np.int64), None, None
        for term, places, counts in zip(*(postings[c].to_pylist() for c in ("term", "places", "counts")), strict=True):
            if term is None:
                ids, norms = np.frombuffer(places, "<i8").reshape(2, -1)
                null = np.frombuffer(counts, np.bool_)
            else:
                lists[term] = (np.frombuffer(places, "<u2"), np.frombuffer(counts, "<u4").astype(np.int64))
        lists = {term: (at, _impact(tf, norms[at])) for term, (at, tf) in lists.items()}
        item, term, weight = (visits[c].to_pylist() for c in ("item", "term", "weight"))
        out = []
        for i in sorted(range(len(item)), key=item.__getitem__):
            if not out or out[-1][0] != item[i]:
                out.append((item[i], np.zeros(len(ids), np.int64)))
            if term[i] in lists:
                at, impact = lists[term[i]]
                out[-1][1][at] += weight[i] * impact
        tables = []
        for number, scores in out:
            at = np.flatnonzero(scores > 0)
            if len(at) > ranked:
                at = at[scores[at] >= np.partition(scores[at], len(at) - ranked)[len(at) - ranked]]
                at = at[np.lexsort((ids[at], null[at], -scores[at]))[:ranked]]
            tables.append((np.full(len(at), number), ids[at], null[at], scores[at]))
        item, doc_id, none, score = (np.concatenate(x) for x in zip(*tables, strict=True)) if tables else [np.empty(0, np.int64)] * 4
        return pa.Table.from_arrays([pa.array(item, pa.int64()), pa.array(doc_id, pa.int64(), mask=none.astype(bool)), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return best


def _ranked(found: DataFrame, ranked: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranked)


def search(index: LexicalIndex, items: DataFrame, ranked: int = RANKED) -> DataFrame:
    """items(item_id, text, ...) against all documents of the index: item_id, rank, doc_id,
    score of the ``ranked`` highest scores above zero, ties by ascending doc_id (null last).

    An item without a term (a null text, too) has no rows; each row of items is an item,
    whatever its id. Shards are visited in rounds; a shard is left out only when its bound
    is below the item's last ranked score, so the ranking is exact."""
    rows, stats = index.rows, (F.lit(index.n_docs), F.lit(index.n_terms))
    wanted = written(item_terms(items), "item-terms")
    mine = rows.join(wanted.select("term").distinct(), "term", "left_semi")
    bounds = written(mine.select("shard", "term", "bound", (F.octet_length("places") / 2).cast("long").alias("df")), "bounds")
    weight = F.floor(1000 * F.log((2 * stats[0] + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = bounds.groupBy("term").agg(F.sum("df").alias("df")).select("term", weight.alias("weight"))
    weighted = written(wanted.join(weights.where("weight > 0"), "term").select("item", "term", "weight"), "weighted")
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "shard")
    reach = weighted.join(bounds, "term").groupBy("item", "shard").agg(F.sum(F.col("weight") * F.col("bound")).alias("bound"))
    visits = written(reach.withColumn("visit", F.row_number().over(order)), "visits")
    most = visits.agg(F.max("visit")).first()[0] or 0
    best: DataFrame | None = None
    done, upto = 0, 1
    while done < most:
        now = visits.where(F.col("visit").between(done + 1, upto)).select("item", "shard", "bound")
        if best is not None:
            last = best.where(F.col("rank") == ranked).select("item", F.col("score").alias("least"))
            now = now.join(last, "item", "left").where("least is null or bound >= least")
        now = written(now.select("item", "shard"), "round")
        here = now.select("shard").distinct()
        postings = mine.union(rows.where("term is null").select(mine.columns)).join(here, "shard", "left_semi")
        asked = now.join(weighted, "item")
        found = postings.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(_best_of_shard(ranked), "item long, doc_id long, score long")
        so_far = [found] if best is None else [found, best.select("item", "doc_id", "score")]
        best = written(_ranked(reduce(DataFrame.union, so_far), ranked), "ranked")
        done, upto = upto, upto * (1 + WIDER)
    if best is None:
        best = items.sparkSession.createDataFrame([], "item long, doc_id long, score long, rank int")
    named = wanted.select("item", "item_id").distinct()
    return best.join(named, "item").select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch():
        index = build_index(documents(spark, sf_dir))
        return written(search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "op11", outer=True)


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
QUERIES = {"op11_lexical_search": op11_lexical_search}
SQL = {
    "op11_lexical_search": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
i AS (SELECT row_number() OVER () AS i, item_id, list_distinct({_TERMS}) AS terms FROM benchmark),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term),
n AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY r),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
m AS (SELECT r, 100 - 50 + ((50 * n * s.docs) // s.terms) AS m FROM n, s),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(s.docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term),
q AS (SELECT i, unnest(terms) AS term FROM i),
found AS (SELECT q.i, p.r, CAST(sum(w.w * ((1000000000 * tf) // (1000 * tf + 20 * m.m))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY q.i, p.r),
ranked AS (SELECT i, doc_id, score, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM found JOIN d USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked JOIN i USING (i) WHERE rank <= 50"""
}
