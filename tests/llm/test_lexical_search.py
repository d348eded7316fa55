"""Ranked search against plain scoring of every document."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from stallwright.llm import lexical_search as ls

from ..conftest import SMALL
from ..oracle import assert_same
from . import brute

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, ranked=50):
    docs = [(d, Counter(terms(t))) for d, t in docs]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    n_docs, n_terms = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for d, c, n in docs:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item_id, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(scores)[:ranked], 1)]
    return out


def key(r):
    return tuple((x is None, x) for x in r)


def test_query_matches_its_sql(spark):
    assert_same(ls.op11_lexical_search(spark, SMALL), ls.SQL["op11_lexical_search"], SMALL)


def test_terms():
    assert ls.terms_of("Ab-c_D9 É x y\x00z\x85".encode()) == [t.encode() for t in terms("Ab-c_D9 É x y\x00z\x85")]
    assert ls.terms_of(None) == ls.terms_of(b" .,\n") == []


@pytest.mark.parametrize(("shard_docs", "ranked", "wider"), [(4_096, 50, 8), (7, 5, 1), (1, 3, 2), (3, 1, 1)])
def test_small_shards_many_rounds_and_ties(spark, monkeypatch, shard_docs, ranked, wider):
    monkeypatch.setattr(ls, "SHARD_DOCS", shard_docs)
    monkeypatch.setattr(ls, "WIDER", wider)
    monkeypatch.setattr(ls, "TASK_BYTES", 3_000 * shard_docs)  # ranges share a task, or are split
    frame = brute.documents().head(150)
    docs = [(int(d), t) for d, t in zip(frame.doc_id, frame.text, strict=True)] + [(r[0], r[1]) for r in brute.ODD]
    docs += [(1_000 + i, docs[3][1]) for i in range(40)] + [(None, docs[3][1])]  # ties over many shards
    texts = frame.text.tolist()
    items = [(1, " ".join(texts[3].split()[:20])), (2, None), (3, "Alpha beta MU"), (3, "passage7 the"), (None, " ".join(texts[9].split()[5:30])), (5, "unheard-ofs"), (6, "")]
    table = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, shard int, term string")
    queries = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, item int")
    got = ls.search(ls.build_index(table), queries, ranked).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_search(docs, items, ranked), key=key)


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    assert ls.search(ls.build_index(brute.empty(spark)), items).count() == 0
    assert ls.search(ls.build_index(brute.odd(spark)), items.limit(0)).count() == 0


def test_bisection_puts_texts_of_one_vocabulary_together():
    r = np.random.default_rng(0)
    kinds = r.permutation(np.repeat(np.arange(4), 64))
    docs = [np.unique(r.integers(0, 300, 60) + 400 * k) for k in kinds]
    tree = ls.bisect(docs)
    cluster = []
    for d in docs:
        node = 0
        while node < 3:  # two levels
            node = 2 * node + 1 + (tree[node][1][d].sum(dtype=np.float64) > tree[node][0])
        cluster.append(node)
    together = sum(Counter(k for k, c in zip(kinds, cluster, strict=True) if c == n).most_common(1)[0][1] for n in set(cluster))
    assert len(tree) == 2**ls.LEVELS - 1
    assert together > 0.9 * len(docs)
