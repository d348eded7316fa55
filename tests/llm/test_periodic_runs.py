"""Periodic runs against the definition, tried on every stretch and period."""

import hashlib
import random
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest

from stallwright.llm import periodic_runs as pr

from ..conftest import SMALL
from . import brute


def runs_by_definition(w: list) -> list[tuple[int, int, int]]:
    """For every period the maximal stretches, then those whose smallest period it is."""
    found = []
    for p in range(1, len(w) // 3 + 1):
        s = 0
        while s + p < len(w):
            e = s + p
            while e < len(w) and w[e] == w[e - p]:
                e += 1
            stretch = w[s:e]
            if e - s >= max(24, 3 * p) and not any(all(stretch[i] == stretch[i - q] for i in range(q, len(stretch))) for q in range(1, p)):
                found.append((s, e - s, p))
            s = max(s + 1, e - p + 1)
    return sorted(found)


def row(doc_id, words: list[bytes]) -> tuple:
    runs = runs_by_definition(words)
    best = (None,) * 4
    if runs:
        s, n, p = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
        best = (s, n, p, 1000 * n // p)
    kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + n for s, n, p in runs)]
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    return (doc_id, len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def planted(doc_id, words: list) -> list:
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def key(r):
    return tuple((x is None, x) for x in r)


def found(words: list) -> list:
    ids = pr._numbers(words)
    return pr.runs_of(ids, pr.lag_matches([ids])[0])


def test_query_by_definition(spark):
    docs = [r for r in brute.documents().itertuples() if len(brute.words(r.text)) < 1_500]
    assert len(docs) > 150
    expected = {r.doc_id: row(r.doc_id, planted(r.doc_id, brute.words(r.text))) for r in docs}
    got = {r.doc_id: tuple(r) for r in pr.op12_periodic_runs(spark, SMALL).collect()}
    assert len(got) == len(brute.documents())
    assert {k: got[k] for k in expected} == expected
    assert sum(r[1] > 0 for r in got.values()) >= 10


def test_odd_rows(spark):
    expected = [row(r[0], brute.words(r[1])) for r in brute.ODD if r[1] is not brute.LONG]
    got = [tuple(r) for r in pr.periodic_runs(brute.odd(spark)).collect()]
    assert len(got) == len(brute.ODD)
    assert sorted([r for r in got if r[0] != 6], key=key) == sorted(expected, key=key)
    assert pr.periodic_runs(brute.empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(120))
def test_random_texts_with_nested_overlapping_and_touching_runs(seed):
    r = random.Random(seed)
    w = []
    while len(w) < 220:
        block = [r.randrange(r.choice([1, 2, 3, 50])) for _ in range(r.randrange(1, 14))]
        w += block * r.randrange(1, 9) + block[: r.randrange(len(block) + 1)]
        if r.random() < 0.3:
            w += w[-40:] * r.randrange(1, 4)
    w = w[:600]
    assert found(w) == runs_by_definition(w)


@pytest.mark.parametrize("seed", range(20))
def test_frequent_words_by_transforms_and_rare_ones_by_pairs(seed):
    r = np.random.default_rng(seed)
    texts = [np.minimum(r.zipf(1.5, n), 200) - 1 for n in (700, 24, 3, 1_300, 0)]
    for ids, m in zip(texts, pr.lag_matches(texts), strict=True):
        if len(ids) >= 24:
            assert m[1:].tolist() == [int((ids[d:] == ids[:-d]).sum()) for d in range(1, len(ids) // 3 + 1)]


def test_very_long_texts_take_near_linear_time():
    r = random.Random(1)
    start = time.monotonic()
    assert found(["x"] * 400_000) == [(0, 400_000, 1)]
    assert found(list(range(100_000)) * 4) == [(0, 400_000, 100_000)]
    coins = [r.randrange(2) for _ in range(200_000)]
    assert all(n >= max(24, 3 * p) for _, n, p in found(coins + list(range(2, 30)) * 3))
    assert time.monotonic() - start < 60
