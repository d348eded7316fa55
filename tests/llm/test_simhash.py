import itertools
import math
import random

import numpy as np
import xxhash

from stallwright.llm import simhash
from stallwright.llm.components import connected_components

from ..conftest import SMALL
from .brute import closure, documents, empty, odd, words


def slow_fingerprint(text, k=3):
    w = words(text, True)
    shingles = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_query_against_brute_force(spark):
    d = documents()
    fps = {i: slow_fingerprint(t) for i, t in zip(d.doc_id, d.text)}
    groups = closure(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    got = simhash.op2_simhash_neardup(spark, SMALL).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{fps[i]:016x}", groups[i]) for i in fps}
    assert len(got) == len(fps)


def test_awkward_rows(spark):
    rows = simhash.near_duplicate_groups(odd(spark)).collect()
    assert len(rows) == 12
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.fingerprint, r.component_id))
    assert {by[i][0] for i in (3, 4, 5)} == {("0" * 16, 3)}
    assert by[1][0][1] == by[2][0][1] == 1
    assert len(by[8]) == 2 and len(set(by[8])) == 1
    kept = simhash.keep_one(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 6, 7, 8, 9, 10]
    assert simhash.near_duplicate_groups(empty(spark)).count() == 0
    assert simhash.keep_one(empty(spark)).count() == 0


def test_no_pair_is_lost(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(6)}
    want = {(a, b) for a, b in itertools.permutations(fps, 2) if (a ^ b).bit_count() <= 3}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x), i) for i, x in enumerate(sorted(fps))], "fp long, node long")
    order = sorted(fps)
    got = {(order[r.a], order[r.b]) for r in simhash.close_pairs(df).collect()}
    assert {frozenset(p) for p in got} == {frozenset(p) for p in want}


def test_thresholds_follow_the_general_pigeonhole():
    rng = np.random.default_rng(1)
    x = (rng.random((500, 64)) < 0.5).astype(float)
    x[:, 1] = x[:, 0]
    both = x.T @ x
    for n in (500, 10**6, 10**10):
        for distance in (1, 3, 6):
            parts = simhash.plan(n, both, distance)
            covered = sum(t + 1 for _, t in parts)
            assert covered == distance + 1  # sum of (t + 1) over probed partitions
    groups = simhash.group_bits(500, both, 4)
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert any({0, 1} <= set(g) for g in groups)  # correlated bits share a partition
    assert math.isclose(simhash.close_share(500, both, list(range(64)), 64), 1, abs_tol=1e-6)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 160)]
    df = spark.createDataFrame([*chain, *star, (5, 5), (None, 3), (200, 201), (201, 200)], "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
    assert connected_components(df.limit(0)).count() == 0


def test_components_of_few_and_many_edges(spark, monkeypatch):
    import random

    from stallwright.llm import components

    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100, i) for i in range(200, 230)] + [(7, 7), (None, 3)] + [(i, i + 1) for i in range(300, 330)]
    want = closure(sorted({x for e in edges if None not in e for x in e}), lambda a, b: (a, b) in edges or (b, a) in edges)
    linked = {x for a, b in edges if a != b and None not in (a, b) for x in (a, b)}
    for few in (0, 200_000):
        monkeypatch.setattr(components, "FEW_EDGES", few)
        got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {n: c for n, c in want.items() if n in linked}
