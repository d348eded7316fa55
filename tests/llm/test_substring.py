import hashlib

from stallwright.llm import substring

from ..conftest import SMALL
from .brute import ODD, PASSAGE, documents, empty, odd, words


def slow(rows, window):
    first = {}
    for i, t in rows:
        w = words(t)
        if i is not None:
            for j in range(len(w) - window + 1):
                k = tuple(w[j : j + window])
                first[k] = min(first.get(k, i), i)
    for i, t in rows:
        w = words(t)
        keep = [True] * len(w)
        for j in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[j : j + window])] < i:
                keep[j : j + window] = [False] * window
        kept = b" ".join(x for x, k in zip(w, keep) if k)
        yield i, len(w), keep.count(False), hashlib.sha256(kept).hexdigest()


def key(r):
    return tuple((x is not None, x or 0) for x in r)


def check(spark, rows, window=50, seed=13, bits=64):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring.without_repeats(df, window, seed, bits).drop("kept_text").collect()
    assert sorted(map(tuple, got), key=key) == sorted(slow(rows, window), key=key)


def test_query_against_brute_force(spark):
    d = documents()
    got = sorted(tuple(r) for r in substring.op9_substring_dedup(spark, SMALL).collect())
    assert got == sorted(slow(list(zip(d.doc_id, d.text)), 50))
    assert sum(r[2] for r in got) > 0


def test_repeats_inside_low_variety_and_overlaps(spark):
    a = " ".join(f"a{i % 7}" for i in range(300))
    rows = [(5, a), (3, "x " * 120), (4, "x " * 60 + "y"), (9, f"p q {a} r"), (2, " ".join(f"u{i}" for i in range(80))), (8, " ".join(f"u{i}" for i in range(20, 75))), (7, f"{PASSAGE} mid {PASSAGE}"), (6, f"z {PASSAGE}")]
    check(spark, rows)
    check(spark, rows, window=9, seed=4)
    check(spark, rows, window=5, seed=5)


def test_awkward_rows(spark):
    rows = [(i, t) for i, t, *_ in ODD]
    got = substring.without_repeats(odd(spark)).drop("kept_text").collect()
    assert sorted(map(tuple, got), key=key) == sorted(slow(rows, 50), key=key)
    assert substring.without_repeats(empty(spark)).count() == 0
    check(spark, [(None, PASSAGE), (1, PASSAGE), (1, PASSAGE + " more"), (2, None)])


def test_colliding_hashes_stay_exact(spark):
    """Runs meet under hashes of 8 (4, 0) bits only: words at the coordinates decide."""
    import random

    rng = random.Random(3)
    parts = [" ".join(f"p{k}w{rng.randrange(40)}" for _ in range(rng.choice([8, 15, 40]))) for k in range(9)]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(1, 7)))) for i in range(60)]
    for bits in (8, 4, 1):
        check(spark, rows, 9, 4, bits)
