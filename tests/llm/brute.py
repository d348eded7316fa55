"""Plain Python versions of the operators, and fixtures with every awkward case."""

from __future__ import annotations

import pandas as pd

from ..conftest import SMALL

LONG = " ".join(f"w{i % 977} x{i % 31}" for i in range(6_000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))
#: Nulls, empty and blank texts, ties, repeated rows, one very long text.
ODD = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "a"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "a"),
    (3, None, "en", "a"),
    (4, "", None, None),
    (5, " \t\n ", "xx", "b"),
    (6, LONG, "en", "a"),
    (7, f"intro one two {PASSAGE} outro", "en", "b"),
    (8, f"{PASSAGE} other end. Ünïcödé 😀 +1 (706) 555-3138 a@b.example 10.0.0.1", "fr", "b"),
    (8, f"{PASSAGE} other end. Ünïcödé 😀 +1 (706) 555-3138 a@b.example 10.0.0.1", "fr", "b"),
    (9, "one", "de", "c"),
    (10, "one two", "de", None),
    (None, "no id but some words here", None, "c"),
]


def odd(spark):
    """ODD as documents, with extra columns whose names clash with inner ones."""
    rows = [(*r, None if r[1] is None else len(r[1]), 1, "x", 2.0) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, pos int, h string, rid double")


def empty(spark):
    return odd(spark).limit(0)


def documents() -> pd.DataFrame:
    return pd.read_parquet(f"{SMALL}/documents.parquet").sort_values("doc_id")


def words(text: str | None, lower: bool = False) -> list[bytes]:
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def closure(nodes: list, linked) -> dict:
    """node -> smallest node reachable over pairs for which linked(a, b)."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}
