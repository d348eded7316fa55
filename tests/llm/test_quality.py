from collections import Counter

import pytest

from stallwright.llm import quality

from ..conftest import SMALL
from .brute import ODD, documents, empty, odd, words


def slow(text):
    w = words(text)
    text = text or ""
    chars = sum(len(x.decode()) for x in w)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(windows)
    covered = {j for i, x in enumerate(windows) if count[x] > 1 for j in range(i, i + 3)}
    return len(w), chars, sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_query_against_brute_force(spark):
    got = {r.doc_id: r for r in quality.op7_quality_rules(spark, SMALL).collect()}
    for i, t in zip(*(documents()[c] for c in ("doc_id", "text"))):
        r, want = got[i], slow(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_fertility_against_the_tokenizer():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    text = "Plain words here, 日本 \U0001f9ff words"
    ids = sp.encode(text)
    n, cpt, share, _ = quality.Fertility(path).measure(words(text), 30)
    assert n == len(ids)
    assert share == pytest.approx(sum(map(sp.is_byte, ids)) / len(ids))
    assert cpt == 30 / n


def test_clean_documents_are_kept(spark):
    import pandas as pd

    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet").set_index("doc_id")
    got = quality.op7_quality_rules(spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id").join(labels, how="inner")
    clean = got[(got.quality == 1) & ~got.base_failed]
    assert clean.kept.mean() > 0.99
    assert got[got.quality == 0].kept.mean() < clean.kept.mean() - 0.5


def test_awkward_rows(spark):
    rows = quality.quality_rules(odd(spark)).collect()
    assert len(rows) == len(ODD)
    assert all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == slow(t) for r, (_, t, *_) in zip(rows, ODD, strict=True))
    assert not any(r.kept for r in rows if r.doc_id in (3, 4, 5))
    kept = quality.reject(odd(spark))
    assert kept.columns == odd(spark).columns
    assert [r.doc_id for r in kept.collect()] == [r.doc_id for r in rows if r.kept]
    assert quality.quality_rules(empty(spark)).count() == quality.reject(empty(spark)).count() == 0
    assert quality.quality_rules(odd(spark).select("doc_id", "text")).count() == len(ODD)
    assert quality.band_of(None, "Ячмень и рожь") == "cyrillic" and quality.band_of("zz", "plain") == "latin" and quality.band_of("", "日本語") == "other"
