"""Quality rules from tokeniser fertility.

A public sentence-piece vocabulary with byte fallback measures each text: letters
a token, the share of byte-fallback tokens and the entropy of the token
distribution. Texts outside the bands of their language (of their script where the
language is unknown) are rejected, after a base rule on length and repetition.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, words_of, worker_model


@dataclass(frozen=True)
class Band:
    """Accepted ranges. Entropy is in bits a token, as a share of the largest that
    a text of so many tokens can have (at most that of ``PEAK_BITS``)."""

    low_chars: float
    high_chars: float
    byte_share: float
    low_entropy: float


#: A text's entropy is held against log2 of its tokens, and against this at most.
PEAK_BITS = 7.5
#: By language; then by script of most letters; then for all others.
BANDS = {
    "en": Band(1.75, 4.8, 0.02, 0.765),
    "fr": Band(1.60, 4.8, 0.02, 0.750),
    "de": Band(1.75, 4.8, 0.02, 0.755),
    "es": Band(1.70, 4.8, 0.02, 0.750),
    "latin": Band(1.5, 5.0, 0.05, 0.70),
    "cyrillic": Band(1.5, 5.0, 0.10, 0.60),
    "other": Band(0.4, 6.0, 0.60, 0.50),
}
#: Bounds of each worker's word cache; longer words are measured each time.
CACHE_WORDS, CACHE_WORD_BYTES = 300_000, 48
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_tokens long, chars_per_token double, byte_share double, token_entropy double, band string, kept boolean"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number = dict(zip(known := dict.fromkeys(words), range(len(known)), strict=True))
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    pairs = ids[:-1] * len(known) + ids[1:]
    if len(known) >= 1 << 20:  # three numbers no longer fit in 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    codes = pairs[:-1] * len(known) + ids[2:]
    order = np.sort(codes)
    same = order[1:] == order[:-1]
    if not same.any():
        return 0
    twice = np.isin(codes, order[1:][same])
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i : i + len(twice)] |= twice
    return int(covered.sum())


def base_measures(text: str | None) -> tuple[list[bytes], int, int, int, int]:
    """(words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text."""
    text = text or ""
    words = words_of(text)
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    return words, chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


class Fertility:
    """Token statistics of words under a sentence-piece vocabulary, word by word
    (its pieces don't cross white space), with a bounded cache."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        #: At most 65,536 ids: they are kept as 16-bit integers.
        self.byte = np.array([self.sp.is_byte(i) for i in range(self.sp.vocab_size())])
        self.cache: dict[bytes, bytes] = {}

    def ids(self, words: list[bytes]) -> np.ndarray:
        known = self.cache
        if len(known) > CACHE_WORDS:
            known.clear()
        if new := [w for w in set(words) if w not in known]:
            found = self.sp.encode([w.decode("utf-8", "replace") for w in new], num_threads=1)
            known.update((w, array("H", x).tobytes()) for w, x in zip(new, found, strict=True))
        ids = np.frombuffer(b"".join(map(known.__getitem__, words)), np.uint16)
        for w in new:
            if len(w) > CACHE_WORD_BYTES:
                del known[w]
        return ids

    def measure(self, words: list[bytes], chars: int) -> tuple[int, float, float, float]:
        """(tokens, characters a token, byte share, entropy share)"""
        ids = self.ids(words)
        n = len(ids)
        if n < 2:
            return n, chars / max(n, 1), 0.0, 1.0
        ids = np.sort(ids)
        ends = np.flatnonzero(np.append(ids[1:] != ids[:-1], True))
        p = np.diff(ends, prepend=-1) / n
        bits = float(-(p * np.log2(p)).sum())
        return n, chars / n, float(self.byte[ids].mean()), bits / min(math.log2(n), PEAK_BITS)


_LATIN, _CYRILLIC = re.compile("[A-Za-zÀ-ɏ]"), re.compile("[Ѐ-ӿ]")


def fertility_of(path: str) -> Fertility:
    return worker_model(Fertility, path)


def band_of(lang: str | None, text: str) -> str:
    if lang in BANDS:
        return lang
    latin, cyrillic = len(_LATIN.findall(text)), len(_CYRILLIC.findall(text))
    if 2 * max(latin, cyrillic) <= sum(map(str.isalpha, text)):
        return "other"
    return "latin" if latin >= cyrillic else "cyrillic"


def judge(fertility: Fertility, bands: dict[str, Band], text: str | None, lang: str | None) -> tuple:
    """The columns of COLUMNS after doc_id for one text."""
    words, chars, symbols, dup_lines, repeat = base_measures(text)
    n = len(words)
    failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
    tokens, cpt, byte_share, entropy = fertility.measure(words, chars)
    name = band_of(lang, text or "")
    b = bands[name]
    kept = not failed and b.low_chars <= cpt <= b.high_chars and byte_share <= b.byte_share and entropy >= b.low_entropy
    return n, chars, symbols, dup_lines, repeat, failed, tokens, cpt, byte_share, entropy, name, kept


def quality_rules(docs: DataFrame, vocabulary: str | None = None, bands: dict[str, Band] | None = None) -> DataFrame:
    """docs(doc_id, text[, lang], ...) -> per row the base measures, the fertility
    measures, the band used and ``kept``.

    A null text counts as empty: no words, base_failed, not kept. A null or unknown
    language takes the band of the script. Repeated rows are judged each; an empty
    table gives an empty result; other columns are ignored. Texts are measured whole."""
    bands = bands or BANDS

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import public_tokenizers

        fertility = fertility_of(vocabulary or public_tokenizers.path("piece_bpe_32k.model"))
        names = [c.split()[0] for c in COLUMNS.split(", ")][1:]
        for b in batches:
            rows = [judge(fertility, bands, t.as_py(), lang.as_py()) for t, lang in zip(b.column(1), b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x) for x in zip(*rows, strict=True))] if rows else [pa.array([])] * (len(names) + 1), ["doc_id", *names])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), lang.alias("lang")).mapInArrow(run, COLUMNS)


def reject(docs: DataFrame, bands: dict[str, Band] | None = None) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns; the verdict is
    reached while the rows pass, so no text is shuffled."""
    names, bands = docs.columns, bands or BANDS
    text, lang = names.index("text"), names.index("lang") if "lang" in names else None

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import public_tokenizers

        fertility = fertility_of(public_tokenizers.path("piece_bpe_32k.model"))
        for b in batches:
            langs = [None] * b.num_rows if lang is None else b.column(lang).to_pylist()
            yield b.filter(pa.array([judge(fertility, bands, t.as_py(), x)[-1] for t, x in zip(b.column(text), langs, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


QUERIES = {"op7_quality_rules": op7_quality_rules}
SQL: dict[str, str] = {}
