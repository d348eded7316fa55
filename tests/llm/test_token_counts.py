"""Token counts against the tokenizers library itself."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stallwright.llm import token_counts as tc

from ..conftest import SMALL
from . import brute

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library(path=PATH):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


def key(r):
    return tuple((x is None, x) for x in r)


def test_query_counts_what_the_library_counts(spark):
    n = library()
    expected = [(r.doc_id, len((r.text or "").encode()), n(r.text), n(r.text) > 1024) for r in brute.documents().itertuples()]
    got = tc.op13_token_counts(spark, SMALL).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    assert sorted(map(tuple, got)) == sorted(expected)


@pytest.mark.parametrize("room", [0, 300, tc.HEAD_BYTES])
def test_odd_rows_and_any_share_sent_to_tasks(spark, room):
    n = library()
    got = tc.token_counts(brute.odd(spark), PATH, room).collect()
    assert sorted(map(tuple, got), key=key) == sorted([(r[0], len((r[1] or "").encode()), n(r[1])) for r in brute.ODD], key=key)
    assert tc.token_counts(brute.empty(spark), PATH, room).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_texts_with_special_strings_new_letters_and_spaces(name):
    path = public_tokenizers.path(name)
    cut, n = tc.PreTokens(path), library(path)
    for text in ["a<|endoftext|>b <|endoftext|> 's", "<|endoftext|><|endoftext|>", "it's they'LL  x\n\n y\t  z　", "՘\U00010940 Ⱟ1²½", "日本語 テスト한국어 ١٢٣ é", "\x1c a\x1f\x85b", "   ", "\r\n", "Iİß Ä"]:
        assert sum(cut.counts(cut(text))) == n(text), text


def test_pattern_agrees_with_the_library_on_every_stable_character():
    cut = tc.PreTokens(PATH)
    stable = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and tc._stable(chr(c))]
    for at in range(0, len(stable), 1_000):
        text = "".join(f"a{c}a 1{c}1 !{c}! {c} " for c in stable[at : at + 1_000])
        expected = [text[a:b] for _, (a, b) in cut.tok.pre_tokenizer.pre_tokenize_str(text)]
        assert cut.any(text) == expected
        if text.isascii():
            assert tc._ASCII(text) == expected
    text = "".join(f"a{chr(c)}a 1{chr(c)}1 !{chr(c)}! {chr(c)} " for c in range(128))
    assert tc._ASCII(text) == cut.any(text)
