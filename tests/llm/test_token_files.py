import sys
import zlib

import numpy as np
from tokenizers import Tokenizer

from stallwright.llm import token_files as tf
from stallwright.llm.common import fresh_path

from ..conftest import SMALL
from .brute import ODD, documents, empty, odd

TOK = Tokenizer.from_file(tf.tokenizer_path("byte_bpe_50k.json"))


def slow(rows):
    start = 0
    for doc_id, text in rows:
        ids = np.array([*TOK.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        yield doc_id, start, len(ids), zlib.crc32(ids.tobytes())
        start += len(ids)


def test_query_against_the_tokenizer(spark):
    d = documents()
    got = sorted(tuple(r) for r in tf.op3_token_output(spark, SMALL).collect())
    assert got == list(slow(zip(d.doc_id, d.text)))


def test_pieces_equal_whole_texts():
    enc = tf.PieceEncoder(tf.tokenizer_path("byte_bpe_50k.json"))
    texts = ["", " ", "a", " a", "a ", "a  b", "a\n\nb", "a \nb", "a\nb c", "a\tb", "x<|endoftext|> y <|endoftext|>", "it's we'll 12 3,4", "é ü 😀 日本", "a\x1cb c", "a\x0bb", "\nq", "q\n", "a\r\nb"]
    for _ in range(2):  # with an empty and with a filled cache
        for t in texts:
            assert np.frombuffer(enc.encode(t), "<u4").tolist() == TOK.encode(t, add_special_tokens=False).ids, repr(t)


def test_awkward_rows_and_random_access(spark):
    manifest = tf.write_shards(odd(spark), fresh_path(spark, "t"))
    got = tf.read_shards(manifest).orderBy("start").collect()
    rows = sorted(((i, t) for i, t, *_ in ODD), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [tuple(r) for r in got] == list(slow(rows))
    seen = []
    for r in manifest.orderBy("shard").collect():
        shard = tf.Shard(r.uri)
        for i in reversed(range(len(shard.index))):
            assert shard.document(i).tolist() == [*list(shard.documents())[i][1]]
        seen += [x for x, _ in shard.documents()]
    assert len(seen) == len(ODD)
    assert tf.token_output(empty(spark)).count() == 0


def test_each_piece_is_looked_up_once_and_comes_back(monkeypatch):
    """Many texts together, the cache too small for them: the ids are the library's,
    and pieces met again come back from the older half."""
    monkeypatch.setattr(tf, "CACHE_PIECES", 400)
    enc = tf.PieceEncoder(tf.tokenizer_path("byte_bpe_50k.json"))
    learned, real = [], enc._learn
    monkeypatch.setattr(enc, "_learn", lambda new: learned.extend(new) or real(new))
    odd_texts = ["", "\n", " \n", "a\x00b c", "\x01", "x <|endoftext|> y", "a b c", "long" * 30 + " it", "  ", "z \u0085"]
    frequent = "the words of all texts, again and again! "
    for run in range(8):
        texts = [frequent + " ".join(f"w{run}x{i}." for i in range(n)) for n in range(40)] + odd_texts
        for t, ids in zip(texts, enc.encode_all(texts), strict=True):
            assert np.frombuffer(ids, enc.ids).tolist() == TOK.encode(t, add_special_tokens=False).ids, repr(t)
        assert len(enc.pieces) + len(enc.older) < 1_000
    assert learned.count("words") == 1 and learned.count("again!") == 1


def test_bytes_of_the_cache_are_bounded():
    """Words that never come again filled the cache up to a million: two workers with
    such caches outgrew an executor beside its JVM."""
    enc, most = tf.PieceEncoder(tf.tokenizer_path("byte_bpe_50k.json")), 0
    for run in range(14):
        enc.encode_all([" ".join(f"w{run}x{i}" for i in range(40_000))])
        halves = (enc.pieces, enc.older)
        most = max(most, sum(map(sys.getsizeof, halves)) + sum(sys.getsizeof(k) + sys.getsizeof(v) for half in halves for k, v in half.items()))
    assert most < 60e6


def test_words_stay_in_few_bytes(monkeypatch):
    """300,000 words are all known when they come again (they went through the library again
    before), in 45 bytes each at most (130 before)."""
    enc, learned = tf.PieceEncoder(tf.tokenizer_path("byte_bpe_50k.json")), []
    real = enc._learn
    monkeypatch.setattr(enc, "_learn", lambda new: learned.extend(new) or real(new))
    runs = [[" ".join(f"w{i}." for i in range(at, at + 30_000))] for at in range(0, 300_000, 30_000)]
    first = [enc.encode_all(texts) for texts in runs]
    assert len(learned) >= 300_000
    assert sys.getsizeof(enc.pieces) + sys.getsizeof(enc.older) < 45 * 300_000
    learned.clear()
    assert [enc.encode_all(texts) for texts in runs] == first and not learned


def test_latin_letters_equal_whole_texts():
    enc = tf.PieceEncoder(tf.tokenizer_path("byte_bpe_50k.json"))
    chars = [chr(c) for c in range(0x80, 0x260)]
    texts = [f"a {c} {c}b, b{c}! a{c}b. {c}{c}?! \n{c}a; é{c}# {c}1" for c in chars] + ["".join(chars), " ".join(chars)]
    for t, ids in zip(texts, enc.encode_all(texts), strict=True):
        assert np.frombuffer(ids, enc.ids).tolist() == TOK.encode(t, add_special_tokens=False).ids, repr(t)
