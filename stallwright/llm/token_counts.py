"""Token counts of whole texts, without token ids.

A tokenizer of the tokenizers library cuts a text into pre-tokens and then works on
each alone, so equal pre-tokens have equal counts. The distinct pre-tokens of all
texts are counted once each; a text's count is the sum over its own pre-tokens'
frequencies joined to those counts. The counts of the most frequent pre-tokens go to
the tasks, as many as a bound in bytes allows; all others meet in a shuffled join.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, scratch, written

#: Bytes of pre-tokens, with ENTRY_BYTES more for each, whose counts are sent to tasks.
HEAD_BYTES, ENTRY_BYTES = 8 << 20, 16
#: A task hands on its distinct pre-tokens when it holds so many.
HELD = 250_000
#: Pre-tokens encoded in one call of the library.
CALL = 10_000
LIMIT = 1024

#: The byte-level pre-tokenizer's pattern (fixed value), and its ASCII form.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[a-zA-Z]+| ?[0-9]+| ?[^\sa-zA-Z0-9]+|\s+(?!\S)|\s+", re.A).findall
#: Blocks in which letters, numbers and white space are the same characters for the
#: pattern module and for the library, whatever their Unicode versions; a text with any
#: other character is cut by the library itself.
STABLE = "\x00-՗א-תؠ-يअ-हก-ะ -⁯₠-₿←-⯿　-〩ぁ-ゖァ-ヺ一-龥가-힣！-ﾾ"
_stable = re.compile(f"[{STABLE}]*").fullmatch


class PreTokens:
    """Cuts texts into pre-tokens and counts the tokens of one, as the library does.

    Tokens added to the model are cut out of a text first, as the library does by
    default, and count one; those with flags (stripping, whole words, normalised) that
    would change the cut are refused. Truncation and padding are off."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for each core
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        spec = json.loads(self.tok.to_str())
        pre = spec["pre_tokenizer"] or {}
        self.byte_level = not spec["normalizer"] and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or (t["normalized"] and spec["normalizer"]) for t in spec["added_tokens"]):
            raise ValueError("tokens added with flags aren't supported")
        self.added = {t["content"] for t in spec["added_tokens"]}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(map(re.escape, longest_first))})").split if self.added else lambda text: [text]
        self.any = regex.compile(_BYTE_LEVEL).findall

    def __call__(self, text: str) -> list[str]:
        if not self.added or not any(t in text for t in self.added):
            return self._between(text)
        return [p for part in self.cut(text) for p in ([part] if part in self.added else self._between(part))]

    def _between(self, text: str) -> list[str]:
        if not self.byte_level:
            if self.tok.normalizer:
                text = self.tok.normalizer.normalize_str(text)
            return [p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(text)] if self.tok.pre_tokenizer else [text]
        if text.isascii():
            return _ASCII(text)
        if _stable(text):
            return self.any(text)
        return [text[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)]

    def counts(self, pieces: list[str]) -> list[int]:
        """Tokens of each pre-token; one of a byte-level tokenizer is cut no further when
        it stands alone, so it's encoded as a text."""
        if self.byte_level:
            return [len(e) for e in self.tok.encode_batch_fast(pieces, add_special_tokens=False)]
        return [1 if p in self.added else len(self.tok.model.tokenize(p)) for p in pieces]


@cache
def pre_tokens(path: str) -> PreTokens:
    return PreTokens(path)


def distinct_pre_tokens(texts: DataFrame, path: str) -> DataFrame:
    """texts(text) -> piece, docs (in how many texts it is), n_tokens; one row each."""

    def found(batches: Iterator) -> Iterator:
        import pyarrow as pa

        cut, seen = pre_tokens(path), Counter()

        def held():
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["piece", "docs"])

        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update(set(cut(text)))
                if len(seen) > HELD:
                    yield held()
                    seen.clear()
        if seen:
            yield held()

    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        cut = pre_tokens(path)
        for b in batches:
            for at in range(0, b.num_rows, CALL):
                some = b.slice(at, CALL)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(cut.counts(some.column(0).to_pylist()), pa.int64())], ["piece", "docs", "n_tokens"])

    pieces = texts.mapInArrow(found, "piece string, docs long").groupBy("piece").agg(F.sum("docs").alias("docs"))
    return pieces.mapInArrow(counted, "piece string, docs long, n_tokens long")


def frequent(counts: DataFrame, room: int = HEAD_BYTES) -> Column:
    """The pre-tokens in at least 2^k texts, k the least for which they fit into the room;
    only one row for each power of two reaches the driver."""
    sizes = counts.groupBy(F.floor(F.log2("docs")).alias("k")).agg(F.sum(F.octet_length("piece") + ENTRY_BYTES).alias("size")).collect()
    least = 62
    for r in sorted(sizes, key=lambda r: -r.k):
        room -= r["size"]
        if room < 0:
            break
        least = r.k
    return F.col("docs") >= F.lit(1 << least)


def token_counts(docs: DataFrame, tokenizer: str, head_bytes: int = HEAD_BYTES) -> DataFrame:
    """docs(doc_id, text, ...) -> one row for each of its rows: doc_id, n_bytes (UTF-8),
    n_tokens. ``tokenizer`` is the path of a JSON file of the tokenizers library.

    A null text is an empty one, with no bytes and no tokens. Rows with equal or null
    ids stay apart; an empty table gives none; other columns are ignored. Texts are read
    twice, whole; a row with its pre-tokens that aren't sent to tasks is written once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    with scratch():
        counts = written(distinct_pre_tokens(docs.where("n_bytes > 0").select("text"), tokenizer), "pre-tokens")
        head = counts.where(frequent(counts, head_bytes)).select("piece", "n_tokens").toArrow()  # at most head_bytes
        known = docs.sparkSession.sparkContext.broadcast(dict(zip(head["piece"].to_pylist(), head["n_tokens"].to_pylist(), strict=True)))

        def frequencies(batches: Iterator) -> Iterator:
            """A row for each text, with the tokens of its frequent pre-tokens, and a row for
            each of its other pre-tokens."""
            import pyarrow as pa
            from pyspark import TaskContext

            cut, n_of, row = pre_tokens(tokenizer), known.value.get, TaskContext.get().partitionId() << 40
            names = ["row", "doc_id", "n_bytes", "n_tokens", "piece", "freq"]
            for b in batches:
                ids, sizes, rows, totals, of, pieces, freqs = b.column(0), b.column(2), [], [], [], [], []
                for text in b.column(1).to_pylist():
                    n, row = 0, row + 1
                    for p, f in Counter(cut(text)).items():
                        if k := n_of(p):
                            n += k * f
                        else:
                            of.append(row)
                            pieces.append(p)
                            freqs.append(f)
                    rows.append(row)
                    totals.append(n)
                none = pa.nulls(len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), ids, sizes, pa.array(totals, pa.int64()), pa.nulls(len(rows), pa.string()), none], names)
                none = pa.nulls(len(of), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), none, none, none, pa.array(pieces, pa.string()), pa.array(freqs, pa.int64())], names)

        rows = written(docs.mapInArrow(frequencies, "row long, doc_id long, n_bytes long, n_tokens long, piece string, freq long"), "frequencies")
        texts = rows.where("piece is null").select("row", "doc_id", "n_bytes", "n_tokens")
        rest = rows.where("piece is not null").select("row", "piece", "freq").join(counts.select("piece", F.col("n_tokens").alias("n")), "piece")
        rest = rest.groupBy("row").agg(F.sum(F.col("freq") * F.col("n")).alias("n"))
        counted = texts.join(rest, "row", "left").select("doc_id", "n_bytes", (F.col("n_tokens") + F.coalesce("n", F.lit(0))).alias("n_tokens"))
        return written(counted, "token-counts", outer=True)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)


QUERIES = {"op13_token_counts": op13_token_counts}
SQL: dict[str, str] = {}
