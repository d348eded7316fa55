"""Token ids in binary shards.

A shard holds one zstandard frame for each document, all compressed with one shared
dictionary trained on serialised id arrays, then an index of offsets, so that a short
document is read without its neighbours:

    b"TOKZ1\\n" | frames ... | index: n x (doc_id i64, offset u64, bytes u64, ids u64)
    | n u64 | index offset u64 | id width u8 | sha-256 of the dictionary (32 bytes) | b"TOKZ"

The dictionary lies beside the shards under its hash. A frame holds little-endian
ids of 16 bits where the vocabulary allows, else 32.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh_path, hashed_sample, open_in, open_out, worker_model, written

MAGIC, TAIL = b"TOKZ1\n", b"TOKZ"
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("bytes", "<u8"), ("ids", "<u8")])
FOOTER = "<QQB32s4s"
END_ID = 2
#: The dictionary is trained on about SAMPLE_DOCS texts, chosen by a hash, but for those
#: of more than SAMPLE_CHARS characters. Rows are counted without their texts.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 1_000, 20_000, 65_536
LEVEL = 3
#: Bounds of each worker's cache of encoded pieces (their number, and a piece's length).
#: A piece takes about 30 bytes.
CACHE_PIECES, CACHE_PIECE_CHARS = 320_000, 40
#: Texts are encoded together up to so many characters.
CHUNK_CHARS = 1 << 21
#: New words go through the library in runs of so many.
RUN_WORDS = 20
#: Marks that a word is cut from; they are no letters, digits or white space.
MARKS = ".,;:!?|#*$%&"
#: Inside the encoder: marks that follow a word, a word that follows no space.
AFTER, BARE = "\x00", "\x01"
_UNSPACED = (AFTER, BARE, "\n")
_OWN_MARKS = re.compile(f"[{AFTER}{BARE}]").search
#: The byte-level alphabet: its space, and what it makes of the Latin letters beyond ASCII.
SPACE = "\u0120"
LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+"
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = dict.fromkeys(_PRINTED) | {b: 256 + i for i, b in enumerate(sorted(set(range(256)).difference(_PRINTED)))}
_IN_BYTES = {c: "".join(chr(_BYTES[b] or b) for b in chr(c).encode()) for c in range(0xC0, 0x250)}


class Pieces:
    """Different pieces, an Arrow array; how many ids each has (-1: not to be encoded
    alone); the ids of all end to end."""

    def __init__(self, text, size: np.ndarray, ids: np.ndarray):
        self.text, self.size, self.ids = text, size, ids

    def __len__(self) -> int:
        return len(self.text)

    def __sizeof__(self) -> int:
        return self.text.get_total_buffer_size() + self.size.nbytes + self.ids.nbytes

    def __add__(self, other: Pieces) -> Pieces:
        import pyarrow as pa

        return Pieces(pa.concat_arrays([self.text, other.text]), np.append(self.size, other.size), np.append(self.ids, other.ids))

    def starts(self) -> np.ndarray:
        n = np.maximum(self.size, 0)
        return np.cumsum(n) - n

    def take(self, at: np.ndarray) -> Pieces:
        return Pieces(self.text.take(at), self.size[at], self.ids[_spans(self.starts()[at], self.size[at])])

    def items(self) -> Iterator[tuple[str, bytes | None]]:
        for text, at, n in zip(self.text.to_pylist(), self.starts().tolist(), self.size.tolist(), strict=True):
            yield text, None if n < 0 else self.ids[at : at + n].tobytes()


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many as its size says, end to end."""
    sizes = np.maximum(sizes, 0)
    ends = np.cumsum(sizes)
    numbers = np.repeat((starts - ends + sizes).astype(np.int32), sizes)  # of one run's ids
    numbers += np.arange(len(numbers), dtype=np.int32)
    return numbers


class PieceEncoder:
    """Ids of whole texts under a byte-level BPE of the tokenizers library.

    Its pre-tokenizer never joins letters, digits or marks across white space, and a
    single space or line end goes with what follows it or stands alone, so a text
    falls apart before each single space or line end between two other characters; and
    a word falls apart from the marks after its last letter. The pieces of many texts
    that are new go through the library together and stay in a bounded cache: those of
    the latest run, then older ones, the last met first.
    A text with other white space, or with a token added to the model, is encoded whole."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for each core
        import pyarrow as pa
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        #: The same model behind a plainer split, for words of Latin letters in the byte-level
        #: alphabet: its own pre-tokenizer leaves them whole.
        self.letters = Tokenizer(self.tok.model)
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        #: Little-endian ids of 16 bits where the vocabulary allows, else 32.
        self.ids = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.spaced = np.array([(self.tok.id_to_token(i) or "").startswith(SPACE) for i in range(self.tok.get_vocab_size())])
        self.pieces = self.older = Pieces(pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, self.ids))

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _after_space(self, words: list[str], tok, space: str) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each, ids) of words with a space before each. Words have no white
        space themselves, so exactly their first tokens start with a space."""
        between, ids = " " + space.strip(), []
        for i in range(0, len(words), RUN_WORDS):
            ids += tok.encode_batch_fast([space + between.join(words[i : i + RUN_WORDS])], add_special_tokens=False)[0].ids
        ids = np.array(ids, self.ids)
        return np.diff(np.flatnonzero(self.spaced[ids]), append=len(ids)), ids

    def _learn(self, new: list[str]) -> Pieces:
        """The pieces and their ids, each from those of a word and of the marks after it."""
        import pyarrow as pa
        import pyarrow.compute as pc

        text = pa.array(new, pa.string())
        word = pc.utf8_rtrim(text, MARKS)
        plain = pc.match_substring_regex(word, f"^{LETTERS}$").to_numpy(zero_copy_only=False).copy()
        joined = " ".join(new)
        added = [t for t in self.added if t in joined]
        if added:
            plain[:] = False
        words = word.filter(pa.array(plain)).dictionary_encode()
        letters, number = words.dictionary.to_numpy(zero_copy_only=False).tolist(), {}
        head, marks = np.full((2, len(new)), -1)  # parts by number; the last has no ids
        head[plain] = words.indices.to_numpy()
        marked = np.flatnonzero(plain & pc.less(pc.binary_length(word), pc.binary_length(text)).to_numpy(zero_copy_only=False))
        after = pc.replace_substring_regex(text.take(marked), f"^{LETTERS}", AFTER).dictionary_encode()
        marks[marked] = len(letters) + after.indices.to_numpy()
        number.update(zip(after.dictionary.to_pylist(), range(len(letters), len(letters) + len(after.dictionary)), strict=True))
        for i in np.flatnonzero(~plain).tolist():
            p = new[i]
            x = p.removeprefix("\n")
            if x.split() != [x] or any(t in x for t in added):
                continue
            w = p.rstrip(MARKS)
            if len(w) < len(p) and "A" <= w[-1:] <= "\u024f" and w[-1].isalpha():
                marks[i] = number.setdefault(AFTER + p[len(w) :], len(letters) + len(number))
                p = w
            head[i] = number.setdefault(p, len(letters) + len(number))
        spaced = [p for p in number if p[0] not in _UNSPACED]
        others = [p for p in number if p[0] in _UNSPACED]
        found = self.whole([p.lstrip(AFTER + BARE) for p in others])
        runs = [self._after_space([w if w.isascii() else w.translate(_IN_BYTES) for w in letters], self.letters, SPACE), self._after_space(spaced, self.tok, " ")]
        runs.append((np.array([len(x) // self.ids.itemsize for x in found], np.int64), np.frombuffer(b"".join(found), self.ids)))
        size, ids = (np.concatenate(x) for x in zip(*runs, strict=True))
        place = np.append(np.arange(len(letters)), [number[p] for p in [*spaced, *others]]).astype(np.int64)
        starts, sizes = np.zeros((2, len(size) + 1), np.int64)
        starts[place], sizes[place] = np.cumsum(size) - size, size
        parts = np.stack([head, marks], axis=1)
        return Pieces(text, np.where(head < 0, -1, sizes[parts].sum(axis=1)), ids[_spans(starts[parts].ravel(), sizes[parts].ravel())])

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of one text."""
        return np.frombuffer(self.encode_all([text])[0], self.ids).astype("<u4").tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as numbers of type ``ids``. Each different piece of the
        texts is looked up once."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not texts:
            return []
        lists = pc.split_pattern(pa.array(["" if _OWN_MARKS(t) else _laid(t) for t in texts], pa.string()), " ")
        words = lists.values.dictionary_encode()
        met, known = words.dictionary, self.pieces + self.older
        at = pc.index_in(met, value_set=known.text).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = len(known) + np.arange(len(new))
            known += self._learn(met.take(new).to_numpy(zero_copy_only=False).tolist())
        of, bounds = at[words.indices.to_numpy()], lists.offsets.to_numpy()
        size = known.size[of]
        alone = np.logical_and.reduceat(size >= 0, bounds[:-1]).tolist()
        cuts = np.append(0, np.cumsum(np.maximum(size, 0)))[bounds].tolist()
        ids = known.ids[_spans(known.starts()[of], size)]
        whole = iter(self.whole([t for t, a in zip(texts, alone, strict=True) if not a]))
        out = [ids[x:y].tobytes() if a else next(whole) for a, x, y in zip(alone, cuts[:-1], cuts[1:], strict=True)]
        del lists, words, of, size, ids, cuts
        left = np.ones(len(known), bool)
        left[at] = False
        short = pc.less_equal(pc.utf8_length(met), CACHE_PIECE_CHARS).to_numpy(zero_copy_only=False)
        self.pieces = known.take(at[short][:CACHE_PIECES])
        self.older = known.take(np.flatnonzero(left)[: CACHE_PIECES - len(self.pieces)])
        return out


def _laid(text: str) -> str:
    """The pieces of a text with a space between; no text is one empty piece."""
    text = text.replace("\n", " \n")
    return text[1:] if text.startswith(" ") else BARE + text if text else text


def chunked(texts: Iterable[str]) -> Iterator[list[str]]:
    """The texts in runs of at most CHUNK_CHARS characters, or of one text; one run is
    held at a time."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > CHUNK_CHARS:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def piece_encoder(path: str) -> PieceEncoder:
    return worker_model(PieceEncoder, path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def train_dictionary(docs: DataFrame, path: str) -> bytes:
    """Shared zstandard dictionary from a bounded sample (SAMPLE_DOCS, SAMPLE_CHARS);
    empty where there is nothing to train on."""
    import zstandard

    rows = hashed_sample(docs, SAMPLE_DOCS, "doc_id", "text").where(F.length("text").between(1, SAMPLE_CHARS)).select("text").collect()
    samples = [x for run in chunked([r.text for r in rows]) for x in piece_encoder(path).encode_all(run)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little to train on
        return b"".join(samples)[:DICTIONARY_BYTES]


def write_shards(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """docs(doc_id, text, ...) -> shards in ``folder``, documents in ascending doc_id;
    returns the manifest (shard, uri, n_docs, n_ids), a table in ``folder``, too.

    A null text is an empty one (the end id alone). Null ids come first and are
    written as the smallest 64-bit integer. Repeated rows are written as often as they
    are in docs; an empty table writes the dictionary alone; other columns are ignored.
    A task writes under a name of its own and only the files of tasks that ended well
    are in the manifest, so a task that is run again does no harm."""
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    dictionary = train_dictionary(docs, path)
    digest = hashlib.sha256(dictionary).digest()
    with open_out(f"{folder}/{digest.hex()}.dict") as f:
        f.write(dictionary)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        encoder = piece_encoder(path)
        cctx = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        shard, out, index, at, total = TaskContext.get().partitionId(), None, [], len(MAGIC), 0
        uri = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.tokz"
        end, width = np.array([end_id], encoder.ids).tobytes(), encoder.ids.itemsize
        for b in batches:
            if b.num_rows and out is None:
                out = open_out(uri)
                out.write(MAGIC)
            texts = (t.as_py() or "" for t in b.column(1))
            encoded = (x for run in chunked(texts) for x in encoder.encode_all(run))
            for doc_id, ids in zip(b.column(0).to_pylist(), encoded, strict=True):
                frame = cctx.compress(ids + end)
                n = len(ids) // width + 1
                out.write(frame)
                index.append((-(1 << 63) if doc_id is None else doc_id, at, len(frame), n))
                at, total = at + len(frame), total + n
        if out is not None:
            out.write(np.array(index, INDEX).tobytes())
            out.write(struct.pack(FOOTER, len(index), at, width, digest, TAIL))
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "uri": [uri], "n_docs": [len(index)], "n_ids": [total]})

    ordered = docs.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(run, "shard int, uri string, n_docs long, n_ids long"), "tokens", f"{folder}/manifest-{uuid.uuid4().hex}")


class Shard:
    """A shard opened for reading; ``document(i)`` reads one frame alone."""

    def __init__(self, uri: str):
        import zstandard

        self.file = open_in(uri)
        size = self.file.size()
        self.file.seek(size - struct.calcsize(FOOTER))
        n, self.index_at, self.width, digest, tail = struct.unpack(FOOTER, self.file.read(struct.calcsize(FOOTER)))
        if tail != TAIL:
            raise ValueError(f"not a token shard: {uri}")
        self.file.seek(self.index_at)
        self.index = np.frombuffer(self.file.read(n * INDEX.itemsize), INDEX)
        with open_in(f"{uri.rpartition('/')[0]}/{digest.hex()}.dict") as f:
            dictionary = f.read()
        if hashlib.sha256(dictionary).digest() != digest:
            raise ValueError(f"wrong dictionary for {uri}")
        self.dctx = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def __enter__(self) -> Shard:
        return self

    def __exit__(self, *why) -> None:
        self.file.close()

    def _ids(self, frame: bytes) -> np.ndarray:
        return np.frombuffer(self.dctx.decompress(frame), f"<u{self.width}").astype("<u4")

    def document(self, i: int) -> np.ndarray:
        self.file.seek(int(self.index["offset"][i]))
        return self._ids(self.file.read(int(self.index["bytes"][i])))

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        self.file.seek(len(MAGIC))
        for doc_id, _, size, _ in self.index.tolist():
            yield doc_id, self._ids(self.file.read(size))


def read_shards(manifest: DataFrame) -> DataFrame:
    """Manifest of write_shards -> per document of the files: doc_id, start (ids before
    it), n_tokens, ids_crc32. A task reads one shard as a stream."""
    spark = manifest.sparkSession
    shards, base = [], 0
    for r in manifest.orderBy("shard").collect():  # one row for each file
        shards.append((r.shard, r.uri, base))
        base += r.n_ids
    schema = "shard int, uri string, base long"
    starts = spark.createDataFrame(shards, schema).repartitionByRange(max(1, len(shards)), "shard")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for uri, start in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                rows: list[tuple] = []
                with Shard(uri) as shard:
                    for doc_id, ids in shard.documents():
                        rows.append((None if doc_id == -(1 << 63) else doc_id, start, len(ids), zlib.crc32(ids)))
                        start += len(ids)
                        if len(rows) == 10_000:
                            yield _rows(pa, rows)
                            rows = []
                if rows:
                    yield _rows(pa, rows)

    return starts.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(pa, rows: list[tuple]):
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_output(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the shards and reads them back (see write_shards, read_shards)."""
    return read_shards(write_shards(docs, folder or fresh_path(docs.sparkSession, "tokens")))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(documents(spark, sf_dir))


QUERIES = {"op3_token_output": op3_token_output}
SQL: dict[str, str] = {}
