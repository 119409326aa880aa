"""Token ids in files of separately compressed documents that share one zstandard dictionary.

A file holds: the magic, the dictionary's SHA-256, one zstandard frame for each document (its ids, little-endian, 16 bits
wide if the vocabulary allows, else 32), the index (doc_id, null flag, offset, length, number of ids of each document),
and a tail with the index's place. One document is read by one range read of its frame; the dictionary lies beside the
files under its hash. Files follow one another in doc_id order; a manifest holds each file's first position.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import Scratch, read, small_batches
from tessera.llm.files import create, fresh, size_of, span

MAGIC = b"TIDS0001"
_HEAD, _TAIL = "<8s32sH", "<QQ8s"
_HEAD_SIZE, _TAIL_SIZE = struct.calcsize(_HEAD), struct.calcsize(_TAIL)
_INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("length", "<u4"), ("n", "<u8")])
#: The dictionary is trained on so many documents (the smallest hashes of ids and texts), of each so many bytes at most.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 1024, 1 << 15, 1 << 16


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: ASCII marks that the tokenizer's pre-tokens keep together; no apostrophe, which may start a suffix.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words and parts of words that a worker remembers, and bytes of text that it encodes at a time. Memory only.
MOST_WORDS, MOST_PARTS, CHUNK_BYTES = 1_200_000, 700_000, 8 << 20
#: Words of more bytes are not remembered.
LONG_WORD = 1024
#: Letters up to here (Latin, Greek, Cyrillic) have been letters in every version of Unicode in use.
_LAST_LETTER = "\u052f"


def _plain(letters: str, lower: str) -> bool:
    """Whether the tokenizer takes the letters of a word, in their lower case, for one pre-token. The lower case of a sigma
    depends on its place in Python, that of some letters holds a mark."""
    return lower.isalpha() and letters.isalpha() and (
        letters.isascii() or "Σ" not in letters and max(lower) <= _LAST_LETTER)


class Encoder:
    """Packed ids of texts, those of the tokenizer's own ``encode(text, add_special_tokens=False)``: strings of special
    tokens in a text are these tokens. The tokenizer drops white space and parts words at it before its merges, so words
    at ASCII white space are encoded for themselves and remembered; of plain words, letters and marks apart, as it parts
    them too. Letters that are new are encoded in one call: each part is one pre-token, which ends in a final token."""

    def __init__(self, content: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(content)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u4" if size > 1 << 16 else "<u2")
        self.final = np.zeros(size, dtype=bool)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None) or "\0"
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.final[i] = token.endswith(suffix)
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.long: list[bytes] = []

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _learn_parts(self, new: list[str]) -> None:
        for at in range(0, len(new), 1 << 14):
            some = new[at : at + (1 << 14)]
            # this form gives the same ids and computes no offsets
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids)
            ends = np.flatnonzero(self.final[ids]) + 1
            if len(ends) != len(some):  # a vocabulary of another kind
                self.parts.update((part, self._ids(part)) for part in some)
                continue
            packed, lo = ids.astype(self.dtype).tobytes(), 0
            for part, hi in zip(some, (ends * self.dtype.itemsize).tolist(), strict=True):
                self.parts[part] = packed[lo:hi]
                lo = hi

    def _learn(self, new: set[bytes]) -> None:
        words, parts, marks = self.words, self.parts, self.marks
        if len(parts) > MOST_PARTS:
            parts.clear()
        if len(marks) > MOST_PARTS:
            marks.clear()
        order = list(new)
        texts = b" ".join(order).decode("utf-8").split(" ") if order else []
        letters = [text.rstrip(MARKS) for text in texts]
        lowers = " ".join(letters).lower().split(" ") if order else []
        plain = [_plain(a, b) for a, b in zip(letters, lowers, strict=True)]
        self._learn_parts(list(set(compress(lowers, plain)).difference(parts)))
        for word, text, letter, lower, fine in zip(order, texts, letters, lowers, plain, strict=True):
            if not fine:
                words[word] = self._ids(text)
            elif len(letter) == len(text):
                words[word] = parts[lower]
            else:
                mark = text[len(letter):]
                if mark not in marks:
                    marks[mark] = self._ids(mark)
                words[word] = parts[lower] + marks[mark]
        for k, word in enumerate(order):
            if len(word) > LONG_WORD:
                self.long.append(word)
                parts.pop(lowers[k], None), marks.pop(texts[k][len(letters[k]):], None)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The packed ids of each text; none of a null."""
        words = [(t or "").encode("utf-8").split() for t in texts]
        every = set().union(*words)
        if len(self.words) + len(every) > MOST_WORDS:
            self.words = {}
        self._learn(every.difference(self.words))
        ids = [b"".join(map(self.words.__getitem__, w)) for w in words]
        while self.long:
            del self.words[self.long.pop()]
        return ids


@lru_cache(maxsize=2)
def encoder_of(content: bytes) -> Encoder:
    """One encoder for each Python worker, whatever its tasks."""
    return Encoder(content)


def _chunks(texts: pa.Array) -> Iterator[list[str | None]]:
    held, size = [], 0
    for text in texts.to_pylist():
        held.append(text)
        size += len(text or "")
        if size > CHUNK_BYTES:
            yield held
            held, size = [], 0
    yield held


def train(samples: list[bytes]) -> bytes:
    """A dictionary from serialized id arrays; of too few or too small ones, what they hold as raw content."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:] or bytes(8)


@lru_cache(maxsize=4)
def _dictionary(uri: str):
    import zstandard

    return zstandard.ZstdCompressionDict(span(uri, 0, size_of(uri)))


def _encoded(tokenizer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer.value)
        for batch in batches:
            at = 0
            for texts in _chunks(batch.column(2)):
                part = batch.slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(encoder.encode(texts), pa.binary())],
                                                 names=["doc_id", "mark", "ids"])
    return run


_WRITTEN = pa.schema([("part", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()),
                      ("bytes", pa.int64())])


def _written(folder: str, dictionary: str, width: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        last = np.array([end], dtype=f"<u{width}").tobytes()
        frames = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(dictionary), write_dict_id=False)
        uri, index, out, at, tokens = fresh(folder, ".ids"), [], None, 0, 0
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if out is None:
                    out = create(uri)
                    at = out.write(struct.pack(_HEAD, MAGIC, bytes.fromhex(dictionary.rpartition("/")[2]), width))
                ids = ids.as_py() + last
                frame = frames.compress(ids)
                out.write(frame)
                n = len(ids) // width
                index.append((doc or 0, doc is None, at, len(frame), n))
                at, tokens = at + len(frame), tokens + n
        if out is not None:
            packed = zlib.compress(np.array(index, dtype=_INDEX).tobytes(), 1)
            out.write(packed)
            out.write(struct.pack(_TAIL, at, len(packed), MAGIC))
            out.close()
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "file": uri, "docs": len(index),
                                               "tokens": tokens, "bytes": at + len(packed) + _TAIL_SIZE}], schema=_WRITTEN)
    return run


class TokenFile:
    """Random access to the documents of one file."""

    def __init__(self, uri: str):
        self.uri = uri
        magic, digest, self.width = struct.unpack(_HEAD, span(uri, 0, _HEAD_SIZE))
        at, length, tail = struct.unpack(_TAIL, span(uri, size_of(uri) - _TAIL_SIZE, _TAIL_SIZE))
        if magic != MAGIC or tail != MAGIC:
            raise ValueError(f"{uri} is not a file of token ids")
        import zstandard

        kept = _dictionary(f"{uri.rpartition('/')[0]}/{digest.hex()}")
        if hashlib.sha256(kept.as_bytes()).digest() != digest:
            raise ValueError(f"{uri} was written with another dictionary")
        self.frames = zstandard.ZstdDecompressor(dict_data=kept)
        self.index = np.frombuffer(zlib.decompress(span(uri, at, length)), dtype=_INDEX)

    def ids(self, k: int) -> np.ndarray:
        """The ids of the file's k-th document, by one range read."""
        row = self.index[k]
        data = self.frames.decompress(span(self.uri, int(row["offset"]), int(row["length"])),
                                      max_output_size=int(row["n"]) * self.width)
        return np.frombuffer(data, dtype=f"<u{self.width}")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            file = TokenFile(uri)
            n = file.index["n"].astype(np.int64)
            starts = base + np.cumsum(n) - n
            for lo in range(0, len(n), 4096):
                part = slice(lo, lo + 4096)
                crc = [zlib.crc32(file.ids(k).astype("<u4").tobytes()) for k in range(lo, min(lo + 4096, len(n)))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(file.index["doc_id"][part], mask=file.index["null"][part].astype(bool)),
                     pa.array(starts[part]), pa.array(n[part]), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])


def write(spark: SparkSession, docs: DataFrame, tokenizer_path: str | None = None, end: int = 2) -> DataFrame:
    """Writes the ids of ``docs`` (doc_id, text) in ascending doc_id order, nulls first; returns the manifest: one row
    (file, base, docs, tokens, bytes) for each file.

    A null or empty text has only the end id. The string of a special token in a text is that token, as the tokenizer
    has it. Rows that share an id follow one another, by a hash of their texts; other columns are ignored. An empty
    table gives an empty manifest. Texts are encoded where they are read; only ids are sorted.
    """
    small_batches(spark)
    scratch = Scratch(spark, "token-ids")
    with open(tokenizer_path or default_tokenizer(), "rb") as f:
        content = f.read()
    width = Encoder(content).dtype.itemsize
    tokenizer = spark.sparkContext.broadcast(content)  # a vocabulary file, whatever the input
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"),
                       F.col("text").cast("string").alias("text"))
    ids = scratch.table(rows.mapInArrow(_encoded(tokenizer), "doc_id long, mark long, ids binary"), "ids")
    head = F.substring("ids", 1, SAMPLE_BYTES // width * width)
    key = F.xxhash64("doc_id", "mark")
    # some twice as many rows as are wanted pass the bound, so what tasks send does not grow with their number
    bound = min((1 << 63) - 1, -(1 << 63) + (1 << 65) * SAMPLE_DOCS // max(1, ids.count()))
    chosen = ids.where("doc_id is not null").where(key <= F.lit(bound)).select(
        key.alias("key"), "doc_id", "mark", head.alias("head")).orderBy("key", "doc_id", "mark").limit(SAMPLE_DOCS).collect()
    learned = train([bytes(r.head) for r in chosen if r.head])
    dictionary = f"{scratch.path}/files/{hashlib.sha256(learned).hexdigest()}"
    with create(dictionary) as f:
        f.write(learned)
    order = [F.col("doc_id").asc_nulls_first(), "mark"]
    written = scratch.table(ids.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids").mapInArrow(
        _written(f"{scratch.path}/files", dictionary, width, end),
        "part int, file string, docs long, tokens long, bytes long"), "written")
    scratch.drop("ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return written.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"), "docs", "tokens", "bytes")


def digests(manifest: DataFrame) -> DataFrame:
    """One row (doc_id, start, n_tokens, ids_crc32) for each document, from the files."""
    n = max(1, manifest.count())  # a number keeps small rows that mean large reads apart
    return manifest.select("file", "base").repartition(2 * n, "file").mapInArrow(
        _read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents and reads them back."""
    return digests(write(spark, read(spark, sf_dir, "documents")))
