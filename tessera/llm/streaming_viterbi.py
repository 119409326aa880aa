"""SentencePiece encoding and decoding by streaming Viterbi.

The lattice is walked one character at a time. Only boundaries that a piece can still reach over stay open: at most as
many as the longest piece has characters. As soon as the best paths of all open boundaries come from one boundary, the
ids up to it are final and are committed, so memory follows the longest stretch without such a boundary and not the
text. Where the vocabulary has no piece over a space or a line break, every word is such a stretch, and a bounded memo
keeps the ids of stretches seen before.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import read, small_batches
from tessera.llm.pieces import SPACE, Memo, Pieces, pieces_of, read_model


_LOW = float("-inf")


def stream(text: str, v: Pieces) -> Iterator[list[int]]:
    """Yields lists of final ids of ``text``, in which spaces are written as SPACE. Where pieces reach over every boundary,
    the open paths are traced back once for each length of the longest piece."""
    table, none, n = v.table, (), len(text)
    base, far = 0, 0  # the committed boundary; the furthest boundary that a piece may reach from before here
    best, frm, ids = [0.0], [0], [0]  # of the boundaries from base on; frm counts from base
    for j in range(n):
        r = j - base
        if r and far <= j:  # no piece reaches over this boundary: all paths meet in it
            yield _traced(text, v, base, r, frm, ids)
            base, r = j, 0
            best, frm, ids = [0.0], [0], [0]
        elif r and j % v.longest == 0:
            alive = {r, *(k for k in range(max(0, r - v.longest), len(best)) if best[k] > _LOW)}
            while len(alive) > 1:
                last = max(alive)
                alive.discard(last)
                alive.add(frm[last])
            if meet := alive.pop():
                yield _traced(text, v, base, meet, frm, ids)
                base, r = base + meet, r - meet
                # sums stay relative to the committed boundary; boundaries that no open path uses may lie before it
                best, ids = [x - best[meet] for x in best[meet:]], ids[meet:]
                frm = [max(0, x - meet) for x in frm[meet:]]
        if len(best) <= r + v.longest:
            more = v.longest + 1
            best += [_LOW] * more
            frm += [0] * more
            ids += [0] * more
        at, e, sure = best[r], j + 1, False
        while e <= n:
            hit = table.get(text[j:e], none)
            if hit is none:
                break
            if hit is not None:
                s, k = at + hit[0], e - base
                if s > best[k]:
                    best[k], frm[k], ids[k] = s, r, hit[1]
                sure = sure or e == j + 1
            e += 1
        if e - 1 > far:
            far = e - 1
        if not sure and at + v.unknown > best[r + 1]:
            best[r + 1], frm[r + 1], ids[r + 1] = at + v.unknown, r, -1
    yield _traced(text, v, base, n - base, frm, ids)


def _traced(text: str, v: Pieces, base: int, k: int, frm: list[int], ids: list[int]) -> list[int]:
    out: list[int] = []
    while k:
        if ids[k] >= 0:
            out.append(ids[k])
        else:
            out.extend(reversed(v.fallback(text[base + k - 1])))
        k = frm[k]
    out.reverse()
    return out


class Codec:
    """Encodes texts to packed little-endian 32-bit ids and back. Exact: decode(encode(text)) == text."""

    def __init__(self, v: Pieces, memo: int = 300_000):
        self.v = v
        self.first = Memo(lambda w: self._ids(w), memo)
        self.spaced = Memo(lambda w: self._ids(" " + w), memo)
        self.line = self._ids("\n")
        self.fast = v.parts_at_space and v.parts_at_line

    def _ids(self, text: str) -> bytes:
        return array("I", chain.from_iterable(stream(text.replace(" ", SPACE), self.v))).tobytes()

    def encode(self, text: str) -> bytes:
        if SPACE in text:  # its own U+2581 go as bytes, each between two stretches
            mark = np.array(self.v.fallback(SPACE), dtype="<u4").tobytes()
            return mark.join(self.encode(part) for part in text.split(SPACE))
        if not text:
            return b""
        if not self.fast:
            return self._ids(text)
        out, held = [], self.spaced.__getitem__
        for line in text.split("\n"):
            if "  " in line or line[-1:] == " ":  # runs of spaces belong to the word after them
                parts = re.findall(" *[^ ]+| +", line)
                out.append(b"".join(held(p[1:]) if p[0] == " " else self.first[p] for p in parts))
            else:
                head, *rest = line.split(" ")
                out.append((self.first[head] if head else b"") + b"".join(map(held, rest)))
        return self.line.join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.v.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode(
            "utf-8", "surrogatepass")


def _run(model, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(pieces_of(model.value))
        for batch in batches:
            n, crc, chars, exact, all_ids = [], [], [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                ids = codec.encode(text)
                again = codec.decode(ids)
                n.append(len(ids) // 4)
                crc.append(zlib.crc32(ids))
                chars.append(len(again))
                exact.append(again == text)
                if keep_ids:
                    all_ids.append(ids)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()),
                       pa.array(chars, pa.int64()), pa.array(exact, pa.bool_())]
            names = ["doc_id", "n_ids", "ids_crc32", "n_chars_decoded", "round_trip"]
            if keep_ids:
                flat = pa.array(np.frombuffer(b"".join(all_ids), dtype="<u4").astype(np.int32))
                ends = np.cumsum([0, *n]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), flat))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)
    return run


def encoded(spark: SparkSession, docs: DataFrame, model_path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): the number of ids, the CRC-32 of the ids as little-endian 32-bit
    integers, the characters of the decoded text, whether it equals the text, and the ids. A null or empty text has
    no ids; ids of rows may be null or repeat; other columns are ignored."""
    small_batches(spark)
    model = spark.sparkContext.broadcast(read_model(model_path))  # half a megabyte, whatever the input
    schema = "doc_id long, n_ids long, ids_crc32 long, n_chars_decoded long, round_trip boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _run(model, keep_ids), schema + (", ids array<int>" if keep_ids else ""))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's ids, as digests, and whether decoding gives the text back."""
    return encoded(spark, read(spark, sf_dir, "documents"), keep_ids=False)
