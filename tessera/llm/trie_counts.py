"""Token counts by dynamic programming over a trie.

Of each batch of documents, the distinct pre-tokens (words with the space before them) go into a trie. The trie is walked
in sorted order: a node's forward scores, the best sums of piece scores up to each place of its prefix, are computed once
and shared by all pre-tokens that start with it; the nodes that end a pre-token store its count. A bounded memo carries
counts from batch to batch. No shuffle: a document's counts are looked up where it is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import read, small_batches
from tessera.llm.pieces import SPACE, Pieces, pieces_of, read_model

#: Counts that a worker remembers.
MEMO = 400_000
_LOW = float("-inf")


def trie_counts(words: list[str], v: Pieces) -> dict[str, int]:
    """The number of ids of each word's best segmentation (see ``pieces``). Words with equal starts share a path: the
    words are visited in order, and the path of the last one is kept as far as the next one shares it."""
    out: dict[str, int] = {}
    score, ends, unknown = v.score, v.ends, v.unknown
    last = ""
    best, count = [0.0], [0]  # forward score and count of each node on the path
    for word in sorted(words):
        shared = 0
        most = min(len(last), len(word))
        while shared < most and last[shared] == word[shared]:
            shared += 1
        del best[shared + 1:], count[shared + 1:]
        for e in range(shared + 1, len(word) + 1):
            c = word[e - 1]
            if c in score:
                top, n = _LOW, 0
            else:  # the character's bytes
                top, n = best[e - 1] + unknown, count[e - 1] + len(c.encode("utf-8", "surrogatepass"))
            for r in range(e - 1, -1, -1):
                part = word[r:e]
                if part not in ends:  # no piece ends in it
                    break
                s = score.get(part)
                if s is not None and s + best[r] >= top:
                    top, n = s + best[r], count[r] + 1
            best.append(top)
            count.append(n)
        out[word] = count[len(word)]
        last = word
    return out


def pretokens(text: str) -> list[str]:
    """Words with the spaces before them, as the encoder parts them; line breaks stand alone."""
    out: list[str] = []
    text = text.replace(SPACE, "\uffff")  # its own U+2581 is no space; it becomes three bytes, as this does
    for k, line in enumerate(text.split("\n")):
        if k:
            out.append("\n")
        if "  " in line or line[-1:] == " ":
            out += [p.replace(" ", SPACE) for p in re.findall(" *[^ ]+| +", line)]
            continue
        head, *rest = line.split(" ")
        if head:
            out.append(head)
        out += [SPACE + w for w in rest]
    return out


def _counted(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = pieces_of(model.value)
        memo: dict[str, int] = {}
        for batch in batches:
            docs = [pretokens(t.as_py() or "") for t in batch.column(1)]
            new = {w for words in docs for w in words if w not in memo}
            if len(memo) + len(new) > MEMO:
                memo = {}
                new = {w for words in docs for w in words}
            memo.update(trie_counts(list(new), v))
            n = [sum(map(memo.__getitem__, words)) for words in docs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()),
                                              pa.array(np.fromiter(map(len, docs), np.int64, len(docs)))],
                                             names=["doc_id", "n_tokens", "n_pretokens"])
    return run


def token_counts(spark: SparkSession, docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """One row (doc_id, n_tokens, n_pretokens) for each row of ``docs`` (doc_id, text). A null or empty text has none;
    ids may be null or repeat; other columns are ignored."""
    small_batches(spark)
    model = spark.sparkContext.broadcast(read_model(model_path))  # half a megabyte, whatever the input
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _counted(model), "doc_id long, n_tokens long, n_pretokens long")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's number of tokens."""
    return token_counts(spark, read(spark, sf_dir, "documents"))
