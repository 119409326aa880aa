"""The corpus pipeline: quality rules, near-duplicates, mixing, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a frame; it is written as Parquet and read again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import Scratch, read
from tessera.llm.mixing import mixed
from tessera.llm.neardup import NearDuplicates
from tessera.llm.quality import cleaned
from tessera.llm.streaming_viterbi import encoded


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines and documents that fail the quality rules."""
    return cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return NearDuplicates(spark).kept(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it."""
    return mixed(spark, docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, with a check that they decode to its text."""
    return encoded(spark, docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("mixing", mixing),
          ("sentencepiece", sentencepiece)]
#: SQL has no Viterbi segmentation; tests/llm/test_pipeline.py compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.table(docs, name)
    return docs
