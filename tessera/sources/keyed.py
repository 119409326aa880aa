"""Keyed datasets as Parquet in key order: put, seek and cursors; Spark's commit makes a write atomic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def put(df: DataFrame, path: str, key: str = "key") -> None:
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("errorifexists").parquet(path)


def seek(spark: SparkSession, path: str, at: str, key: str = "key") -> DataFrame:
    """Rows from a key on, in order; row groups before it are skipped by their statistics."""
    return spark.read.parquet(path).where(F.col(key) >= at).orderBy(key)


def epoch_order(df: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    """The rows in the shuffled order of an epoch, which a seed repeats."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed), F.lit(epoch)), key)
