"""All queries of the engine by name, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import gradients, parameters, randoms, sequences, series, sources, tables, tensor, tuner  # noqa: F401
from tessera.registry import ORACLES, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship_classifier"](spark, sf_dir)


__all__ = ["ORACLES", "QUERIES", "flagship"]
