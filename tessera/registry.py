"""Queries by name with the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of a table reader: ``t("orders")`` is that table's frame."""
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql:
            ORACLES[name] = sql
        return f
    return add


def q6(x: Column) -> Column:
    """Six decimals by arithmetic, which every engine rounds alike."""
    return F.floor(x * F.lit(1e6) + F.lit(0.5)).cast("double") / F.lit(1e6)


def Q6(x: str) -> str:
    return f"floor(({x})::double * 1e6 + 0.5)::double / 1e6"


def shared(name: str, sql: str, whole: str | None = None) -> None:
    """Registers SQL that both engines read alike; ``{orders}`` stands for the table orders. ``whole`` is Spark's form
    where the SQL stops at a bound or is a slower plan."""
    form = whole or sql
    tables = set(re.findall(r"\{(\w+)\}", form))
    QUERIES[name] = lambda spark, sf_dir: spark.sql(form, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})
    ORACLES[name] = re.sub(r"\{(\w+)\}", r"\1", sql)
