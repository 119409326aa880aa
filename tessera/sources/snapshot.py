"""Snapshots of parameter tables by iteration, as Parquet folders that are whole once their commit's marker is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def snapshot(tables: dict[str, DataFrame], path: str, iteration: int) -> None:
    """Writes the tables, then the list of their names, which makes the snapshot whole. An iteration is written once."""
    at = f"{path}/iteration={iteration:010d}"
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{at}/table={name}")
    spark = next(iter(tables.values())).sparkSession
    spark.range(1).select(F.array(*map(F.lit, tables)).alias("names")).coalesce(1).write.mode("errorifexists").parquet(f"{at}/whole")


def iterations(spark: SparkSession, path: str) -> list[int]:
    """The iterations of whole snapshots, in order; none where there is no folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(hadoop):
        return []
    found = [s.getPath().getName() for s in files.listStatus(hadoop)]
    whole = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(n.removeprefix("iteration=")) for n in found if n.startswith("iteration=") and files.exists(whole(f"{path}/{n}/whole/_SUCCESS")))


def restore(spark: SparkSession, path: str, iteration: int | None = None) -> dict[str, DataFrame]:
    """The tables of an iteration, or of the last whole one."""
    known = iterations(spark, path)
    at = iteration if iteration is not None else known[-1] if known else None
    if at not in known:
        raise FileNotFoundError(f"no whole snapshot {at} in {path}")
    folder = f"{path}/iteration={at:010d}"
    names = spark.read.parquet(f"{folder}/whole").first()["names"]  # one row
    return {n: spark.read.parquet(f"{folder}/table={n}") for n in names}
