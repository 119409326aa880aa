"""Keyed datasets, snapshots, seeded numbers and the streaming forms of windows."""

import pytest
from pyspark.sql import functions as F

from tessera.operators.seeded import bernoulli, bits, gaussian, uniform
from tessera.sources.keyed import epoch_order, put, seek
from tessera.sources.snapshot import iterations, restore, snapshot
from tessera.streaming.progress import sessions, sliding

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_put_and_seek(spark, tmp_path):
    path = str(tmp_path / "db")
    put(spark.range(100).select(F.format_string("%05d", "id").alias("key"), "id"), path)
    assert [r.id for r in seek(spark, path, "00042").collect()] == list(range(42, 100))
    with pytest.raises(Exception, match="(?i)exists"):
        put(spark.range(1).select(F.lit("a").alias("key"), "id"), path)


def test_epochs_shuffle_alike_by_seed(spark):
    order = lambda seed, epoch: [r.id for r in epoch_order(spark.range(50), "id", seed, epoch).collect()]
    assert order(1, 0) == order(1, 0) != order(1, 1)
    assert sorted(order(1, 0)) == list(range(50)) and order(1, 0) != order(2, 0)


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "net")
    assert iterations(spark, path) == []
    for i in (5, 12):
        snapshot({"weights": spark.range(i), "history": spark.range(2 * i)}, path, i)
    spark.range(1).write.parquet(f"{path}/iteration=0000000099/table=weights")  # cut short
    assert iterations(spark, path) == [5, 12]
    assert {n: d.count() for n, d in restore(spark, path).items()} == {"weights": 12, "history": 24}
    assert restore(spark, path, 5)["weights"].count() == 5
    for absent in (99, 7):
        with pytest.raises(FileNotFoundError):
            restore(spark, path, absent)


def reference_bits(key, seed):
    x = (key % 2147483647 * 31 + seed) % 2147483647 * 2654435761 % 2**32
    x = (x ^ (x >> 16)) * 1103515245 % 2**32
    return x ^ (x >> 15)


def test_seeded_numbers(spark):
    big = [0, 1, 2**31, 2**40 + 3, 2**62]
    df = spark.createDataFrame([(k,) for k in big], "k long").select("k", bits(F.col("k"), 9).alias("b"))
    assert all(r.b == reference_bits(r.k, 9) for r in df.collect())
    k = F.col("id")
    m = spark.range(20000).agg(F.avg(uniform(k, 1, 2, 4)).alias("u"), F.stddev(gaussian(k, 2, 5, 3)).alias("s"), F.avg(gaussian(k, 2, 5, 3)).alias("g"),
                               F.avg(bernoulli(k, 4, 0.3)).alias("p"), F.corr(uniform(k, 1), uniform(k, 2)).alias("c"),
                               F.corr(uniform(k, 1), uniform(k + 1, 1)).alias("next")).first()
    assert abs(m.u - 3) < 0.02 and abs(m.s - 3) < 0.08 and abs(m.g - 5) < 0.08 and abs(m.p - 0.3) < 0.015
    assert abs(m.c) < 0.03 and abs(m.next) < 0.03


@pytest.mark.parametrize("f, mode", [(sliding, "complete"), (sessions, "append")])
def test_windows_stream_as_in_batch(spark, tmp_path, f, mode):
    batch = spark.read.parquet(EVENTS)
    stream = spark.readStream.schema(batch.schema).parquet(EVENTS.replace("events.parquet", "events.parquet*"))
    name = f"w_{f.__name__}"
    q = f(stream).writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table(name).collect()}
    want = {tuple(r) for r in f(batch).collect()}
    assert got and (got == want if mode == "complete" else got <= want)


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    """Stopped between two files, a query with state gives in the end what one batch over both gives, each row once."""
    rows, source, sink = spark.read.parquet(EVENTS), str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        def keep(df, batch):
            df.write.mode("overwrite").parquet(sink)

        q = sliding(spark.readStream.schema(rows.schema).parquet(source)).writeStream.foreachBatch(keep).outputMode("complete").option(
            "checkpointLocation", str(tmp_path / "state")).start()
        q.processAllAvailable()
        q.stop()
        return sorted(map(tuple, spark.read.parquet(sink).collect()))

    for part in (0, 1):
        rows.where(F.col("event_id") % 2 == part).coalesce(1).write.mode("append").parquet(source)
        got = run()
        assert got == sorted(map(tuple, sliding(spark.read.parquet(source)).collect()))
    assert sum(r[2] for r in got) == 2 * rows.count()


def test_a_log_over_midnight(spark, tmp_path):
    from datetime import datetime, timedelta

    from tessera.catalog import QUERIES

    start = datetime(2024, 1, 1, 23, 59, 50)
    rows = [(k, start + timedelta(seconds=5 * k), 8, "x", float(k), "") for k in range(10)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    # two whole blocks of four lines; the last two lines are left over
    assert sorted(tuple(r) for r in QUERIES["win21_loss_blocks"](spark, str(tmp_path)).collect()) == [(0, 0, 3, 0, 1.5), (0, 1, 7, 20, 5.5)]
