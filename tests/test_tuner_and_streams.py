import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import elementwise as e
from tessera.operators.tuner import Tunable, Tuner, density_search, grid_search, marginal_grid, slopes
from tessera.streaming.progress import REPORT, complete_clocks, windowed

SPACE = [Tunable("lr", "log", -2, 0), Tunable("slack", "discrete", values=(0, 1, 3))]


def test_grids():
    points = list(grid_search(SPACE, 2))
    assert len(points) == 9 and points[1] == {"lr": 0.1, "slack": 0}
    assert len(list(marginal_grid(SPACE, {"lr": 0.1, "slack": 1}, 2))) == 5


def test_density_search_prefers_good_points():
    space, results = [Tunable("x", "linear", -1, 1)], []
    points = density_search(space, 3, results)
    for _ in range(40):
        p = next(points)
        results.append((p, p["x"] ** 2))
    late = [abs(p["x"]) for p, _ in results[20:]]
    assert sum(late) / len(late) < 0.4


def test_search_keeps_the_steepest_branch(spark):
    def run(branch, point, a, b):
        rate = point["lr"]
        return spark.createDataFrame([(branch, k, 10.0 * math.exp(-rate * k)) for k in range(a, b)], "branch int, k long, y double")

    tuner = Tuner(run, iter([{"lr": 0.01}, {"lr": 0.5}, {"lr": -3.0}]), trials=3)
    assert tuner.search() == (1, {"lr": 0.5})
    assert ("killed", 2) in tuner.log


def test_states(spark):
    rows = [(0, k, y) for k, y in enumerate([4.0, 3.0, 1.0])] + [(1, k, y) for k, y in enumerate([1.0, 20.0])] + [
        (2, k, y) for k, y in enumerate([3.0, 5.0, 2.0])] + [(3, 0, 1.0)]
    found = {r.branch: r.state for r in slopes(spark.createDataFrame(rows, "branch int, k long, y double")).collect()}
    assert found == {0: "CONVERGING", 1: "DIVERGED", 2: "UNSTABLE"}


def test_complete_clocks(spark, tmp_path):
    rows = [(0, 0, 0, 1.0), (1, 0, 0, 3.0), (1, 0, 0, 9.0), (0, 0, 1, 5.0)]
    spark.createDataFrame(rows, REPORT).coalesce(1).write.parquet(f"{tmp_path}/in")
    q = complete_clocks(spark.readStream.schema(REPORT).parquet(f"{tmp_path}/in"), 2).writeStream.format("memory").queryName(
        "clocks").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("select * from clocks").collect()] == [(0, 0, 2.0)]


def test_windows_stream_as_in_batch(spark):
    d = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(d)
    q = windowed(spark.readStream.schema(batch.schema).parquet(d.replace("events.parquet", "events.parquet*")), width="1 day").writeStream.format(
        "memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((str(r.start), r.event_type, r.n) for r in df.collect())
    assert key(spark.table("windows")) == key(windowed(batch, width="1 day"))


@pytest.mark.parametrize("f,bwd", [(e.sigmoid, lambda x: e.sigmoid(x) * (1 - e.sigmoid(x))), (F.tanh, lambda x: 1 - F.tanh(x) * F.tanh(x)),
                                   (e.bnll, e.sigmoid), (e.elu, lambda x: F.when(x > 0, 1.0).otherwise(F.exp(x)))])
def test_gradients_agree_with_differences(spark, f, bwd):
    x = F.col("x")
    df = spark.createDataFrame([(v,) for v in (-2.0, -0.3, 0.4, 1.7)], "x double")
    for r in df.select(((f(x + 1e-5) - f(x - 1e-5)) / 2e-5).alias("a"), bwd(x).alias("b")).collect():
        assert abs(r.a - r.b) < 1e-6


def test_pooling_windows_follow_the_size_rule():
    assert {c[:2] for c in e.cells(4, 4, 3, 2, 0)} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    assert max(c[0] for c in e.cells(4, 4, 3, 2, 1)) == 2
    assert e.cells(3, 5, 2, 1, 0)[-1][:2] == (1, 3)
