"""Queries on tables that reach beyond the bounds of the test data, against plain Python."""

from tessera.catalog import QUERIES


def found(spark, path, name, **tables):
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{table}.parquet")
    return sorted(tuple(r) for r in QUERIES[name](spark, str(path)).collect())


def test_clips_of_long_conversations(spark, tmp_path):
    sizes = {1: 1, 2: 4, 3: 10, 4: 11, 5: 25}
    rows = [(c, t) for c, n in sizes.items() for t in range(n)]
    clips = [(c, s, max(min(s, n - 4), 0), max(min(s, n - 4), 0) + 3) for c, n in sizes.items() for s in range(0, n, 2)]
    assert found(spark, tmp_path, "win24_clips", conversations=(rows, "conv_id long, turn int")) == sorted(clips)


def test_rates_above_eight(spark, tmp_path):
    series = {1: [9.0] * 9 + [1.0, 9.0] * 2 + [5.0] * 5 + [3.0] * 9, 2: [30.0 - k for k in range(30)], 3: [2.0, 1.0], 4: [1.0 + k for k in range(40)]}
    # the last point is the highest, so that only long blocks average it out
    series[5] = [50.0] * 10 + [40.0] * 10 + [1.0] * 9 + [300.0]

    def rate(y):
        for r in range(1, len(y) // 3 + 1):
            a, b, c = (sum(y[len(y) - k * r:len(y) - (k - 1) * r]) / r for k in (3, 2, 1))
            if c < a and max(0, b - a, c - b) < 0.1 * (a - c):
                return r

    rows = [(1000 * c + k, c, k, y) for c, ys in series.items() for k, y in enumerate(ys)]
    expected = {c: rate(ys) for c, ys in series.items()}
    assert expected[5] == 9
    assert found(spark, tmp_path, "win14_summarize_run", orders=(rows, "o_orderkey long, o_custkey long, o_orderdate int, o_totalprice double")) == sorted(
        (c, r) for c, r in expected.items() if r)


def test_parts_with_long_keys(spark, tmp_path):
    keys = [1, 99_999, 100_000, 199_999, 1_234_567]
    assert found(spark, tmp_path, "src13_partition", part=([(k,) for k in keys], "p_partkey long")) == [
        (k, k % 4, f"{k:05d}") for k in keys]


def test_seek_runs_to_the_end(spark, tmp_path):
    assert found(spark, tmp_path, "src3_seek", part=([(k, f"p{k}") for k in range(500)], "p_partkey long, p_name string")) == [
        (k, f"p{k}") for k in range(100, 500)]
