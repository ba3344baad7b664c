import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from aerostrata.operators import ordering
from aerostrata.operators.ordering import add_position, cut_series, running_sum

START = datetime(2024, 1, 1)


def _rows(n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        station = None if i % 11 == 0 else (0 if i % 3 else i % 5)  # one busy station, one NULL
        at = None if i % 17 == 0 else START + timedelta(seconds=rng.choice([0, 1, 5, 3600, 7300, 90000]))
        rows.append((station, i, at, float(rng.randint(0, 9))))
    return rows


def _expected(rows, keyed):
    order = sorted(rows, key=lambda r: (r[2] is None, r[2] or START, r[1]))
    seen, out = {}, {}
    for r in order:
        key = r[0] if keyed else "all"
        out[r[1]] = seen.get(key, 0)
        seen[key] = out[r[1]] + 1
    return out


@pytest.mark.parametrize("partitions", [1, 2, 7])
@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("hot", [1_000_000, 5])
def test_positions_are_exact(spark, partitions, keyed, hot):
    rows = _rows()
    df = spark.createDataFrame(rows, "station bigint, id bigint, ts timestamp, x double")
    placed = add_position(
        df.repartition(partitions), "ts", "id", keys=["station"] if keyed else None, min_hot_rows=hot
    )
    assert placed.columns == ["station", "id", "ts", "x", "position"]
    assert {r["id"]: r["position"] for r in placed.collect()} == _expected(rows, keyed)


def test_hot_cells_spread_over_parts(spark):
    # One instant holds nearly all rows: it is cut along the tie.
    rows = [(i, START if i else START + timedelta(days=1)) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, ts timestamp")
    from aerostrata.operators import ordering

    seen = {}
    original = ordering._cut_hot_cells

    def spy(*args):
        seen["rows"] = original(*args)
        return seen["rows"]

    ordering._cut_hot_cells = spy
    try:
        placed = add_position(df, "ts", "id", min_hot_rows=20)
    finally:
        ordering._cut_hot_cells = original
    sizes = [r["count"] for r in seen["rows"].groupBy("_cell", "_part").count().collect()]
    assert max(sizes) <= 21 and len(sizes) >= 10
    assert sorted(r["position"] for r in placed.collect()) == list(range(200))


def test_no_single_partition_sort_of_rows(spark):
    df = spark.range(1000).select(F.timestamp_seconds("id").alias("ts"), "id")
    placed = add_position(df, "ts", "id")
    plan = placed._jdf.queryExecution().executedPlan().toString()
    # The only one-task exchange is below the running sum of cell counts.
    assert plan.count("SinglePartition") <= 1


def test_running_sum_and_look_back(spark):
    df = spark.range(0, 57).select(
        F.lit(None).cast("bigint").alias("s"), F.col("id").alias("pos"), (F.col("id") % 7).cast("double").alias("x")
    )
    got = {r["pos"]: r["total"] for r in running_sum(df, "x", "pos", ["s"], "total", 10).collect()}
    total = 0.0
    for i in range(57):
        total += i % 7
        assert got[i] == total
    sliced = cut_series(df, "pos", 10, look_back=2)
    guests = sorted(r["pos"] for r in sliced.filter("_guest").collect())
    assert guests == [8, 9, 18, 19, 28, 29, 38, 39, 48, 49]
    assert sliced.filter("NOT _guest").count() == 57


def test_a_hot_instant_beside_another_row_is_cut(spark):
    hot = spark.range(5000).select(F.timestamp_seconds(F.lit(0)).alias("ts"), (F.col("id") * 977 % 5000).alias("id"))
    other = spark.sql("SELECT timestamp_seconds(1800) AS ts, -5L AS id")
    far = spark.sql("SELECT CAST(NULL AS TIMESTAMP) AS ts, 7L AS id UNION ALL SELECT NULL, 9223372036854775807L UNION ALL SELECT NULL, -9223372036854775808L")
    df = hot.unionAll(other).unionAll(far)
    seen = {}
    original = ordering._cut_hot_cells

    def spy(*args):
        seen["rows"] = original(*args)
        return seen["rows"]

    ordering._cut_hot_cells = spy
    try:
        placed = add_position(df, "ts", "id", min_hot_rows=100)
    finally:
        ordering._cut_hot_cells = original
    assert max(r["count"] for r in seen["rows"].groupBy("_cell", "_part").count().collect()) <= 100
    rows = [(r["ts"] is None, r["ts"].timestamp() if r["ts"] else 0, r["id"], r["position"]) for r in placed.collect()]
    assert [r[3] for r in sorted(rows)] == list(range(5004))


def test_rows_equal_in_time_and_tie_end_the_cutting(spark):
    df = spark.range(300).select(F.timestamp_seconds(F.lit(5)).alias("ts"), F.lit(1).alias("tie"), "id")
    placed = add_position(df, "ts", "tie", last_tie=["id"], min_hot_rows=10, total="n")
    assert sorted((r["id"], r["position"], r["n"]) for r in placed.collect()) == [(i, i, 300) for i in range(300)]
