from datetime import datetime, timedelta, timezone
import random

import pytest
from pyspark.sql import functions as F

from aerostrata.operators import sketches
from aerostrata.operators.energy import cumulative_energy
from aerostrata.operators.incremental import SeriesStore
from aerostrata.session import scratch_dir

SCHEMA = "station_id long, ts timestamp, event_id long, power_w double"
T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def _rows(n=300, seed=5):
    rng = random.Random(seed)
    times = sorted(rng.randrange(40_000) for _ in range(n))
    return [(rng.choice([1, 1, 1, 2, None]), T0 + timedelta(seconds=t), i, rng.choice([None, 3.0, 4.5])) for i, t in enumerate(times)]


def _placed(df):
    return {r["event_id"]: (r["seq"], r["total"]) for r in df.collect()}


@pytest.mark.parametrize("slice_rows", [7])
def test_appends_equal_one_full_run(spark, slice_rows):
    rows = _rows()
    whole = SeriesStore(scratch_dir(spark, "series"), rows_per_slice=slice_rows)
    whole.append(spark.createDataFrame(rows, SCHEMA), 0)
    want = _placed(whole.rows(spark))
    parts = SeriesStore(scratch_dir(spark, "series"), rows_per_slice=slice_rows)
    for k, (lo, hi) in enumerate([(0, 100), (100, 101), (101, 300)]):
        parts.append(spark.createDataFrame(rows[lo:hi], SCHEMA), k)
    got = _placed(parts.rows(spark))
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1], abs=1e-9) for k in want)
    full = cumulative_energy(spark.createDataFrame(rows, SCHEMA))
    assert all(got[r["event_id"]][1] == pytest.approx(r["cumulative_energy_wh"], abs=1e-9) for r in full.collect())


def test_an_append_reads_the_state_and_no_older_row(spark):
    rows = _rows()
    first = SeriesStore(scratch_dir(spark, "series"), look_back=3)
    first.append(spark.createDataFrame(rows[:200], SCHEMA), 0)
    # A store that holds nothing but the state goes on alike.
    bare = SeriesStore(scratch_dir(spark, "series"), look_back=3)
    for table in ("state", "tail"):
        kept = spark.read.parquet(first._path(table, 0))
        assert kept.count() <= 3 * (1 if table == "state" else 3)  # stations x rows looked back to
        kept.write.parquet(bare._path(table, 0))
    for store in (first, bare):
        store.append(spark.createDataFrame(rows[200:], SCHEMA), 1)
    assert _placed(bare.rows(spark)) == {k: v for k, v in _placed(first.rows(spark)).items() if k >= 200}


def test_rows_before_the_last_one_are_set_aside_and_a_rerun_changes_nothing(spark):
    rows = _rows(60)
    store = SeriesStore(scratch_dir(spark, "series"))
    store.append(spark.createDataFrame(rows[:40], SCHEMA), 0)
    late = [(r[0], r[1] - timedelta(days=1), r[2] + 1000, r[3]) for r in rows[40:43]]
    new = spark.createDataFrame(rows[40:] + late + [(9, T0, 5000, 1.0)], SCHEMA)
    store.append(new, 1)
    once = _placed(store.rows(spark))
    store.append(new, 1)
    assert _placed(store.rows(spark)) == once
    assert {r["event_id"] for r in store.late(spark, SCHEMA).collect()} == {r[2] for r in late}
    assert once[5000] == (0, 0.0)


def test_merged_sketches_of_days_keep_their_bounds(spark):
    rng = random.Random(8)
    values = [rng.gauss(0, 1) for _ in range(20_000)]
    rows = [(T0 + timedelta(hours=i % 240), i % 5000, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "ts timestamp, k long, v double")
    days = sketches.daily_sketches(df, ["k"], ["v"])
    assert days.count() == 10
    got = sketches.estimates(sketches.merged(days), [0.01, 0.5, 0.99]).first()
    assert got["n_rows"] == 20_000 and abs(got["distinct_k"] - 5000) <= sketches.HLL_ERROR * 5000
    for q in (0.01, 0.5, 0.99):
        rank = sum(v <= got[f"q{round(q * 100)}_v"] for v in values) / len(values)
        assert abs(rank - q) <= sketches.KLL_ERROR
    one = sketches.estimates(sketches.merged(days.filter(F.col("day") == "2024-01-02")), [0.5]).first()
    assert one["n_rows"] == 24 * (20_000 // 240) + min(24, max(0, 20_000 % 240 - 24))
