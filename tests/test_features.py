import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from aerostrata.operators import features as ft, labels, microbatch
from aerostrata.schema import CORE_FIELDS, feature_names
from aerostrata.sources.tables import scan_observations

START = datetime(2024, 1, 1)
SCHEMA = "batch_id string, row_in_batch int, ts timestamp, measured_at timestamp, " + ", ".join(
    f"{f} double" for f in CORE_FIELDS
)


def _obs(spark, rows):
    """rows: (batch, row, {field: value}); other fields are missing."""
    return spark.createDataFrame(
        [(b, i, START + timedelta(seconds=30 * i), START + timedelta(seconds=30 * i + 1),
          *[v.get(f) for f in CORE_FIELDS]) for b, i, v in rows],
        SCHEMA,
    )


def _stats(spark, rows):
    return {r["batch_id"]: r for r in ft.batch_statistics(_obs(spark, rows)).collect()}


def test_statistics_of_edge_batches(spark):
    got = _stats(spark, [
        ("one", 0, {"co2_ppm": None}), ("one", 1, {"co2_ppm": 500.0}),
        ("none", 0, {}), ("none", 1, {}),
        ("many", 3, {"co2_ppm": 7.0}), ("many", 0, {"co2_ppm": None}), ("many", 1, {"co2_ppm": 4.0}),
        ("many", 2, {"co2_ppm": 1.0}), ("many", 4, {"co2_ppm": None}),
        (None, 0, {"co2_ppm": 1.0}),
    ])
    assert set(got) == {"one", "none", "many"}  # rows without a batch vanish
    one = got["one"]
    assert (one["co2_ppm_mean"], one["co2_ppm_std"], one["co2_ppm_delta"], one["co2_ppm_range"]) == (500, 0, 0, 0)
    assert all(got["none"][f"co2_ppm_{s}"] is None for s in ("mean", "min", "max", "std", "delta", "range"))
    many = got["many"]
    assert (many["co2_ppm_mean"], many["co2_ppm_min"], many["co2_ppm_max"]) == (4, 1, 7)
    assert many["co2_ppm_std"] == pytest.approx(3.0)
    assert many["co2_ppm_delta"] == 3.0 and many["co2_ppm_range"] == 6.0  # 7 (row 3) - 4 (row 1)


def test_nan_is_missing(spark):
    obs = _obs(spark, [("b", i, {"co2_ppm": math.nan if i == 1 else None if i == 2 else 5.0 + i}) for i in range(4)])
    row = ft.batch_statistics(scan_observations(obs)).first()
    assert row["co2_ppm_max"] == 8.0 and row["co2_ppm_mean"] == 6.5
    assert labels.health_labels(ft.batch_statistics(scan_observations(obs))).first()["health_risk"] == 0


def test_batches_longer_than_the_size_and_repeated_rows(spark):
    rows = [("long", i, {"co2_ppm": float(i)}) for i in range(11)] + [("long", 3, {"co2_ppm": 3.0})]
    row = ft.batch_statistics(_obs(spark, rows), rows="n").first()
    assert row["n"] == 12 and row["co2_ppm_delta"] == 10.0
    assert microbatch.closed_only(_obs(spark, rows)).count() == 12


def test_half_missing_is_kept_more_is_dropped(spark):
    half, less = CORE_FIELDS[:5], CORE_FIELDS[:4]
    rows = [(b, i, {f: 1.0 for f in fs}) for b, fs in (("half", half), ("less", less)) for i in range(10)]
    kept = ft.batch_features(_obs(spark, rows)).select("batch_id").collect()
    assert [r["batch_id"] for r in kept] == ["half"]


def test_absent_field_and_absent_keys(spark):
    bare = _obs(spark, [("x", i, {f: float(i) for f in CORE_FIELDS}) for i in range(3)]).drop(
        "batch_id", "row_in_batch", "pressure_hpa"
    )
    keyed = ft.with_batch_keys(bare)
    assert sorted(r["row_in_batch"] for r in keyed.collect()) == [0, 1, 2]
    row = ft.batch_features(keyed).first()
    assert row["batch_id"] == "batch_0" and row["co2_ppm_delta"] == 2.0 and row["pressure_hpa_mean"] is None


def test_feature_names_order():
    names = feature_names()
    assert len(names) == 60
    assert names[:7] == ["mass_pm1_0_mean", "mass_pm1_0_min", "mass_pm1_0_max", "mass_pm1_0_std",
                         "mass_pm1_0_delta", "mass_pm1_0_range", "mass_pm2_5_mean"]


def test_statistics_are_one_hash_aggregate_with_one_shuffle(spark):
    plan = ft.batch_statistics(_obs(spark, []), time="ts")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "ObjectHashAggregate" not in plan and "SortAggregate" not in plan


def test_temporal_features_without_a_time(spark):
    df = spark.createDataFrame([("a", datetime(2024, 1, 7, 18)), ("b", None)], "batch_id string, batch_ts timestamp")
    got = {r["batch_id"]: r for r in ft.temporal_features(df).collect()}
    assert got["a"]["day_of_week"] == 6.0 and got["a"]["hour_sin"] == pytest.approx(-1.0)
    assert (got["b"]["hour_sin"], got["b"]["hour_cos"], got["b"]["day_of_week"]) == (0.0, 1.0, 0.0)


def test_unreadable_times_are_ignored(spark):
    obs = spark.createDataFrame(
        [("a", "2024-01-02T00:00:00+00:00"), ("a", "2024-01-01T02:00:00+02:00"), ("a", "soon"), ("b", "?")],
        "batch_id string, ts string")
    got = {r["batch_id"]: r["batch_ts"] for r in ft.batch_timestamps(obs).withColumn(
        "batch_ts", F.col("batch_ts").cast("timestamp_ntz")).collect()}
    assert got == {"a": datetime(2024, 1, 1), "b": None}


@pytest.mark.parametrize("slice_rows", [4, 100_000])
def test_rolling_mean_skips_missing_across_slices(spark, slice_rows):
    values = [None, 3.0, None, None, None, 6.0, 9.0, 12.0, None, 1.0]
    df = spark.createDataFrame(
        [(f"b{i}", START + timedelta(minutes=i), v) for i, v in enumerate(values)],
        "batch_id string, batch_ts timestamp, co2_ppm_mean double")
    got = ft.rolling_features(df, fields=["co2_ppm_mean", "absent"], rows_per_slice=slice_rows)
    rolled = [r["co2_ppm_mean_roll3"] for r in got.orderBy("batch_ts").collect()]
    want = []
    for i in range(len(values)):
        valid = [v for v in values[max(0, i - 2): i + 1] if v is not None]
        want.append(sum(valid) / len(valid) if valid else None)
    assert rolled == want


def test_rules_are_strict_and_null_safe(spark):
    df = spark.createDataFrame(
        [("edge", 15.0, 19.0, 1.5), ("over", 15.1, 19.0, 1.5), ("cold", 1.0, 18.9, 1.6), ("gone", None, None, None)],
        "batch_id string, mass_pm2_5_max double, scd_temp_c_min double, scd_temp_c_range double")
    got = {r["batch_id"]: (r["health_risk"], r["anomaly"])
           for r in labels.anomaly_labels(labels.health_labels(df)).collect()}
    assert got == {"edge": (0, 0), "over": (1, 0), "cold": (1, 1), "gone": (0, 0)}


def test_injection(spark):
    df = spark.createDataFrame(
        [(f"b{i}", float(i), 5.0, None if i % 2 else 1.0 * i) for i in range(331)],
        "batch_id string, a_range double, flat_range double, c_range double")
    out = labels.inject_anomalies(df)
    both = df.join(out.select("batch_id", F.col("a_range").alias("a2"), F.col("flat_range").alias("f2"),
                              F.col("c_range").alias("c2"), "synthetic_anomaly"), "batch_id").collect()
    assert sum(r["synthetic_anomaly"] for r in both) == int(331 * 0.02)
    assert all(r["f2"] == 5.0 for r in both)  # no spread, no shift, still labelled
    assert all(r["c2"] is None for r in both if r["c_range"] is None)
    assert all(r["a2"] == r["a_range"] and r["c2"] == r["c_range"] for r in both if not r["synthetic_anomaly"])
    assert labels.inject_anomalies(df.limit(3)).agg(F.sum("synthetic_anomaly")).first()[0] == 1
    with pytest.raises(ValueError):
        labels.inject_anomalies(df.select("batch_id"))
