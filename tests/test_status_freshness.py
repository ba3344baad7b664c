from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from aerostrata.operators import energy, freshness, microbatch, status


@pytest.mark.parametrize("states, want", [
    (["ok", "ok", "ok"], "ok"), (["failed", "failed", "data_not_ready"], "failed"),
    (["ok", "data_not_ready", "ok"], "partial"), (["disabled", "unavailable", "disabled"], "failed"),
    (["disabled", "ok", "unavailable"], "ok"), (["data_not_ready", "disabled", "disabled"], "failed"),
    (["failed", "ok", "disabled"], "partial"),
])
def test_overall_status(spark, states, want):
    df = spark.createDataFrame([tuple(states)], "a string, b string, c string")
    assert df.select(status.overall_status([F.col(c) for c in "abc"])).first()[0] == want


def test_sensor_status_blanks_readings(spark):
    df = spark.createDataFrame(
        [(400.0, 20.0, 50.0, 20.0, 50.0, 1000.0, 5.0, True), (400.0, None, 50.0, 20.0, 50.0, 1000.0, 5.0, False)],
        "co2_ppm double, scd_temp_c double, scd_humidity_pct double, bme_temp_c double, bme_humidity_pct double, "
        "pressure_hpa double, mass_pm10 double, waiting boolean")
    rows = status.sensor_status(df, enabled={"bme688": False}, not_ready={"sps30": "waiting"}).collect()
    assert [r["bme688_status"] for r in rows] == ["disabled", "disabled"] and rows[0]["pressure_hpa"] is None
    assert rows[0]["sps30_status"] == "data_not_ready" and rows[0]["mass_pm10"] is None
    assert [r["scd41_status"] for r in rows] == ["ok", "failed"]
    assert [r["sensor_status"] for r in rows] == ["partial", "partial"]
    gone = status.sensor_status(df, available={"scd41": False}).first()
    assert gone["scd41_status"] == "unavailable" and gone["co2_ppm"] is None


def test_graded_alerts(spark):
    df = spark.createDataFrame(
        [(1000.0, 35.5, 45.1, 9.0, 81.0), (2000.1, None, 150.0, 40.0, 20.0)],
        "co2_ppm double, mass_pm2_5 double, mass_pm10 double, scd_temp_c double, scd_humidity_pct double")
    a, b = [[r[c] for c in r.asDict() if c.endswith("_alert")] for r in status.graded_alerts(df).collect()]
    assert a == ["normal", "critical", "warning", "low", "high"]
    assert b == ["critical", None, "warning", "normal", "normal"]


def _obs(spark, *times):
    return spark.createDataFrame([(0, t) for t in times], "station_id int, measured_at timestamp")


@pytest.mark.parametrize("now, last, want", [
    ("2024-06-10 12:00:00", "2024-06-10 06:00:00", "fresh"),  # exactly six hours is not stale
    ("2024-06-10 12:00:00", "2024-06-10 05:59:59", "stale"),
    ("2024-06-10 12:00:00", None, "no_data"),
    ("2024-06-10 18:00:00", None, "outside_window"),  # 21:00 local
    ("2024-06-10 06:00:00", "2024-06-10 05:00:00", "fresh"),  # 09:00 local
    ("2024-06-10 05:59:00", "2024-06-10 05:00:00", "outside_window"),
])
def test_freshness(spark, now, last, want):
    obs = _obs(spark, datetime.fromisoformat(last)) if last else _obs(spark)
    row = freshness.freshness_status(obs, now).first()
    assert row["status"] == want
    if want == "stale":
        assert "6.0 hours" in row["message"] and "2024-06-10 08:59 Kyiv" in row["message"]


def test_failed_check_is_a_row(spark):
    row = freshness.check_table(spark, "no_such_table", "2024-06-10 12:00:00").first()
    assert row["status"] == "check_failed" and "no_such_table" in row["message"]


def test_gaps(spark):
    t = datetime(2024, 1, 1, 5, 59)
    hours = [0, 1, 7, 13.5, 14, 40]
    gaps = freshness.data_gaps(_obs(spark, *[t + timedelta(hours=h) for h in hours])).orderBy("gap_start").collect()
    assert [round(g["gap_hours"], 3) for g in gaps] == [6.5, 26.0]  # six hours exactly is no gap


def test_energy_spreads_over_slices(spark):
    t = datetime(2024, 1, 1)
    rows = [(0, i, t + timedelta(seconds=30 * i), 2.0 + i % 3) for i in range(25)]
    df = spark.createDataFrame(rows, "station_id int, event_id int, ts timestamp, power_w double")
    got = {r["event_id"]: r["cumulative_energy_wh"] for r in energy.cumulative_energy(df, rows_per_slice=6).collect()}
    total = 0.0
    for i in range(25):
        total += (2.0 + i % 3) * 30 / 3600 if i else 0.0
        assert got[i] == pytest.approx(total)


def test_microbatch_helpers(spark):
    assert (microbatch.batch_size(), microbatch.batch_size(0), microbatch.batch_size(4)) == (10, 10, 4)
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([(7, i, t + timedelta(seconds=i)) for i in range(9)],
                               "station_id int, event_id int, ts timestamp").withColumn("measured_at", F.col("ts"))
    keyed = microbatch.assign_microbatches(df, size=4)
    headers = {r["batch_id"]: r for r in microbatch.batch_headers(keyed).collect()}
    assert [headers[b]["record_count"] for b in sorted(headers)] == [4, 4, 1]
    assert headers["s7-b00000001"]["start_ts"] == t + timedelta(seconds=4)
    assert microbatch.closed_only(keyed, 4).count() == 8
    stored = microbatch.batch_headers(keyed).filter("batch_id = 's7-b00000000'")
    assert microbatch.new_batches_only(keyed, stored).count() == 5


def test_check_of_a_table(spark):
    _obs(spark, datetime(2024, 6, 10, 11)).createOrReplaceTempView("arrived")
    row = freshness.check_table(spark, "arrived", "2024-06-10 12:00:00").first()
    assert row["status"] == "fresh" and row["age_hours"] == 1.0
