import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from aerostrata import schema
from aerostrata.sources import files, frames, sinks, tables


def test_json_buffer(spark, tmp_path):
    path = tmp_path / "buffer.json"
    path.write_text(json.dumps([
        {"ts": "2024-01-01T02:00:30+02:00", "measured_at": "bad", "co2_ppm": 500.5},
        {"ts": "2024-01-01T00:00:00.250000+00:00", "co2_ppm": None, "mass_pm10": 3},
    ], indent=2))
    rows = files.read_batch_json(spark, str(path)).orderBy("row_in_batch").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz")).collect()
    assert [r["batch_id"] for r in rows] == ["inferred_batch"] * 2
    assert [r["ts"] for r in rows] == [datetime(2024, 1, 1, 0, 0, 0, 250000), datetime(2024, 1, 1, 0, 0, 30)]
    assert rows[1]["co2_ppm"] == 500.5 and rows[1]["measured_at"] is None and rows[0]["mass_pm10"] == 3.0
    empty = tmp_path / "empty.json"
    empty.write_text("[]")
    with pytest.raises(ValueError):
        files.read_batch_json(spark, str(empty))


def test_csv_with_missing_and_broken_cells(spark, tmp_path):
    path = tmp_path / "export.csv"
    path.write_text(
        "batch_id,row_in_batch,ts,measured_at,co2_ppm,note\n"
        "a,0,2024-01-01T00:00:00.5+00:00,2024-01-01 00:00:01+00:00,,x\n"
        "a,1,never,,nan,y\n"
        "a,zz,2024-01-01T00:01:00Z,,7.5,z\n")
    rows = files.read_csv(spark, str(path)).orderBy("note").collect()
    assert len(rows) == 3 and [r["co2_ppm"] for r in rows] == [None, None, 7.5]
    assert rows[1]["ts"] is None and rows[2]["row_in_batch"] is None and rows[2]["_corrupt_record"]


def test_frames(spark):
    good = bytes([0x01, 0xF4, 0, 0x66, 0x67, 0, 0x5E, 0xB9, 0])
    df = spark.createDataFrame([(bytearray(good),), (bytearray(good[:8]),), (None,)], "frame binary")
    a, b, c = frames.decode_frames(df).collect()
    assert a["co2_ppm"] == 500.0
    assert a["scd_temp_c"] == -45 + 175 * 0x6667 / 65536 and a["scd_humidity_pct"] == 100 * 0x5EB9 / 65536
    assert b["co2_ppm"] is None and c["scd_temp_c"] is None


def test_tables_and_appends(spark, tmp_path):
    assert tables.create_tables(spark) == ["microbatches", "raw_observations", "runtime_metrics"]
    assert tables.create_tables(spark) == ["microbatches", "raw_observations", "runtime_metrics"]
    part = spark.sql("SELECT TIMESTAMP'2024-01-01 00:00:00' ts, 'c1' cycle_id, 5.0D cpu_pct")
    sinks.append_metrics(part, str(tmp_path / "m"))
    sinks.append_metrics(part, str(tmp_path / "m"))
    back = spark.read.parquet(str(tmp_path / "m"))
    assert back.count() == 2 and back.first()["ram_percent"] is None
    assert set(schema.RUNTIME_METRICS.names) < set(back.columns)


def test_export_counts_rows_and_batches(spark, tmp_path):
    obs = spark.sql("SELECT concat('b', id % 3) batch_id, CAST(id AS INT) row_in_batch, CAST(NULL AS DOUBLE) x FROM range(20)")
    assert sinks.export_csv(obs, str(tmp_path / "e")) == {"rows": 20, "batches": 3}
    lines = spark.read.csv(str(tmp_path / "e"), header=True).collect()
    assert [r["batch_id"] for r in lines] == sorted(r["batch_id"] for r in lines) and lines[0]["x"] is None


def test_metrics_join_fans_out_or_not(spark):
    obs = spark.sql("SELECT 'b' batch_id, CAST(id AS INT) row_in_batch, TIMESTAMP'2024-01-01' ts, "
                    "TIMESTAMP'2024-01-01' measured_at, CAST('NaN' AS DOUBLE) co2_ppm FROM range(3)")
    metrics = spark.sql("SELECT 'b' batch_id, r row_in_batch, TIMESTAMP'2024-01-01' + make_interval(0,0,0,0,0,0,s) ts, "
                        "c cycle_id, p cpu_pct, 1.0D ram_percent FROM VALUES (0, 1, 'x', 10D), (0, 2, 'w', 20D), "
                        "(1, 1, 'y', 30D) AS t(r, s, c, p)")
    plain = tables.scan_with_metrics(obs, metrics)
    assert sorted((r["row_in_batch"], r["cpu_pct"]) for r in plain.collect() if r["cpu_pct"]) == [(0, 10), (0, 20), (1, 30)]
    assert plain.count() == 4 and plain.first()["co2_ppm"] is None
    single = tables.scan_with_metrics(obs, metrics, dedupe_metrics=True).orderBy("row_in_batch").collect()
    assert [r["cpu_pct"] for r in single] == [20, 30, None]


def test_damaged_json_loses_no_rows(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps([{"ts": "2024-01-01T00:00:00+00:00", "co2_ppm": 1.0}]))
    (tmp_path / "cell.json").write_text(json.dumps([{"co2_ppm": 2.0, "bme_temp_c": 1.5}, {"co2_ppm": "much", "bme_temp_c": 3.5}, {"co2_ppm": 4.0}]))
    (tmp_path / "cut.json").write_text('[{"co2_ppm": 5.0}, {"co2_')
    (tmp_path / "none.json").write_text("[]")
    with pytest.raises(ValueError):
        files.read_batch_json(spark, str(tmp_path))
    rows = files.read_batch_json(spark, str(tmp_path), keep_rejects=True).collect()
    kept = [r for r in rows if r["batch_id"] is not None]
    assert sorted((r["co2_ppm"] or 0, r["bme_temp_c"] or 0) for r in kept) == [(0, 3.5), (1, 0), (2, 1.5), (4, 0)]
    assert sorted(r["row_in_batch"] for r in kept) == [0, 1, 2, 3]
    lost = [r for r in rows if r["batch_id"] is None]
    assert len(lost) == 1 and "co2_" in lost[0]["_corrupt_record"]


def test_csv_files_with_columns_in_another_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("batch_id,co2_ppm,scd_temp_c\na,500,20\n")
    (tmp_path / "b.csv").write_text("batch_id,scd_temp_c,co2_ppm\nb,21,600\n")
    (tmp_path / "c.csv").write_text("batch_id,co2_ppm\nc,700\n")
    rows = files.read_csv(spark, str(tmp_path)).orderBy("batch_id").collect()
    assert [(r["batch_id"], r["co2_ppm"], r["scd_temp_c"]) for r in rows] == [("a", 500, 20), ("b", 600, 21), ("c", 700, None)]
    assert all(r["_corrupt_record"] is None for r in rows)
