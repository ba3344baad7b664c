from datetime import datetime, timedelta
import time

from pyspark.sql import functions as F

from aerostrata.operators import microbatch
from aerostrata.streaming import CountWindow, drop_repeats, observation_stream, watch_freshness, write_metrics

START = datetime(2024, 1, 1)
SCHEMA = "station_id int, event_id int, ts timestamp, measured_at timestamp, x double"


def _cycles(spark, first, last):
    rows = [(0 if i % 4 else i % 3, i, START + timedelta(seconds=i), START + timedelta(seconds=i), float(i))
            for i in range(first, last)]
    return spark.createDataFrame(rows, SCHEMA)


def _arrive(spark, folder, first, last):
    _cycles(spark, first, last).coalesce(1).write.mode("append").parquet(str(folder))
    time.sleep(1.1)  # files are taken in order of their time


def test_stream_equals_batch_over_triggers_and_restarts(spark, tmp_path):
    source, progress = tmp_path / "in", str(tmp_path / "progress")
    window = CountWindow(str(tmp_path / "out"), size=10)
    schema = _cycles(spark, 0, 1).schema

    def run():
        stream = observation_stream(spark, str(source), schema, files_per_trigger=1)
        window.start(stream, progress).awaitTermination()

    _arrive(spark, source, 0, 37)
    _arrive(spark, source, 37, 40)  # too few to close anything new at some stations
    run()
    assert window.observations(spark).count() % 10 == 0
    _arrive(spark, source, 40, 93)
    run()  # a new query on the same checkpoint goes on where the last one stopped
    batch = microbatch.closed_only(microbatch.assign_microbatches(_cycles(spark, 0, 93)))
    columns = ["batch_id", "row_in_batch", "event_id", "x"]
    assert sorted(map(tuple, window.observations(spark).select(*columns).collect())) == sorted(
        map(tuple, batch.select(*columns).collect()))
    headers = window.headers(spark).drop("created_at", "closed_at")
    want = microbatch.batch_headers(batch).select(*headers.columns)
    assert sorted(map(tuple, headers.collect())) == sorted(map(tuple, want.collect()))


def test_a_replayed_epoch_adds_nothing(spark, tmp_path):
    closed = []
    window = CountWindow(str(tmp_path), size=5, on_closed=lambda df, epoch: closed.append((epoch, df.count())))
    window(_cycles(spark, 0, 23), 0)
    window(_cycles(spark, 23, 40), 1)
    before = sorted(map(tuple, window.observations(spark).drop("loaded_at").collect()))
    window(_cycles(spark, 23, 40), 1)
    assert sorted(map(tuple, window.observations(spark).drop("loaded_at").collect())) == before
    assert closed[1] == closed[2] and window.headers(spark).count() == len(before) / 5
    stamps = window.observations(spark).groupBy("batch_id").agg(F.count_distinct("loaded_at").alias("n"))
    assert stamps.filter("n > 1").isEmpty()


def test_rows_without_a_header_are_not_seen(spark, tmp_path):
    window = CountWindow(str(tmp_path), size=5)
    window(_cycles(spark, 0, 23), 0)
    seen = window.observations(spark).count()
    orphan = window.observations(spark).withColumn("batch_id", F.lit("s9-b00000000"))
    orphan.write.parquet(f"{tmp_path}/observations/epoch=1")
    assert window.observations(spark).count() == seen


def test_metrics_and_repeats_and_watch(spark, tmp_path):
    source = tmp_path / "in"
    _arrive(spark, source, 0, 10)
    _arrive(spark, source, 5, 12)
    stream = observation_stream(spark, str(source), _cycles(spark, 0, 1).schema)
    unique = drop_repeats(stream, ["station_id", "ts"])
    write_metrics(unique, str(tmp_path / "m"), str(tmp_path / "p1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "m")).count() == 12
    watch_freshness(stream, lambda: _cycles(spark, 0, 3), str(tmp_path / "w"), str(tmp_path / "p2"),
                    availableNow=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "w")).count() == 1


def test_unreadable_messages_are_kept_apart(spark, tmp_path):
    from aerostrata.streaming.pipeline import parse_messages

    wanted = "event_id long, ts timestamp, measured_at timestamp"
    texts = [f'{{"event_id": {i}, "ts": "2024-01-01T00:00:{i:02d}Z", "measured_at": "2024-01-01T00:00:{i:02d}Z"}}' for i in range(12)]
    raw = spark.createDataFrame([(t,) for t in [*texts, '{"event_id": 9', "no json", None]], "value string")
    from pyspark.sql.types import _parse_datatype_string

    rows = parse_messages(raw, _parse_datatype_string(wanted))
    window = CountWindow(str(tmp_path / "w"))
    window(rows, 0)
    assert window.observations(spark).count() == 10
    assert sorted(r[0] for r in window.rejects(spark).collect()) == ["", "no json", '{"event_id": 9']
    assert {r["station_id"] for r in window.observations(spark).collect()} == {0}


def test_old_state_is_removed_and_rows_without_a_station_count(spark, tmp_path):
    window = CountWindow(str(tmp_path / "w"))
    for epoch in range(4):
        window(_cycles(spark, epoch * 7, epoch * 7 + 7).withColumn("station_id", F.lit(None).cast("bigint")), epoch)
    assert window.observations(spark).count() == 20
    import os

    assert sorted(os.listdir(tmp_path / "w" / "carry")) == ["epoch=2", "epoch=3"]
    window(_cycles(spark, 21, 28).withColumn("station_id", F.lit(None).cast("bigint")), 3)  # a replay
    assert window.observations(spark).count() == 20
