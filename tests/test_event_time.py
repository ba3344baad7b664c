from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from aerostrata.session import scratch_dir
from aerostrata.streaming.event_time import LateRouter, append_table, join_metrics, outages, sessions

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "ts timestamp, station_id long, k long"


def _at(minutes):
    return T0 + timedelta(minutes=minutes)


def _feed(spark, parts, schema, router):
    inbox, progress = scratch_dir(spark, "inbox"), scratch_dir(spark, "progress")
    for rows in parts:
        df = spark.createDataFrame(rows, schema)
        df.coalesce(1).write.mode("append").parquet(inbox)
        router.start(spark.readStream.schema(df.schema).parquet(inbox), progress).awaitTermination()
    return df.schema


def test_router_sets_late_rows_aside_and_replays_alike(spark):
    router = LateRouter(scratch_dir(spark, "routed"), delay_s=600)
    parts = [[(_at(0), 1, 1), (_at(30), 1, 2)], [(_at(21), 1, 3), (_at(19), 1, 4), (None, 1, 5)], [(_at(60), 1, 6), (_at(20), 2, 7)]]
    schema = _feed(spark, parts, SCHEMA, router)
    assert sorted(r["k"] for r in router.late(spark, schema).collect()) == [4]
    router._route(spark.createDataFrame(parts[1], schema), 1)  # the trigger runs again
    assert sorted(r["k"] for r in router.late(spark, schema).collect()) == [4]
    path = scratch_dir(spark, "out")
    append_table(router.in_time(spark, schema), path, scratch_dir(spark, "progress")).awaitTermination()
    assert sorted(r["k"] for r in spark.read.parquet(path).collect()) == [1, 2, 3, 5, 6, 7]


def test_joined_streams_keep_observations_without_metrics_and_fan_out(spark):
    obs_schema = "ts timestamp, batch_id string, row_in_batch int, v double"
    met_schema = "ts timestamp, batch_id string, row_in_batch int, cpu_pct double"
    far = _at(10_000)
    obs = [[(_at(1), "b", 1, 1.0), (_at(0), "b", 0, 0.0)], [(_at(2), "b", 2, 2.0)], [(far, None, None, None)]]
    met = [[(_at(2), "b", 2, 20.0)], [(_at(1), "b", 1, 10.0), (_at(1), "b", 1, 11.0), (_at(30), "b", 0, 99.0)], [(far, None, None, None)]]
    sides = []
    for parts, schema in ((obs, obs_schema), (met, met_schema)):
        router = LateRouter(scratch_dir(spark, "routed"))
        sides.append(router.in_time(spark, _feed(spark, parts, schema, router)))
    path = scratch_dir(spark, "joined")
    append_table(join_metrics(*sides), path, scratch_dir(spark, "progress")).awaitTermination()
    got = sorted((r["row_in_batch"], r["cpu_pct"]) for r in spark.read.parquet(path).filter("v IS NOT NULL").collect() if r["cpu_pct"])
    assert got == [(1, 10.0), (1, 11.0), (2, 20.0)]
    assert [r["row_in_batch"] for r in spark.read.parquet(path).filter("v IS NOT NULL AND cpu_pct IS NULL").collect()] == [0]


@pytest.mark.parametrize("gap,want", [(1.0, [(0, 61.5), (62.0, 130.0)]), (2.0, [])])
def test_outages_between_sessions(spark, gap, want):
    minutes = [0, 61.5, 62.0, 130.0, 190.0, 61.7]
    rows = [(_at(m), 1, i) for i, m in enumerate(minutes)] + [(_at(5), 2, 9)]
    router = LateRouter(scratch_dir(spark, "routed"), delay_s=86_400)
    schema = _feed(spark, [rows[::-1], [(_at(100_000), None, None)]], SCHEMA, router)
    path = scratch_dir(spark, "sessions")
    stream = sessions(router.in_time(spark, schema), gap, 86_400, time="ts")
    append_table(stream, path, scratch_dir(spark, "progress")).awaitTermination()
    closed = spark.read.parquet(path).filter("station_id IS NOT NULL")
    assert closed.agg(F.sum("n_rows")).first()[0] == len(rows)
    got = [(r["gap_start"], r["gap_end"]) for r in outages(closed).orderBy("gap_start").collect()]
    naive = [(_at(a).replace(tzinfo=None), _at(b).replace(tzinfo=None)) for a, b in want]
    assert [(a.astimezone(timezone.utc).replace(tzinfo=None), b.astimezone(timezone.utc).replace(tzinfo=None)) for a, b in got] == naive
