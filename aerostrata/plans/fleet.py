"""A fleet of stations derived from a generic event table.

Every event is read as one collection cycle of one of eight stations: readings are affine in the
event value, hour and day; sensors fail by event type, and now and then all sensors of all
stations are out. It lets the queries run on any table of that shape, at any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from aerostrata.operators.microbatch import assign_microbatches


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/events.parquet")


def observations(events: DataFrame, closed: bool = False) -> DataFrame:
    """Observations with batch keys, readings and sensor status; with `closed`, of full batches."""
    cycles = events.select(
        (F.col("user_id") % 8).alias("station_id"), "event_id", "ts", "event_type", "value"
    )
    keyed = assign_microbatches(cycles, time="ts", tie="event_id", station="station_id", closed=closed)
    return readings(keyed)


def readings(cycles: DataFrame) -> DataFrame:
    """Sensor columns of each cycle; keeps the batch keys when the cycles already have them."""
    outage = F.expr("floor(event_id / 200) % 25 = 0")
    kind = F.col("event_type")
    bad = {
        "scd": outage | ((kind == "error") & (F.col("event_id") % 2 == 0)),
        "sps": outage | ((kind == "signup") & (F.col("event_id") % 3 == 0)),
        "bme": (kind == "view") & (F.col("event_id") % 5 == 0),
    }
    v, hour, day = F.col("value"), F.hour("ts"), F.dayofmonth("ts")
    fields = {
        "mass_pm1_0": ("sps", v * 0.04),
        "mass_pm2_5": ("sps", v * 0.05),
        "mass_pm4_0": ("sps", v * 0.07),
        "mass_pm10": ("sps", v * 0.1),
        "co2_ppm": ("scd", F.lit(600.0) + F.lit(150) * (day % 3) + v * 0.5),
        "scd_temp_c": ("scd", F.lit(20.0) + hour / F.lit(8.0) + v * 0.004),
        "scd_humidity_pct": ("scd", F.lit(45.0) + v * 0.03),
        "bme_temp_c": ("bme", F.lit(21.0) + hour / F.lit(8.0)),
        "bme_humidity_pct": ("bme", F.lit(44.0) + v * 0.03),
        "pressure_hpa": ("bme", F.lit(1000.0) + day * 0.5 + v * 0.004),
    }
    keys = [c for c in ("batch_id", "row_in_batch") if c in cycles.columns]
    return cycles.select(
        "station_id", "event_id", "ts", F.expr("ts + INTERVAL '2' SECOND").alias("measured_at"), *keys,
        *[F.when(~bad[group], value).alias(name) for name, (group, value) in fields.items()],
        F.when(bad["scd"], "failed").otherwise("ok").alias("scd41_status"),
        F.when(bad["bme"], "failed").otherwise("ok").alias("bme688_status"),
        F.when(outage, "failed").when(bad["sps"], "data_not_ready").otherwise("ok")
        .alias("sps30_status"),
    )


def runtime_metrics(obs: DataFrame) -> DataFrame:
    """One metrics row per cycle, with one key in 17 missing and one in 41 written twice."""
    e = F.col("event_id")
    twice = e % 41 == 0
    base = obs.filter(e % 17 != 0).select("ts", "station_id", "event_id", "batch_id", "row_in_batch")
    copies = base.withColumn(
        "_copy", F.explode(F.when(twice, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    )
    second = F.col("_copy") == 1
    return copies.select(
        "ts", "station_id", "event_id",
        F.concat(F.when(second, "d").otherwise("c"), e.cast("string")).alias("cycle_id"),
        "batch_id", "row_in_batch",
        ((e * 37) % 100 + F.col("_copy")).cast("double").alias("cpu_pct"),
        (F.lit(40) + e % 20 + F.col("_copy")).cast("double").alias("ram_percent"),
        (F.lit(700) + e % 90 + 10 * F.col("_copy")).cast("double").alias("cycle_total_ms"),
        F.when(second, F.lit(3.0)).otherwise(F.lit(3.0) + (e % 5) * 0.25).alias("power_w"),
        F.when(second, F.lit(False)).otherwise(e % 29 != 0).alias("success"),
    )
