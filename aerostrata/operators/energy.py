"""Power and energy per batch and over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from aerostrata.functions.scalar import micros
from aerostrata.operators.ordering import add_position, cut_series, running_sum


def batch_energy(metrics: DataFrame) -> DataFrame:
    """Mean power and energy (power x cycle time) per batch."""
    return (
        metrics.filter(F.col("batch_id").isNotNull())
        .groupBy("batch_id")
        .agg(
            F.avg("power_w").alias("avg_power_w"),
            F.sum(F.col("power_w") * F.col("cycle_total_ms") / 3_600_000.0).alias("energy_wh"),
            F.count(F.lit(1)).alias("n_cycles"),
        )
    )


def read_times(metrics: DataFrame, parts: list[str] | None = None) -> DataFrame:
    """Total time of the sensor reads per batch, in milliseconds; an absent or missing part counts as 0."""
    names = parts or ["scd41_read_ms", "bme688_read_ms", "sps30_read_ms"]
    present = [F.coalesce(F.col(c), F.lit(0.0)) for c in names if c in metrics.columns]
    total = sum(present, F.lit(0.0))
    return (
        metrics.filter(F.col("batch_id").isNotNull())
        .groupBy("batch_id")
        .agg(F.sum(total).alias("total_sensor_read_ms"), F.count(F.lit(1)).alias("n_cycles"))
    )


def cumulative_energy(
    metrics: DataFrame,
    station: str = "station_id",
    time: str = "ts",
    tie: str = "event_id",
    rows_per_slice: int = 100_000,
) -> DataFrame:
    """Energy since the first reading of the station: power x time since the previous reading.

    Runs on equal slices of the positioned series, so a station with most of the rows is spread
    over many tasks.
    """
    positioned = add_position(metrics, time=time, tie=tie, keys=[station], out="_pos")
    sliced = cut_series(positioned, "_pos", rows_per_slice, look_back=1)
    w = Window.partitionBy(station, "_slice").orderBy("_pos")
    passed = (micros(time) - F.lag(micros(time)).over(w)) / F.lit(1e6)
    steps = (
        sliced.withColumn("_step", F.coalesce(F.col("power_w") * passed / 3600.0, F.lit(0.0)))
        .filter(~F.col("_guest"))
        .drop("_slice", "_guest")
    )
    summed = running_sum(steps, "_step", "_pos", [station], "cumulative_energy_wh", rows_per_slice)
    return summed.drop("_pos", "_step")
