"""Micro-batches: N consecutive observations of a station."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from aerostrata.operators.ordering import add_position
from aerostrata.schema import BATCH_SIZE


def batch_size(override: int | None = None) -> int:
    """The effective batch size; no override, or 0, means the default."""
    return override or BATCH_SIZE


def batch_key(station: Column, number: Column) -> Column:
    """Deterministic batch id from station and running number, so a replay gives the same id."""
    return F.concat(
        F.lit("s"), station.cast("string"), F.lit("-b"), F.lpad(number.cast("string"), 8, "0")
    )


def known_station(df: DataFrame, station: str = "station_id") -> DataFrame:
    """Observations of one device alone may name no station: it is station 0."""
    if station not in df.columns:
        return df.withColumn(station, F.lit(0).cast("bigint"))
    default = F.lit(0).cast(df.schema[station].dataType)
    return df.withColumn(station, F.coalesce(F.col(station), default))


def assign_microbatches(
    df: DataFrame,
    time: str = "ts",
    tie: str = "event_id",
    station: str = "station_id",
    size: int | None = None,
    closed: bool = False,
) -> DataFrame:
    """Add `batch_id` and 0-based `row_in_batch`, per station in time order.

    With `closed`, a last incomplete batch of a station is left out; the station's number of rows,
    which placement knows anyway, tells.
    """
    n = batch_size(size)
    named = known_station(df, station)
    positioned = add_position(
        named, time=time, tie=tie, keys=[station], out="_seq", total="_rows" if closed else None
    )
    number = F.floor(F.col("_seq") / n)
    if closed:
        positioned = positioned.filter((number + 1) * n <= F.col("_rows")).drop("_rows")
    return positioned.withColumns({
        "batch_id": batch_key(F.col(station), number),
        "row_in_batch": (F.col("_seq") % n).cast("int"),
    }).drop("_seq")


def batch_headers(obs: DataFrame, loaded_at: Column | None = None) -> DataFrame:
    """One header per batch: first and last measurement by position, and the row count."""
    stamp = F.current_timestamp() if loaded_at is None else loaded_at
    return (
        obs.filter(F.col("batch_id").isNotNull())
        .groupBy("batch_id")
        .agg(
            F.min_by("measured_at", "row_in_batch").alias("start_ts"),
            F.max_by("measured_at", "row_in_batch").alias("end_ts"),
            F.count(F.lit(1)).cast("int").alias("record_count"),
        )
        .withColumns({"is_closed": F.lit(True), "created_at": stamp, "closed_at": stamp})
    )


def closed_batch_ids(obs: DataFrame, size: int | None = None) -> DataFrame:
    """Ids of batches that reached their size."""
    return (
        obs.filter(F.col("batch_id").isNotNull())
        .groupBy("batch_id")
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") >= batch_size(size))
        .select("batch_id")
    )


def closed_only(obs: DataFrame, size: int | None = None) -> DataFrame:
    """Observations of full batches; a last incomplete batch waits for more rows."""
    return obs.join(closed_batch_ids(obs, size), "batch_id", "left_semi")


def new_batches_only(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Leave out batches that are already stored."""
    return new.join(stored.select("batch_id"), "batch_id", "left_anti")
