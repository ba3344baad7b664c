"""Is data still arriving: one status row, and gaps in the history of every station."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from aerostrata.functions.scalar import as_instant, hours_between, micros
from aerostrata.schema import ALERT_HOURS, ALERT_ZONE, GAP_HOURS


def _now(now: datetime | str | Column | None) -> Column:
    if now is None:
        return F.current_timestamp()
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp")


def in_alert_window(now: Column, zone: str = ALERT_ZONE, hours: tuple[int, int] = ALERT_HOURS) -> Column:
    """Whether the local hour lies in [first, last)."""
    local = F.hour(F.from_utc_timestamp(now, zone))
    return (local >= hours[0]) & (local < hours[1])


def freshness_status(
    obs: DataFrame,
    now: datetime | str | Column | None = None,
    gap_hours: float = GAP_HOURS,
    zone: str = ALERT_ZONE,
) -> DataFrame:
    """One row: outside_window, no_data, stale or fresh, with the age and the alert text."""
    at = _now(now)
    last = obs.agg(F.max(as_instant("measured_at")).alias("last_measured_at"))
    age = hours_between(at, F.col("last_measured_at"))
    status = (
        F.when(~in_alert_window(at, zone), "outside_window")
        .when(F.col("last_measured_at").isNull(), "no_data")
        .when(age > gap_hours, "stale")
        .otherwise("fresh")
    )
    return _with_message(
        last.withColumns({"checked_at": at, "age_hours": age, "status": status}), zone
    )


def _with_message(rows: DataFrame, zone: str) -> DataFrame:
    def two_zones(col: str) -> list[Column]:
        return [
            F.date_format(col, "yyyy-MM-dd HH:mm"),
            F.date_format(F.from_utc_timestamp(col, zone), "yyyy-MM-dd HH:mm"),
        ]

    place = zone.split("/")[-1]
    stale = F.format_string(
        f"No new row for %.1f hours. Last reading %s UTC (%s {place}), checked %s UTC (%s {place}).",
        "age_hours", *two_zones("last_measured_at"), *two_zones("checked_at"),
    )
    empty = F.format_string(
        f"No rows at all. Checked %s UTC (%s {place}).", *two_zones("checked_at")
    )
    return rows.withColumn(
        "message", F.when(F.col("status") == "stale", stale).when(F.col("status") == "no_data", empty)
    )


def check_table(
    spark: SparkSession, table: str, now: datetime | str | None = None, **options
) -> DataFrame:
    """Freshness of a named table; a read that fails becomes a `check_failed` row."""
    try:
        found = freshness_status(spark.table(table), now, **options)
        return spark.createDataFrame(found.collect(), found.schema)  # one row: the read is now
    except Exception as error:  # any failure of the source is the finding
        return spark.range(1).select(
            F.lit(None).cast("timestamp").alias("last_measured_at"),
            _now(now).alias("checked_at"),
            F.lit(None).cast("double").alias("age_hours"),
            F.lit("check_failed").alias("status"),
            F.lit(str(error)).alias("message"),
        )


def data_gaps(obs: DataFrame, gap_hours: int = GAP_HOURS, time: str = "measured_at") -> DataFrame:
    """Pauses of more than `gap_hours` between consecutive readings of a station.

    Readings further apart than the limit lie in different cells of that width, so each cell is
    reduced to its first and last reading before anything is shuffled, and the order window sees
    one row per station and cell.
    """
    width = gap_hours * 3_600_000_000
    cells = (
        obs.filter(F.col(time).isNotNull())
        .groupBy("station_id", F.floor(micros(time) / F.lit(width)).alias("_cell"))
        .agg(F.min(time).alias("_first"), F.max(time).alias("gap_start"))
    )
    ordered = Window.partitionBy("station_id").orderBy("_cell")
    gaps = cells.select(
        "station_id",
        F.lag("gap_start").over(ordered).alias("gap_start"),
        F.col("_first").alias("gap_end"),
    )
    hours = hours_between(F.col("gap_end"), F.col("gap_start"))
    return gaps.withColumn("gap_hours", hours).filter(F.col("gap_hours") > gap_hours)
