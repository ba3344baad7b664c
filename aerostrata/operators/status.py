"""Sensor and observation status, graded alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from aerostrata.schema import ALERT_LIMITS, SENSOR_GROUPS

INACTIVE = ["disabled", "unavailable"]
NOT_DELIVERING = ["failed", "data_not_ready"]


def group_status(
    columns: list[str],
    group: str,
    enabled: bool = True,
    available: bool = True,
    not_ready: Column | None = None,
) -> Column:
    """Status of one sensor group from its readings: ok only when every field has a value."""
    if not enabled:
        return F.lit("disabled")
    fields = [f for f in SENSOR_GROUPS[group] if f in columns]
    if not available or not fields:
        return F.lit("unavailable")
    complete = F.lit(True)
    for f in fields:
        complete = complete & F.col(f).isNotNull()
    status = F.when(complete, "ok").otherwise("failed")
    if not_ready is None:
        return status
    return F.when(F.coalesce(not_ready, F.lit(False)), "data_not_ready").otherwise(status)


def overall_status(statuses: list[Column]) -> Column:
    """ok, partial or failed over the active groups; no active group is a failure."""
    active = sum((~s.isin(INACTIVE)).cast("int") for s in statuses)
    good = sum((s == "ok").cast("int") for s in statuses)
    down = sum(s.isin(NOT_DELIVERING).cast("int") for s in statuses)
    return (
        F.when(active == 0, "failed")
        .when(good == active, "ok")
        .when(down == active, "failed")
        .otherwise("partial")
    )


def sensor_status(
    readings: DataFrame,
    enabled: dict[str, bool] | None = None,
    available: dict[str, bool] | None = None,
    not_ready: dict[str, str] | None = None,
) -> DataFrame:
    """Add the status of each group and of the observation.

    `not_ready` names a boolean column per group that is true while the sensor had no data yet;
    readings of a disabled, unavailable or not-ready group are blanked.
    """
    enabled, available, not_ready = enabled or {}, available or {}, not_ready or {}
    out = readings
    for group, fields in SENSOR_GROUPS.items():
        flag = F.col(not_ready[group]) if group in not_ready else None
        status = group_status(
            readings.columns, group, enabled.get(group, True), available.get(group, True), flag
        )
        out = out.withColumn(f"{group}_status", status)
        blank = F.col(f"{group}_status").isin([*INACTIVE, "data_not_ready"])
        out = out.withColumns({
            f: F.when(~blank, F.col(f)) for f in fields if f in readings.columns
        })
    return out.withColumn(
        "sensor_status", overall_status([F.col(f"{g}_status") for g in SENSOR_GROUPS])
    )


def graded_alerts(df: DataFrame, limits: dict = ALERT_LIMITS) -> DataFrame:
    """Add `{field}_alert`: warning and critical levels, or low and high bounds."""
    out = {}
    for field, level in limits.items():
        x = F.col(field)
        if "critical" in level:
            grade = F.when(x > level["critical"], "critical").when(x > level["warn"], "warning")
        else:
            grade = F.when(x < level["low"], "low").when(x > level["high"], "high")
        out[f"{field}_alert"] = grade.when(x.isNotNull(), "normal")
    return df.withColumns(out)
