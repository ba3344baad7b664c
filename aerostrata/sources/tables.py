"""Table scans: observations, and observations with runtime metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from aerostrata.functions.scalar import clean_nan
from aerostrata.schema import (
    MICROBATCHES, OBSERVATIONS, RUNTIME_METRICS, SCAN_COLUMNS, SYSTEM_FIELDS,
)

TABLES = {
    "raw_observations": OBSERVATIONS,
    "microbatches": MICROBATCHES,
    "runtime_metrics": RUNTIME_METRICS,
}


def create_tables(spark: SparkSession, database: str = "default") -> list[str]:
    """Create the three tables where absent; observations and metrics are laid out by day."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, schema in TABLES.items():
        columns = ", ".join(
            f"{f.name} {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in schema
        )
        by_day = name != "microbatches"
        day = ", day DATE" if by_day else ""
        layout = " PARTITIONED BY (day)" if by_day else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}{day}) USING parquet{layout}")
    return sorted(t.name for t in spark.catalog.listTables(database) if t.name in TABLES)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of `schema` in order and type; absent ones are NULL, others are left out."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema
    ])


def scan_observations(observations: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """The analysis columns with NaN turned into NULL; absent columns are NULL.

    Nothing is sorted: operators that need an order state it themselves.
    """
    present = set(observations.columns)
    chosen = observations.select(*[
        F.col(c) if c in present else F.lit(None).cast("double").alias(c)
        for c in [*SCAN_COLUMNS, *(extra or [])]
    ])
    return clean_nan(chosen)


def latest_metrics(metrics: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The latest metrics row of every (batch_id, row_in_batch)."""
    keys, order = ["batch_id", "row_in_batch"], ["ts", "cycle_id"]
    rest = [c for c in columns or metrics.columns if c not in (*keys, *order)]
    latest = metrics.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_latest"))
    return latest.select(*keys, *[F.col(f"_latest.{c}").alias(c) for c in (*order, *rest)])


def scan_with_metrics(
    observations: DataFrame,
    metrics: DataFrame,
    dedupe_metrics: bool = False,
    extra: list[str] | None = None,
    keep_cycle: bool = False,
) -> DataFrame:
    """Observations left-joined to system load on (batch_id, row_in_batch).

    The key is not unique in the metrics, so a plain join can repeat observations;
    `dedupe_metrics` keeps the latest metrics row per key.
    """
    keys = ["batch_id", "row_in_batch"]
    load = clean_nan(metrics.select(*keys, "ts", "cycle_id", *SYSTEM_FIELDS))
    if dedupe_metrics:
        load = latest_metrics(load)
    load = load.select(*keys, *SYSTEM_FIELDS, *["cycle_id"] * keep_cycle)
    return scan_observations(observations, extra).join(load, keys, "left")
