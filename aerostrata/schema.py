"""Table schemas, field groups and rule bounds."""

from __future__ import annotations

from pyspark.sql import types as T

# Sensor groups and their fields.
SENSOR_GROUPS = {
    "scd41": ["co2_ppm", "scd_temp_c", "scd_humidity_pct"],
    "bme688": ["bme_temp_c", "bme_humidity_pct", "pressure_hpa", "gas_resistance_ohm"],
    "sps30": [
        "mass_pm1_0", "mass_pm2_5", "mass_pm4_0", "mass_pm10",
        "number_pm0_5", "number_pm1_0", "number_pm2_5", "number_pm4_0", "number_pm10",
        "typical_size_um",
    ],
}

# Fields that become features, in feature order.
CORE_FIELDS = [
    "mass_pm1_0", "mass_pm2_5", "mass_pm4_0", "mass_pm10",
    "co2_ppm", "scd_temp_c", "scd_humidity_pct",
    "bme_temp_c", "bme_humidity_pct", "pressure_hpa",
]
SYSTEM_FIELDS = ["cpu_pct", "ram_percent"]
STATS = ["mean", "min", "max", "std", "delta", "range"]
ROLLING_FIELDS = [
    "co2_ppm_mean", "mass_pm2_5_mean", "scd_temp_c_mean", "scd_humidity_pct_mean",
    "pressure_hpa_mean",
]

# Analysis scan of the observations.
SCAN_COLUMNS = [
    "batch_id", "row_in_batch", "ts", "measured_at",
    "mass_pm1_0", "mass_pm2_5", "mass_pm4_0", "mass_pm10",
    "number_pm0_5", "number_pm1_0", "number_pm2_5", "number_pm4_0", "number_pm10",
    "typical_size_um",
    "co2_ppm", "scd_temp_c", "scd_humidity_pct",
    "bme_temp_c", "bme_humidity_pct", "pressure_hpa", "gas_resistance_ohm",
]

# Health bounds per field, range bounds per feature.
HEALTH_BOUNDS = {
    "mass_pm2_5": {"max": 15.0},
    "mass_pm10": {"max": 45.0},
    "co2_ppm": {"max": 1000.0},
    "scd_temp_c": {"min": 19.0, "max": 24.0},
    "scd_humidity_pct": {"min": 30.0, "max": 70.0},
}
RANGE_BOUNDS = {
    "mass_pm2_5_range": 15.0,
    "co2_ppm_range": 200.0,
    "scd_temp_c_range": 1.5,
    "scd_humidity_pct_range": 10.0,
    "pressure_hpa_range": 2.0,
}

# Graded alert limits.
ALERT_LIMITS = {
    "co2_ppm": {"warn": 1000.0, "critical": 2000.0},
    "mass_pm2_5": {"warn": 12.0, "critical": 35.4},
    "mass_pm10": {"warn": 45.0, "critical": 150.0},
    "scd_temp_c": {"low": 10.0, "high": 40.0},
    "scd_humidity_pct": {"low": 20.0, "high": 80.0},
}

# Batching, splits, freshness.
BATCH_SIZE = 10
MISSING_LIMIT = 0.5
CV_FOLDS = 5
ROLLING_WINDOW = 3
GAP_HOURS = 6
ALERT_HOURS = (9, 21)
ALERT_ZONE = "Europe/Kyiv"


def _fields(kind: T.DataType, names: list[str], nullable: bool = True) -> list[T.StructField]:
    return [T.StructField(n, kind, nullable) for n in names]


OBSERVATIONS = T.StructType(
    _fields(T.TimestampType(), ["ts", "measured_at", "loaded_at"], False)
    + [T.StructField("batch_id", T.StringType(), False),
       T.StructField("row_in_batch", T.IntegerType(), False)]
    + _fields(T.DoubleType(), [f for fields in SENSOR_GROUPS.values() for f in fields])
    + _fields(T.StringType(), ["sensor_status", "scd41_status", "bme688_status", "sps30_status"])
    + _fields(T.LongType(), ["station_id"])
)

MICROBATCHES = T.StructType(
    [T.StructField("batch_id", T.StringType(), False)]
    + _fields(T.TimestampType(), ["start_ts", "end_ts"], False)
    + [T.StructField("record_count", T.IntegerType(), False),
       T.StructField("is_closed", T.BooleanType(), False)]
    + _fields(T.TimestampType(), ["created_at", "closed_at"], False)
)

RUNTIME_METRICS = T.StructType(
    [T.StructField("ts", T.TimestampType(), False), T.StructField("cycle_id", T.StringType(), False),
     T.StructField("batch_id", T.StringType()), T.StructField("row_in_batch", T.IntegerType())]
    + _fields(T.DoubleType(), [
        "cycle_total_ms", "scd41_read_ms", "bme688_read_ms", "sps30_read_ms", "db_write_ms",
        "batch_state_update_ms", "total_sensor_read_ms", "cpu_pct", "ram_used_mb", "ram_percent",
        "disk_used_gb", "disk_free_gb", "process_memory_mb"])
    + [T.StructField("success", T.BooleanType()), T.StructField("error_message", T.StringType())]
    + _fields(T.DoubleType(), ["voltage_v", "current_a", "power_w", "cumulative_energy_wh"])
    + [T.StructField("power_source", T.StringType())]
)

MODEL_REGISTRY = T.StructType([
    T.StructField("model_name", T.StringType(), False),
    T.StructField("saved_at", T.TimestampType(), False),
    T.StructField("path", T.StringType(), False),
    T.StructField("metadata", T.StringType()),
])


def feature_names(fields: list[str] = CORE_FIELDS) -> list[str]:
    """Feature columns in their fixed order: all statistics of a field, field by field."""
    return [f"{field}_{stat}" for field in fields for stat in STATS]
