"""Writers: tables, CSV export, reports and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from aerostrata.schema import MICROBATCHES, OBSERVATIONS, RUNTIME_METRICS
from aerostrata.sources.tables import conform


# Text times keep their microseconds.
TIME_FORMATS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def append_observations(obs: DataFrame, path: str, loaded_at: Column | None = None) -> None:
    """Append rows with one load time for all of them, laid out by day."""
    stamp = F.current_timestamp() if loaded_at is None else loaded_at
    _append_by_day(conform(obs.withColumn("loaded_at", stamp), OBSERVATIONS), path)


def append_headers(headers: DataFrame, path: str) -> None:
    conform(headers, MICROBATCHES).write.mode("append").parquet(path)


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Append metrics rows; fields a writer did not send are NULL."""
    _append_by_day(conform(metrics, RUNTIME_METRICS), path)


def _append_by_day(df: DataFrame, path: str) -> None:
    df.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def export_csv(obs: DataFrame, path: str, sort: list[str] | None = None) -> dict[str, int]:
    """All columns as CSV with a header, ordered by batch and row; returns the counts.

    The sort is a range shuffle, so the export is many sorted files, in order by file name.
    """
    ordered = obs.orderBy(*(sort or ["batch_id", "row_in_batch"]))
    ordered.write.mode("overwrite").options(**TIME_FORMATS).csv(
        path, header=True, nullValue="", emptyValue='""'
    )
    # Counters observed inside the write would also count the sampling pass of the sort, and a second
    # look at the input would compute it again; the files are at hand.
    back = obs.sparkSession.read.schema(_as_text(obs)).csv(path, header=True, nullValue="", emptyValue='""')
    rows, batches = back.agg(F.count(F.lit(1)), F.count_distinct("batch_id")).first()
    return {"rows": rows, "batches": batches}


def _as_text(df: DataFrame) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in df.columns])


def union_reports(reports: list[DataFrame]) -> DataFrame:
    """Stack reports; columns are the union of all, in the order first seen."""
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def nested_as_text(df: DataFrame) -> DataFrame:
    """Lists and records as JSON text, for formats that hold flat values only."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(*[
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
        for f in df.schema
    ])


def save_report(report: DataFrame, folder: str, name: str) -> tuple[str, str]:
    """Write a report as JSON and as CSV; missing values are empty in the CSV."""
    json_path, csv_path = f"{folder}/{name}.json", f"{folder}/{name}.csv"
    report.write.mode("overwrite").options(**TIME_FORMATS).json(json_path, ignoreNullFields=False)
    nested_as_text(report).write.mode("overwrite").options(**TIME_FORMATS).csv(
        csv_path, header=True, nullValue="", escape='"'
    )
    return json_path, csv_path


def save_predictions(predictions: DataFrame, folder: str, stamp: str) -> tuple[str, str]:
    return save_report(predictions, folder, f"predictions_{stamp}")
