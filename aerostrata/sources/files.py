"""CSV and JSON inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from aerostrata.functions.scalar import clean_nan, parse_time
from aerostrata.operators.features import with_batch_keys
from aerostrata.schema import OBSERVATIONS

CORRUPT = "_corrupt_record"
_TIMES = ["ts", "measured_at", "loaded_at"]


def _times_as_text(schema: T.StructType) -> T.StructType:
    return T.StructType([
        T.StructField(f.name, T.StringType() if f.name in _TIMES else f.dataType) for f in schema
    ])


def _typed(df: DataFrame) -> DataFrame:
    times = {c: parse_time(c) for c in _TIMES if c in df.columns}
    return clean_nan(df.withColumns(times) if times else df)


def _headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """First line -> files that begin with it; one narrow pass over the lines."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("place"),
    )
    first = lines.groupBy("file").agg(F.min_by("value", "place").alias("header"))
    found: dict[str, list[str]] = {}
    for row in first.collect():  # a row per file, which the reader lists anyway
        found.setdefault(row["header"], []).append(row["file"])
    return found


def read_csv(spark: SparkSession, path: str, schema: T.StructType = OBSERVATIONS) -> DataFrame:
    """Observation exports with a header each, read with the known schema by column name.

    Files may have their columns in different orders, or lack some. Lines that do not fit keep their
    readable fields; their text is in `_corrupt_record`.
    """
    groups = _headers(spark, path)
    parts = [_read_csv_alike(spark, files, schema) for files in groups.values()]
    out = parts[0] if parts else _read_csv_alike(spark, [path], schema)
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return _typed(out)


def _read_csv_alike(spark: SparkSession, files: list[str], schema: T.StructType) -> DataFrame:
    """Files of one header."""
    header = spark.read.option("header", True).csv(files[0]).columns
    known = {f.name: f for f in _times_as_text(schema)}
    fields = [known.get(c, T.StructField(c, T.StringType())) for c in header]
    wanted = T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])
    return (
        spark.read.schema(wanted)
        .option("header", True)
        .option("columnNameOfCorruptRecord", CORRUPT)
        .csv(files)
    )


def read_batch_json(
    spark: SparkSession,
    path: str,
    schema: T.StructType = OBSERVATIONS,
    multi_line: bool = True,
    default_batch: str = "inferred_batch",
    require_rows: bool = True,
    keep_rejects: bool = False,
) -> DataFrame:
    """JSON arrays of observations: one array per file, or per line with `multi_line=False`.

    A value of the wrong kind is missing, its row stays. An array that cannot be read at all is an
    error; with `keep_rejects` it is a row of its own instead, with its text in `_corrupt_record` and
    nothing else, and a row with a wrong value has the array's text there too. Unreadable times are
    missing; without batch ids or row numbers in the files, all rows form one batch in time order. An
    input without rows is an error.
    """
    wanted = T.StructType([*_times_as_text(schema).fields, T.StructField(CORRUPT, T.StringType())])
    raw = (
        spark.read.schema(wanted)
        .option("multiLine", multi_line)
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )
    fields = [f.name for f in schema]
    nothing = F.coalesce(*[F.when(F.col(c).isNotNull(), 1) for c in fields]).isNull()
    # The permissive reader gives an all-NULL row for an empty array.
    raw = raw.filter(~nothing | F.col(CORRUPT).isNotNull())
    rows, lost, batches, numbers = raw.agg(
        F.count_if(~nothing), F.count_if(nothing), F.count("batch_id"), F.count("row_in_batch")
    ).first()
    if lost and not keep_rejects:
        raise ValueError(f"{lost} arrays in {path} cannot be read")
    if require_rows and not rows:
        raise ValueError(f"{path} holds no observations")
    missing = [c for c, n in (("batch_id", batches), ("row_in_batch", numbers)) if not n]
    good = raw.filter(~nothing).drop(*missing, *([] if keep_rejects else [CORRUPT]))
    out = with_batch_keys(_typed(good), default_batch)
    if not keep_rejects:
        return out
    return out.unionByName(raw.filter(nothing).select(CORRUPT), allowMissingColumns=True)
