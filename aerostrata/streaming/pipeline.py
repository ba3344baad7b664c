"""Streaming sources and the jobs around the count window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from aerostrata.functions.scalar import as_instant, clean_nan
from aerostrata.operators.features import batch_features
from aerostrata.operators.freshness import freshness_status
from aerostrata.plans.scoring import score_features
from aerostrata.schema import OBSERVATIONS
from aerostrata.session import materialize
from aerostrata.sources.files import CORRUPT


def observation_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType = OBSERVATIONS,
    fmt: str = "parquet",
    files_per_trigger: int | None = None,
    **options: str,
) -> DataFrame:
    """Observations as files arrive in a folder."""
    reader = spark.readStream.schema(schema).format(fmt).options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return clean_nan(reader.load(path))


def kafka_observations(
    spark: SparkSession, servers: str, topic: str, schema: T.StructType = OBSERVATIONS, **options: str
) -> DataFrame:
    """Observations as JSON messages of a topic (needs the Kafka connector on the class path).

    A message that cannot be read is a row with its text in `_corrupt_record`; the count window
    writes those to a table of their own.
    """
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .options(**options)
        .load()
    )
    return parse_messages(raw, schema)


def parse_messages(raw: DataFrame, schema: T.StructType = OBSERVATIONS) -> DataFrame:
    """Fields of the JSON text in `value`, and in `_corrupt_record` the text of an unreadable one."""
    text = F.col("value").cast("string")
    wanted = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json(text, wanted, {"columnNameOfCorruptRecord": CORRUPT})
    # No text at all is unreadable too.
    bad = F.when(F.col("o").isNull(), F.coalesce(text, F.lit(""))).otherwise(F.col(f"o.{CORRUPT}"))
    read = raw.select(text.alias("value"), parsed.alias("o"))
    return clean_nan(read.select(*[F.col(f"o.{f.name}") for f in schema], bad.alias(CORRUPT)))


def drop_repeats(stream: DataFrame, keys: list[str], time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Drop re-sent rows with a bounded memory of recent keys."""
    timed = stream.withColumn(time, as_instant(time))
    return timed.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def write_metrics(metrics: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Metrics bypass the batches: one row per cycle goes straight to its table, exactly once."""
    by_day = metrics.withColumn("day", F.to_date("ts"))
    return (
        by_day.writeStream.format("parquet")
        .partitionBy("day")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def scorer(
    models: Callable[[], dict[str, tuple[str, PipelineModel]]], path: str, missing: str = "mean",
    readings: Callable[[DataFrame], DataFrame] | None = None,
) -> Callable[[DataFrame, int], None]:
    """A hook for closed batches that writes their predictions by epoch.

    `models` is asked in every trigger, so a newly saved model is used from the next one on.
    """

    def score(closed: DataFrame, epoch: int) -> None:
        obs = readings(closed) if readings else closed
        features = materialize(closed.sparkSession, batch_features(obs), "features")
        scored = score_features(features, models(), missing)
        scored.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return score


def watch_freshness(
    ticks: DataFrame, read: Callable[[], DataFrame], path: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """A status row per tick of a clock stream (for example a `rate` source)."""

    def check(_: DataFrame, epoch: int) -> None:
        freshness_status(read()).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return (
        ticks.writeStream.foreachBatch(check)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 minutes"}))
        .start()
    )
