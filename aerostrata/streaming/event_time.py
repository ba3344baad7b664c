"""Event-time streams: late rows set aside, observations joined to metrics, sessions and outages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from aerostrata.functions.scalar import as_instant, hours_between
from aerostrata.schema import GAP_HOURS


class LateRouter:
    """Splits a stream into rows in time and late ones, each in a table below `root`.

    A row is late if it lies more than `delay_s` seconds before the latest time of all triggers before
    its own, which is what a watermark of that delay would drop downstream. Both tables and the
    high-water mark are named by epoch and depend on the epoch and the marks before it alone, so a
    replayed trigger overwrites itself. Rows without a time are in time.
    """

    def __init__(self, root: str, time: str = "ts", delay_s: int = 600):
        self.root, self.time, self.delay_s = root.rstrip("/"), time, delay_s

    def _mark(self, spark: SparkSession, epoch: int):
        """The latest time before this epoch; at most one row per trigger is read."""
        if epoch == 0:
            return None
        marks = spark.read.schema("latest timestamp, epoch long").parquet(f"{self.root}/marks")
        return marks.filter(F.col("epoch") < epoch).agg(F.max("latest")).first()[0]

    def _route(self, rows: DataFrame, epoch: int) -> None:
        spark, at = rows.sparkSession, as_instant(self.time)
        mark = self._mark(spark, epoch)
        late = F.lit(False)
        if mark is not None:
            late = F.coalesce(at < F.lit(mark) - F.expr(f"INTERVAL {self.delay_s} SECONDS"), F.lit(False))
        # Written once with the verdict as its partition; both tables are folders of it.
        rows.withColumn("late", late).write.mode("overwrite").partitionBy("late").parquet(f"{self.root}/routed/epoch={epoch}")
        seen = spark.read.parquet(f"{self.root}/routed/epoch={epoch}").agg(F.max(at).alias("latest"))
        seen.select(F.greatest("latest", F.lit(mark).cast("timestamp")).alias("latest")).coalesce(1).write.mode("overwrite").parquet(
            f"{self.root}/marks/epoch={epoch}"
        )

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return (
            stream.writeStream.foreachBatch(self._route)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

    def in_time(self, spark: SparkSession, schema) -> DataFrame:
        """The rows in time as a stream, in the order of their epochs."""
        return spark.readStream.schema(schema).parquet(f"{self.root}/routed/epoch=*/late=false")

    def late(self, spark: SparkSession, schema) -> DataFrame:
        """The late rows so far, as a table."""
        routed = spark.read.schema(f"{_ddl(schema)}, epoch long, late boolean").parquet(f"{self.root}/routed")
        return routed.filter("late").drop("epoch", "late")


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def join_metrics(observations: DataFrame, metrics: DataFrame, delay_s: int = 600, apart_s: int = 60) -> DataFrame:
    """Observations, left-joined to the metrics of their cycle, both as streams with a watermark.

    Both sides need `ts`; a metrics row of one cycle lies within `apart_s` seconds of the observation,
    which bounds what either side has to remember. An observation without metrics comes out once the
    watermark has passed it. Metrics rows that repeat a key fan out, as in the batch join.
    """
    delay = f"{delay_s} seconds"
    left = observations.withColumn("_at", as_instant("ts")).withWatermark("_at", delay)
    right = metrics.select(
        as_instant("ts").alias("_m_at"), F.col("batch_id").alias("_m_batch"), F.col("row_in_batch").alias("_m_row"),
        *[c for c in metrics.columns if c not in observations.columns],
    ).withWatermark("_m_at", delay)
    near = F.expr(f"_m_at BETWEEN _at - INTERVAL {apart_s} SECONDS AND _at + INTERVAL {apart_s} SECONDS")
    same = (F.col("batch_id") == F.col("_m_batch")) & (F.col("row_in_batch") == F.col("_m_row"))
    return left.join(right, same & near, "left_outer").drop("_at", "_m_at", "_m_batch", "_m_row")


def sessions(observations: DataFrame, gap_hours: float = GAP_HOURS, delay_s: int = 600, time: str = "measured_at") -> DataFrame:
    """Stretches of readings of a station without a pause of more than `gap_hours`: a stream of closed ones.

    A station's session is an event-time session window; it closes when the watermark has passed its
    end, so rows may arrive in any order within the delay.
    """
    at = observations.withColumn("_at", as_instant(time)).withWatermark("_at", f"{delay_s} seconds")
    window = F.session_window("_at", f"{int(gap_hours * 3600)} seconds")
    return at.groupBy(window, "station_id").agg(
        F.min(time).alias("first_at"), F.max(time).alias("last_at"), F.count(F.lit(1)).alias("n_rows")
    ).select("station_id", "first_at", "last_at", "n_rows")


def outages(closed: DataFrame) -> DataFrame:
    """The pauses between a station's closed sessions; a table of sessions has one row per outage."""
    ordered = Window.partitionBy("station_id").orderBy("first_at")
    gaps = closed.select("station_id", F.lag("last_at").over(ordered).alias("gap_start"), F.col("first_at").alias("gap_end"))
    return gaps.filter(F.col("gap_start").isNotNull()).withColumn("gap_hours", hours_between(F.col("gap_end"), F.col("gap_start")))


def append_table(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write a stream's rows as they become final, exactly once."""
    return (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )
