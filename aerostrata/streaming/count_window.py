"""Count windows over a stream: every N observations of a station close a micro-batch.

Rows take the next positions of their station as they arrive; within a trigger they are ordered
by time. What is open stays in a carry table: at most N - 1 rows per station. Positions inside a
trigger come from the cell method of `operators.ordering`, so one busy station is numbered by
the whole cluster and not by the one task that would own its key.

Exactly once: everything a trigger writes goes to folders named by its epoch and depends only on
the rows of the epoch and on the state of the epoch before. A replayed epoch overwrites itself.
Headers are written last and readers join rows to headers, so a batch shows up whole or not.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from aerostrata.operators.microbatch import batch_headers, batch_key, batch_size, known_station
from aerostrata.operators.ordering import add_position
from aerostrata.session import remove
from aerostrata.sources.files import CORRUPT


@dataclass
class CountWindow:
    """Sink of a stream of observations; call it through `start` or from `foreachBatch`."""

    root: str
    station: str = "station_id"
    time: str = "ts"
    tie: str = "event_id"
    size: int | None = None
    on_closed: Callable[[DataFrame, int], None] | None = None

    def _path(self, table: str, epoch: int | None = None) -> str:
        base = f"{self.root.rstrip('/')}/{table}"
        return base if epoch is None else f"{base}/epoch={epoch}"

    def __call__(self, arrived: DataFrame, epoch: int) -> None:
        spark, n = arrived.sparkSession, batch_size(self.size)
        arrived = arrived.persist()
        try:
            self._process(spark, arrived, epoch, n)
        finally:
            arrived.unpersist()

    def _process(self, spark: SparkSession, arrived: DataFrame, epoch: int, n: int) -> None:
        s, scratch = self.station, []
        if CORRUPT in arrived.columns:
            bad = F.col(CORRUPT).isNotNull()
            arrived.filter(bad).select(CORRUPT).write.mode("overwrite").parquet(self._path("rejects", epoch))
            arrived = arrived.filter(~bad).drop(CORRUPT)
        arrived = known_station(arrived, s)
        placed = add_position(arrived, self.time, self.tie, keys=[s], out="_pos", scratch=scratch)
        counts = arrived.groupBy(s).agg(F.count(F.lit(1)).alias("_new"))
        if epoch == 0:
            seen = spark.createDataFrame([], counts.withColumnRenamed("_new", "_seen").schema)
            waiting = None
        else:
            seen = spark.read.parquet(self._path("counters", epoch - 1))
            waiting = spark.read.parquet(self._path("carry", epoch - 1))
        totals = seen.join(counts, s, "full_outer").select(
            s, F.coalesce("_seen", F.lit(0)).alias("_before"),
            (F.coalesce("_seen", F.lit(0)) + F.coalesce("_new", F.lit(0))).alias("_seen"),
        )
        totals.select(s, "_seen").write.mode("overwrite").parquet(self._path("counters", epoch))

        rows = placed.join(totals, s).withColumn("_seq", F.col("_before") + F.col("_pos"))
        rows = rows.select(*arrived.columns, "_seq", "_seen")
        if waiting is not None:
            rows = rows.unionByName(waiting.join(totals.select(s, "_seen"), s))
        number = F.floor(F.col("_seq") / n)
        closed = (number + 1) * n <= F.col("_seen")
        rows.filter(~closed).drop("_seen").write.mode("overwrite").parquet(self._path("carry", epoch))

        keyed = rows.filter(closed).select(
            *arrived.columns,
            batch_key(F.col(s), number).alias("batch_id"),
            (F.col("_seq") % n).cast("int").alias("row_in_batch"),
            F.current_timestamp().alias("loaded_at"),
        )
        keyed.write.mode("overwrite").parquet(self._path("observations", epoch))
        stored = spark.read.schema(keyed.schema).parquet(self._path("observations", epoch))
        if self.on_closed is not None:
            self.on_closed(stored, epoch)
        headers = batch_headers(stored, loaded_at=F.current_timestamp())
        headers.write.mode("overwrite").parquet(self._path("headers", epoch))
        # A replay needs the state of the epoch before, nothing older.
        remove(spark, *scratch, *[self._path(t, epoch - 2) for t in ("counters", "carry") if epoch > 1])

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Run over a stream; the trigger defaults to draining what is available."""
        writer = stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def rejects(self, spark: SparkSession) -> DataFrame:
        """Messages that could not be read; they are in no batch."""
        return spark.read.schema(f"{CORRUPT} string, epoch int").parquet(self._path("rejects")).drop("epoch")

    def headers(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self._path("headers")).drop("epoch")

    def observations(self, spark: SparkSession) -> DataFrame:
        """Rows of batches whose header is stored."""
        rows = spark.read.parquet(self._path("observations"))
        done = spark.read.parquet(self._path("headers")).select("epoch", "batch_id")
        return rows.join(done, ["epoch", "batch_id"], "left_semi").drop("epoch")
