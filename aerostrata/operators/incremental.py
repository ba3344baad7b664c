"""Positions and running sums of series that grow: new rows are placed without reading the old ones.

After every append a store keeps, per series, how many rows it has, its running total and its last few
rows. An append reads that state and the new rows only, numbers the new rows behind the old ones and adds
their steps to the total; a look-back of a rolling window or lag ends in the kept rows. Everything
an append writes is named by its number and depends on that number's state alone, so an append that
runs again overwrites itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from aerostrata.functions.scalar import micros
from aerostrata.operators.ordering import add_position, cut_series, running_sum
from aerostrata.session import remove

Step = Callable[[Callable[[str], Column]], Column]


def energy_step(previous: Callable[[str], Column], time: str = "ts", power: str = "power_w") -> Column:
    """Power times the hours since the previous row; none for the first row."""
    passed = (micros(time) - previous("_t")) / F.lit(1e6)
    return F.coalesce(F.col(power) * passed / 3600.0, F.lit(0.0))


class SeriesStore:
    """Series per `key` below `root`: `rows` with `seq` and `total`, and the state of each append.

    Rows must come in time order from append to append. One that lies before its series' last row
    would move rows that are placed already; it goes to the table `late` and takes no place.
    """

    def __init__(
        self, root: str, key: str = "station_id", time: str = "ts", tie: str = "event_id", look_back: int = 1,
        step: Step = energy_step, rows_per_slice: int = 100_000,
    ):
        self.root, self.key, self.time, self.tie = root.rstrip("/"), key, time, tie
        self.look_back, self.step, self.rows_per_slice = look_back, step, rows_per_slice

    def _path(self, table: str, number: int) -> str:
        return f"{self.root}/{table}/append={number}"

    def append(self, new: DataFrame, number: int) -> None:
        """Place the rows of append `number` (0, 1, ...); the state of the one before is read."""
        spark, key = new.sparkSession, self.key
        timed = new.withColumns({"_t": micros(self.time), "_tie": F.col(self.tie).cast("bigint")})
        if number:
            state = spark.read.parquet(self._path("state", number - 1))
            tail = spark.read.parquet(self._path("tail", number - 1))
            last = state.select(F.col(key).alias("_key"), "n", "total_before", "last_t", "last_tie")
            # One row per series: as many as there are stations.
            met = timed.join(last, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
            early = F.coalesce((F.col("_t") < F.col("last_t")) | ((F.col("_t") == F.col("last_t")) & (F.col("_tie") <= F.col("last_tie"))), F.lit(False))
            met = met.withColumn("_early", early)
            met.filter("_early").select(*new.columns).write.mode("overwrite").parquet(self._path("late", number))
            fresh = met.filter("NOT _early").drop("_early", "last_t", "last_tie")
            fresh = fresh.withColumns({"n": F.coalesce("n", F.lit(0)), "total_before": F.coalesce("total_before", F.lit(0.0))})
        else:
            tail = None
            fresh = timed.withColumns({"n": F.lit(0).cast("bigint"), "total_before": F.lit(0.0)})
        placed = add_position(fresh, time=self.time, tie=self.tie, keys=[key], out="_new")
        placed = placed.withColumn("seq", F.col("n") + F.col("_new"))
        columns = [*new.columns, "_t", "_tie", "seq", "_new", "total_before", "n"]
        both = placed.select(*columns, F.lit(False).alias("_old"))
        if tail is not None:
            both = both.unionByName(tail.select(
                *new.columns, "_t", "_tie", "seq", F.lit(-1).cast("bigint").alias("_new"), F.lit(0.0).alias("total_before"),
                F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("_old"),
            ))
        sliced = cut_series(both, "seq", self.rows_per_slice, self.look_back)
        order = Window.partitionBy(key, "_slice").orderBy("seq")
        steps = sliced.withColumn("_step", self.step(lambda c: F.lag(c).over(order)))
        steps = steps.filter("NOT _guest AND NOT _old").drop("_slice", "_guest", "_old")
        summed = running_sum(steps, "_step", "_new", [key], "_sum", self.rows_per_slice)
        out = summed.withColumn("total", F.col("total_before") + F.col("_sum"))
        out.select(*new.columns, "_t", "_tie", "seq", "total").write.mode("overwrite").parquet(self._path("rows", number))
        self._keep_state(spark, number, new.columns)

    def _keep_state(self, spark: SparkSession, number: int, columns: list[str]) -> None:
        """The state after this append, from its own rows and the state before."""
        key, rows = self.key, spark.read.parquet(self._path("rows", number))
        ends = rows.groupBy(key).agg(F.max_by(F.struct("seq", "total", "_t", "_tie"), "seq").alias("e")).select(
            key, (F.col("e.seq") + 1).alias("n"), F.col("e.total").alias("total_before"), F.col("e._t").alias("last_t"), F.col("e._tie").alias("last_tie")
        )
        kept = rows.select(*columns, "_t", "_tie", "seq")
        if number:
            ends = ends.unionByName(spark.read.parquet(self._path("state", number - 1)))
            kept = kept.unionByName(spark.read.parquet(self._path("tail", number - 1)).select(*kept.columns))
        ends = ends.groupBy(key).agg(F.max_by(F.struct("n", "total_before", "last_t", "last_tie"), "n").alias("e")).select(key, "e.*")
        ends.write.mode("overwrite").parquet(self._path("state", number))
        near = kept.join(spark.read.parquet(self._path("state", number)).select(F.col(key).alias("_key"), "n"), F.col(key).eqNullSafe(F.col("_key")))
        near.filter(F.col("seq") >= F.col("n") - self.look_back).drop("_key", "n").write.mode("overwrite").parquet(self._path("tail", number))
        if number > 1:  # an append that runs again needs the state before it only
            remove(spark, self._path("state", number - 2), self._path("tail", number - 2))

    def rows(self, spark: SparkSession) -> DataFrame:
        """All placed rows with `seq` and `total`."""
        return spark.read.parquet(f"{self.root}/rows").drop("append", "_t", "_tie")

    def late(self, spark: SparkSession, schema: str) -> DataFrame:
        """Rows that came after their place was taken; `schema` is that of the appended rows."""
        return spark.read.schema(schema).parquet(*[f"{self.root}/late"])
