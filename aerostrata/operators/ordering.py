"""Exact positions in an ordered series without a one-task window.

`row_number()` over a station, or over nothing, puts a whole series in one task. Here the series
is cut into time cells. Counting cells is a map-side aggregate, so a hot station shrinks before
it is shuffled; the running sum of cell counts gives each cell its first position; and only rows
of one cell meet in a task to be numbered. A cell that still holds too many rows is cut again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from aerostrata.functions.scalar import micros
from aerostrata.session import scratch_dir

_LAST = (1 << 63) - 1  # cell and instant of rows without a time: they sort last
_WIDE = "decimal(20,0)"  # differences of longs without overflow
_MOST_PARTS = 1024  # parts that one cut makes of a hot cell


def add_position(
    df: DataFrame,
    time: str,
    tie: Column | str,
    keys: list[str] | None = None,
    last_tie: list[str] | None = None,
    out: str = "position",
    cell_seconds: int = 3600,
    min_hot_rows: int = 1_000_000,
    total: str | None = None,
    scratch: list[str] | None = None,
) -> DataFrame:
    """Add the 0-based position of each row in (time, tie, last_tie) order per `keys`.

    `tie` is an integer expression that orders rows of one instant; `last_tie` columns settle
    what remains. Rows without a time come last. `total` adds the series' number of rows. Costs: one
    narrow aggregate over the order columns, which is written (`scratch` gets its path), and one
    shuffle of the rows.
    """
    tie_col = F.col(tie) if isinstance(tie, str) else tie
    t = F.coalesce(micros(time), F.lit(_LAST))
    rows = df.withColumns({
        **_series(keys),
        "_t": t,
        "_tie": F.coalesce(tie_col.cast("bigint"), F.lit(_LAST)),
        "_cell": F.floor(t / F.lit(cell_seconds * 1_000_000)),
    })
    series = list(_series(keys))
    found: list[DataFrame] = []
    rows = _cut_hot_cells(rows, series, min_hot_rows, found, [] if scratch is None else scratch)

    cell = [*series, "_cell", "_part"]
    counts = found[-1]
    # The running sum sees cells, not rows: their number is bounded by the time span covered.
    before = Window.partitionBy(*series).orderBy("_cell", "_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    whole = [F.sum("_n").over(Window.partitionBy(*series)).alias("_total")] if total else []
    offsets = counts.select(*cell, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"), *whole)

    in_cell = Window.partitionBy(*cell).orderBy("_t", "_tie", *(last_tie or []))
    return (
        rows.withColumn("_nth", F.row_number().over(in_cell) - 1)
        .join(offsets, cell, "inner")
        .select(
            *df.columns, (F.col("_first") + F.col("_nth")).alias(out),
            *([F.col("_total").alias(total)] if total else []),
        )
    )


def _series(keys: list[str] | None) -> dict[str, Column]:
    """The series key as one struct: structs join on plain equality even where a key is NULL."""
    return {"_series": F.struct(*keys)} if keys else {}


def _cut_hot_cells(
    rows: DataFrame, series: list[str], min_hot_rows: int, found: list[DataFrame], scratch: list[str]
) -> DataFrame:
    """Number the parts of cells that hold more than `min_hot_rows` rows.

    Cell counts are written once; they are the check here and, in the normal case without a hot
    cell, the offsets of the caller, who gets them in `found`. Hot parts are cut evenly over the
    time they cover or, when they are a single instant, over the tie, and counted again, until no
    part is too large or it cannot be cut: every cut sets the earliest and the latest apart. The
    limit does not grow with the data. Any cut gives the same positions.
    """
    cell = [*series, "_cell", "_part"]
    rows = rows.withColumn("_part", F.array().cast("array<int>"))
    spark = rows.sparkSession
    while True:
        path = scratch_dir(spark, "cells")
        scratch.append(path)
        counts = rows.groupBy(*cell).agg(
            F.count(F.lit(1)).alias("_n"),
            F.min("_t").alias("_t0"), F.max("_t").alias("_t1"),
            F.min("_tie").alias("_i0"), F.max("_tie").alias("_i1"),
        )
        counts.write.parquet(path)
        counts = spark.read.schema(counts.schema).parquet(path)
        too_many = F.col("_n") > min_hot_rows
        hot = counts.filter(too_many & ((F.col("_t0") < F.col("_t1")) | (F.col("_i0") < F.col("_i1"))))
        if hot.isEmpty():
            found.append(counts)
            return rows
        one_instant = F.col("_t0") == F.col("_t1")
        cuts = hot.select(
            *[F.col(c).alias(f"_hot{c}") for c in cell],
            one_instant.alias("_by_tie"),
            F.when(one_instant, F.col("_i0")).otherwise(F.col("_t0")).cast(_WIDE).alias("_low"),
            F.when(one_instant, F.col("_i1")).otherwise(F.col("_t1")).cast(_WIDE).alias("_high"),
            F.least(F.ceil(F.col("_n") / F.lit(min_hot_rows)) * 2, F.lit(_MOST_PARTS)).alias("_pieces"),
        )
        same = [F.col(c) == F.col(f"_hot{c}") for c in cell]
        value = F.when(F.col("_by_tie"), F.col("_tie")).otherwise(F.col("_t")).cast(_WIDE)
        # Differences are exact; only their share of the range is a double.
        share = (value - F.col("_low")).cast("double") / ((F.col("_high") - F.col("_low")).cast("double") + 1)
        part = F.floor(share * F.col("_pieces")).cast("int")
        cut = F.when(F.col("_pieces").isNotNull(), F.concat("_part", F.array(part))).otherwise(F.col("_part"))
        rows = rows.join(cuts, same, "left").withColumn("_part", cut).select(*rows.columns)


def cut_series(
    df: DataFrame, position: str, rows_per_slice: int, look_back: int
) -> DataFrame:
    """Cut a positioned series into equal slices for windows of bounded look-back.

    Adds `_slice` and `_guest`: the last `look_back` rows of a slice also visit the next one as
    guests, so a window partitioned by slice sees all rows it needs. Drop guests afterwards.
    """
    own = F.floor(F.col(position) / rows_per_slice)
    tail = F.col(position) % rows_per_slice >= rows_per_slice - look_back
    visits = F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))
    return (
        df.withColumn("_own", own)
        .withColumn("_slice", F.explode(visits))
        .withColumn("_guest", F.col("_slice") != F.col("_own"))
        .drop("_own")
    )


def running_sum(
    df: DataFrame, value: str, position: str, keys: list[str], out: str, rows_per_slice: int = 100_000
) -> DataFrame:
    """Running sum over a positioned series: in-slice sums plus the total of earlier slices."""
    sliced = df.withColumns({
        **_series(keys), "_slice": F.floor(F.col(position) / rows_per_slice)
    })
    series = list(_series(keys))
    totals = sliced.groupBy(*series, "_slice").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*series).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(
        *series, "_slice", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_base")
    )
    in_slice = Window.partitionBy(*series, "_slice").orderBy(position).rowsBetween(
        Window.unboundedPreceding, 0
    )
    return (
        sliced.withColumn("_so_far", F.sum(value).over(in_slice))
        .join(base, [*series, "_slice"], "inner")
        .withColumn(out, F.col("_base") + F.coalesce(F.col("_so_far"), F.lit(0.0)))
        .select(*df.columns, out)
    )
