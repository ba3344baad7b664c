"""Per-batch feature vectors and their enrichment."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from aerostrata.functions.scalar import as_instant, parse_time
from aerostrata.operators.ordering import add_position, cut_series
from aerostrata.schema import CORE_FIELDS, MISSING_LIMIT, ROLLING_FIELDS, ROLLING_WINDOW, STATS


def with_batch_keys(df: DataFrame, default_batch: str = "batch_0") -> DataFrame:
    """Give rows a batch id and a row number when the input has none.

    Files carry no row order in Spark, so a missing row number follows `ts`; rows of one time, or
    without one, are in the order of a hash of all their values.
    """
    if "batch_id" not in df.columns:
        df = df.withColumn("batch_id", F.lit(default_batch))
    if "row_in_batch" not in df.columns:
        df = add_position(
            df, time="ts", tie=F.xxhash64(*df.columns), keys=["batch_id"], out="row_in_batch"
        )
    return df


def batch_statistics(
    obs: DataFrame,
    fields: list[str] = CORE_FIELDS,
    order: str = "row_in_batch",
    time: str | None = None,
    rows: str | None = None,
    by: list[str] | None = None,
) -> DataFrame:
    """Six statistics per field and batch, over the valid readings of the field.

    mean, min, max, sample std (0 for one reading), delta = last - first valid reading in row
    order (0 for one reading), range. A field without a valid reading, or absent from the input,
    has NULL statistics. One hash aggregate with partial results before the shuffle; `time` adds
    the earliest time of the batch and `rows` its row count in the same pass.
    """
    keys = by or ["batch_id"]
    present = [f for f in fields if f in obs.columns]
    aggs: list[str] = []
    if time:
        aggs.append(f"min(`{time}`) AS batch_ts")
    if rows:
        aggs.append(f"count(1) AS `{rows}`")
    out: list[str] = [f"`{k}`" for k in keys]
    out += ["batch_ts"] if time else []
    out += [f"`{rows}`"] if rows else []
    for f in fields:
        if f not in present:
            out += [f"CAST(NULL AS DOUBLE) AS `{f}_{s}`" for s in STATS]
            continue
        x = f"CAST(`{f}` AS DOUBLE)"
        where = f"CASE WHEN `{f}` IS NOT NULL THEN {order} END"
        aggs += [
            f"count({x}) AS `_n_{f}`",
            f"avg({x}) AS `{f}_mean`",
            f"min({x}) AS `{f}_min`",
            f"max({x}) AS `{f}_max`",
            f"stddev_samp({x}) AS `_sd_{f}`",
            f"min_by({x}, {where}) AS `_first_{f}`",
            f"max_by({x}, {where}) AS `_last_{f}`",
        ]
        out += [
            f"`{f}_mean`", f"`{f}_min`", f"`{f}_max`",
            f"CASE WHEN `_n_{f}` = 1 THEN 0.0D ELSE `_sd_{f}` END AS `{f}_std`",
            f"CASE WHEN `_n_{f}` = 1 THEN 0.0D ELSE `_last_{f}` - `_first_{f}` END AS `{f}_delta`",
            f"`{f}_max` - `{f}_min` AS `{f}_range`",
        ]
    grouped = obs.filter("batch_id IS NOT NULL").groupBy(*keys).agg(*[F.expr(a) for a in aggs])
    return grouped.selectExpr(*out)


def missing_share(fields: list[str] = CORE_FIELDS) -> Column:
    """Share of missing features; the six of a field are missing together, so fields suffice."""
    missing = " + ".join(f"CAST(`{f}_mean` IS NULL AS INT)" for f in fields)
    return F.expr(f"({missing}) / {len(fields)}D")


def drop_sparse(
    features: DataFrame, fields: list[str] = CORE_FIELDS, limit: float = MISSING_LIMIT
) -> DataFrame:
    """Keep a batch while at most `limit` of its features are missing."""
    return features.filter(missing_share(fields) <= F.lit(limit))


def sparse_counts(
    stats: DataFrame, fields: list[str] = CORE_FIELDS, limit: float = MISSING_LIMIT
) -> DataFrame:
    """How many batches `drop_sparse` keeps and drops: one row (kept, dropped)."""
    keep = missing_share(fields) <= F.lit(limit)
    return stats.agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("dropped"))


def batch_features(
    obs: DataFrame,
    fields: list[str] = CORE_FIELDS,
    limit: float = MISSING_LIMIT,
    min_rows: int | None = None,
    time: str | None = "ts",
    **options,
) -> DataFrame:
    """Statistics per batch without sparse batches and, with `min_rows`, without open ones."""
    stats = batch_statistics(obs, fields, time=time, rows="_rows", **options)
    if min_rows:
        stats = stats.filter(F.col("_rows") >= min_rows)
    return drop_sparse(stats, fields, limit).drop("_rows")


def batch_timestamps(obs: DataFrame) -> DataFrame:
    """Earliest time per batch; text is parsed and unreadable text ignored."""
    ts = parse_time("ts") if dict(obs.dtypes)["ts"] == "string" else F.col("ts")
    return (
        obs.filter(F.col("batch_id").isNotNull())
        .groupBy("batch_id")
        .agg(F.min(ts).alias("batch_ts"))
    )


def align(features: DataFrame, series: DataFrame, key: str = "batch_id") -> DataFrame:
    """Attach a keyed series to the features; batches it does not know get NULL."""
    return features.join(series, key, "left")


def temporal_features(features: DataFrame, time: str = "batch_ts") -> DataFrame:
    """Hour on the circle and day of week (Monday = 0); no time counts as hour 0, day 0."""
    at = as_instant(time)
    angle = F.lit(2 * math.pi) * F.coalesce(F.hour(at), F.lit(0)) / F.lit(24)
    return features.withColumns({
        "hour_sin": F.sin(angle),
        "hour_cos": F.cos(angle),
        "day_of_week": F.coalesce(F.weekday(at), F.lit(0)).cast("double"),
    })


def rolling_features(
    features: DataFrame,
    window: int = ROLLING_WINDOW,
    fields: list[str] = ROLLING_FIELDS,
    keys: list[str] | None = None,
    time: str = "batch_ts",
    rows_per_slice: int = 10_000,
) -> DataFrame:
    """Mean over the last `window` batches in time, missing values skipped.

    Works on equal slices of the positioned series, so one long series uses the whole cluster. What is
    written from here has no more files than slices, and later jobs no more busy tasks.
    """
    keys = keys or []
    present = [f for f in fields if f in features.columns]
    positioned = add_position(
        features, time=time, tie=F.xxhash64("batch_id"), keys=keys, last_tie=["batch_id"], out="_pos"
    )
    sliced = cut_series(positioned, "_pos", rows_per_slice, look_back=window - 1)
    w = Window.partitionBy(*keys, "_slice").orderBy("_pos").rowsBetween(-(window - 1), 0)
    rolled = sliced.withColumns({f"{f}_roll{window}": F.avg(f).over(w) for f in present})
    return rolled.filter(~F.col("_guest")).drop("_pos", "_slice", "_guest")
