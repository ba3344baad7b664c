"""Every registered query: (spark, folder) -> DataFrame over the tables in that folder.

Outputs round doubles to six digits (`fixed`), so that results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from aerostrata.functions.scalar import fixed, fixed_sql
from aerostrata.operators import (
    energy, evaluate, features as ft, folds, freshness, incremental, labels, microbatch, prep, sketches, status,
)
from aerostrata.plans import fleet
from aerostrata.schema import (
    CORE_FIELDS, HEALTH_BOUNDS, RANGE_BOUNDS, ROLLING_FIELDS, STATS, SYSTEM_FIELDS, feature_names,
)
from aerostrata.session import configure, materialize, scratch_dir
from aerostrata.sources import bucketed, files, frame_source, frames, sinks, tables

Query = Callable[[SparkSession, str], DataFrame]

FEATURES = feature_names()
RANGES = [c for c in FEATURES if c.endswith("_range")]
STATUSES = ["scd41_status", "bme688_status", "sps30_status"]
NOW = "2024-01-30 12:30:00"
LATER = "2024-02-03 12:30:00"

_QUERIES: dict[str, Query] = {}


def register(fn: Query) -> Query:
    """Register a query under its function name; the session settings are applied first."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(configure(spark), folder)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    _QUERIES[fn.__name__] = run
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


# --- building blocks ---------------------------------------------------------------------------

def observations(spark: SparkSession, folder: str) -> DataFrame:
    return fleet.observations(fleet.read_events(spark, folder))


def kept_features(spark: SparkSession, folder: str, by: list[str] | None = None) -> DataFrame:
    """Features of closed batches without the sparse ones."""
    return ft.batch_features(observations(spark, folder), min_rows=microbatch.batch_size(), by=by)


def feature_table(spark: SparkSession, folder: str) -> DataFrame:
    """The kept features as a written table: a tenth of the input rows, read several times."""
    return materialize(spark, kept_features(spark, folder), "features")


def indexed_features(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """The feature table with its chronological index, and its row count."""
    table = feature_table(spark, folder)
    return folds.chrono_index(table), table.count()


def split_features(spark: SparkSession, folder: str) -> DataFrame:
    indexed, n = indexed_features(spark, folder)
    return folds.temporal_split(indexed, n=n)


def rounded(df: DataFrame, keep: list[str], values: list[str]) -> DataFrame:
    return df.selectExpr(*[f"`{c}`" for c in keep], *[f"{fixed_sql(c)} AS `{c}`" for c in values])


def wall_time(df: DataFrame, *columns: str) -> DataFrame:
    """Instants as zone-less UTC times, the form of the input tables."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


# --- scans and files ---------------------------------------------------------------------------

@register
def scan_observations(spark, folder):
    """Analysis scan of the observations."""
    scan = tables.scan_observations(observations(spark, folder))
    return rounded(scan, [c for c in scan.columns if c not in CORE_FIELDS], CORE_FIELDS)


def _scan_with_metrics(spark, folder, dedupe):
    obs = observations(spark, folder)
    scan = tables.scan_with_metrics(obs, fleet.runtime_metrics(obs), dedupe_metrics=dedupe)
    return rounded(scan, [c for c in scan.columns if c not in CORE_FIELDS], CORE_FIELDS)


@register
def scan_with_metrics(spark, folder):
    """Observations left-joined to metrics; double metrics rows fan out."""
    return _scan_with_metrics(spark, folder, False)


@register
def scan_with_metrics_dedup(spark, folder):
    """The same join over the latest metrics row per key."""
    return _scan_with_metrics(spark, folder, True)


@register
def csv_roundtrip(spark, folder):
    """CSV export in batch order, read back with the known schema."""
    path = scratch_dir(spark, "export")
    sinks.export_csv(observations(spark, folder).drop("event_id"), path)
    back = wall_time(files.read_csv(spark, path), "ts", "measured_at")
    return rounded(
        back.withColumns({"station_id": F.col("station_id").cast("bigint")}),
        ["station_id", "batch_id", "row_in_batch", "ts", "measured_at", *STATUSES], CORE_FIELDS,
    )


@register
def json_batch_scan(spark, folder):
    """Every batch written as one JSON array and read back."""
    path = scratch_dir(spark, "buffers")
    obs = observations(spark, folder).drop("event_id", "station_id")
    # A batch has at most ten rows, so its list is small.
    rows = F.to_json(F.collect_list(F.struct(*obs.columns)), sinks.TIME_FORMATS)
    obs.groupBy("batch_id").agg(rows.alias("value")).select("value").write.text(path)
    back = wall_time(files.read_batch_json(spark, path, multi_line=False), "ts", "measured_at")
    return rounded(
        back, ["batch_id", "row_in_batch", "ts", "measured_at", *STATUSES], CORE_FIELDS
    )


@register
def json_batch_scan_damaged(spark, folder):
    """Batches as JSON arrays, some cut off and some with text in a number field, read back.

    A wrong value is missing and its row stays; an array that is cut off is one rejected row.
    """
    path = scratch_dir(spark, "buffers")
    obs = observations(spark, folder).drop("event_id", "station_id")
    rows = F.to_json(F.collect_list(F.struct(*obs.columns)), sinks.TIME_FORMATS)
    number = F.substring_index("batch_id", "b", -1).cast("bigint") % 7
    damaged = F.when(number == 3, F.expr("left(value, length(value) - 9)")).when(
        number == 5, F.replace("value", F.lit('"row_in_batch":0'), F.lit('"row_in_batch":"first"'))
    ).otherwise(F.col("value"))
    obs.groupBy("batch_id").agg(rows.alias("value")).select(damaged.alias("value")).write.text(path)
    back = wall_time(files.read_batch_json(spark, path, multi_line=False, keep_rejects=True), "ts", "measured_at")
    keys = ["batch_id", "row_in_batch", "ts", "measured_at", *STATUSES]
    return rounded(
        back.withColumn("rejected", F.col("batch_id").isNull()), [*keys, "rejected"], CORE_FIELDS
    )


@register
def csv_mixed_headers(spark, folder):
    """Two exports in one folder, their columns in different orders, read back by name."""
    path = scratch_dir(spark, "export")
    obs = observations(spark, folder).drop("event_id")
    even = F.col("row_in_batch") % 2 == 0
    sinks.export_csv(obs.filter(even), f"{path}/even")
    sinks.export_csv(obs.filter(~even).select(*reversed(obs.columns)), f"{path}/odd")
    back = wall_time(files.read_csv(spark, f"{path}/*"), "ts", "measured_at")
    return rounded(
        back.withColumns({
            "station_id": F.col("station_id").cast("bigint"), "rejected": F.col("_corrupt_record").isNotNull(),
        }),
        ["station_id", "batch_id", "row_in_batch", "ts", "measured_at", *STATUSES, "rejected"], CORE_FIELDS,
    )


def _framed(spark, folder):
    word = lambda x: F.lpad(F.hex((x % 65536).cast("bigint")), 4, "0")
    e, u = F.col("event_id"), F.col("user_id")
    text = F.concat(word(e * 7), F.lit("A5"), word(e * 1009), F.lit("5A"), word(u * 523), F.lit("FF"))
    cut = F.when(e % 13 == 0, F.substring(text, 1, 12)).otherwise(text)
    return fleet.read_events(spark, folder).select("event_id", F.unhex(cut).alias("frame"))


def _decoded(framed):
    out = frames.decode_frames(framed)
    return rounded(out, ["event_id", "co2_ppm"], ["scd_temp_c", "scd_humidity_pct"])


@register
def decode_frames(spark, folder):
    """Nine-byte sensor frames, one per event, decoded; every 13th frame is cut short."""
    return _decoded(_framed(spark, folder))


@register
def decode_frame_files(spark, folder):
    """The same frames written to and read from files of the frame source, in ranges of records."""
    path, name = scratch_dir(spark, "frames"), frame_source.register(spark)
    _framed(spark, folder).write.format(name).mode("append").save(path)
    return _decoded(spark.read.format(name).option("rangeBytes", 1 << 20).load(path))


@register
def stream_frames(spark, folder):
    """Frame files as a stream that is stopped and goes on: each of two appends is taken once."""
    path, out, progress = (scratch_dir(spark, n) for n in ("frames", "decoded", "progress"))
    name, framed = frame_source.register(spark), _framed(spark, folder)
    for part in (0, 1):
        framed.filter(F.col("event_id") % 2 == part).write.format(name).mode("append").save(path)
        stream = frames.decode_frames(spark.readStream.format(name).load(path))
        sink = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress)
        sink.trigger(availableNow=True).start().awaitTermination()
    decoded = spark.read.parquet(out)
    return rounded(decoded, ["event_id", "co2_ppm"], ["scd_temp_c", "scd_humidity_pct"])


# --- micro-batches and status ------------------------------------------------------------------

_KEYS = ["station_id", "event_id", "batch_id", "row_in_batch"]


@register
def assign_microbatches(spark, folder):
    """Batch id and row number of every observation."""
    return observations(spark, folder).select(*_KEYS)


@register
def microbatch_headers(spark, folder):
    """Headers of closed batches."""
    headers = microbatch.batch_headers(observations(spark, folder), F.lit(NOW).cast("timestamp"))
    closed = headers.filter(F.col("record_count") >= microbatch.batch_size())
    return wall_time(closed, "created_at", "closed_at")


@register
def closed_batches_only(spark, folder):
    """Observations of full batches."""
    return fleet.observations(fleet.read_events(spark, folder), closed=True).select(*_KEYS)


@register
def new_batches_only(spark, folder):
    """Observations of batches not stored yet; a third of the batches counts as stored."""
    obs = observations(spark, folder)
    stored = obs.filter((F.col("row_in_batch") == 0) & (F.col("event_id") % 3 == 0))
    return microbatch.new_batches_only(obs, stored).select(*_KEYS)


@register
def new_batches_bucketed(spark, folder):
    """The same against a bucketed store, which is not shuffled for it."""
    obs = observations(spark, folder)
    where = scratch_dir(spark, "store")
    store = bucketed.BucketedStore(spark, f"store_{where[-32:]}", 16, where)
    store.append(obs.filter((F.col("row_in_batch") == 0) & (F.col("event_id") % 3 == 0)))
    return store.new_only(obs).select(*_KEYS)


def _with_status(spark, folder):
    obs = observations(spark, folder).withColumn("_wait", F.col("sps30_status") == "data_not_ready")
    return status.sensor_status(obs, not_ready={"sps30": "_wait"})


@register
def sensor_status(spark, folder):
    """Status per sensor group and overall, from the readings."""
    return _with_status(spark, folder).select("event_id", *STATUSES, "sensor_status")


@register
def status_counts(spark, folder):
    """Observations per station and overall status."""
    return _with_status(spark, folder).groupBy("station_id", "sensor_status").agg(
        F.count(F.lit(1)).alias("n")
    )


@register
def graded_alerts(spark, folder):
    """Alert grade per field."""
    graded = status.graded_alerts(observations(spark, folder))
    return graded.select("event_id", *[c for c in graded.columns if c.endswith("_alert")])


# --- features ----------------------------------------------------------------------------------

@register
def batch_features(spark, folder):
    """Sixty features per closed batch, sparse batches dropped."""
    return rounded(kept_features(spark, folder), ["batch_id", "batch_ts"], FEATURES)


@register
def batch_features_open(spark, folder):
    """Features of all batches, incomplete and sparse ones included."""
    stats = ft.batch_statistics(observations(spark, folder), rows="n_rows")
    return rounded(stats, ["batch_id", "n_rows"], FEATURES)


@register
def batch_features_system(spark, folder):
    """Seventy-two features: core fields and system load of the latest metrics row."""
    obs = observations(spark, folder)
    scan = tables.scan_with_metrics(obs, fleet.runtime_metrics(obs), dedupe_metrics=True)
    fields = CORE_FIELDS + SYSTEM_FIELDS
    return rounded(ft.batch_features(scan, fields), ["batch_id"], feature_names(fields))


@register
def batch_features_fanout(spark, folder):
    """System statistics where double metrics rows count twice; copies are in order of cycle_id."""
    obs = observations(spark, folder)
    scan = tables.scan_with_metrics(obs, fleet.runtime_metrics(obs), keep_cycle=True)
    ordered = scan.withColumn("row_in_batch", F.struct("row_in_batch", "cycle_id"))
    stats = ft.batch_statistics(ordered, SYSTEM_FIELDS, rows="n_rows")
    names = [f"{f}_{s}" for f in SYSTEM_FIELDS for s in STATS]
    return rounded(stats, ["batch_id", "n_rows"], names)


@register
def null_share_filter(spark, folder):
    """Share of missing features per batch and whether the batch is kept."""
    share = ft.missing_share()
    stats = ft.batch_statistics(observations(spark, folder))
    return stats.select("batch_id", fixed(share).alias("null_share"), (share <= 0.5).alias("kept"))


@register
def sparse_batch_counts(spark, folder):
    """Batches that the sparse filter keeps and drops."""
    return ft.sparse_counts(ft.batch_statistics(observations(spark, folder)))


@register
def batch_timestamps(spark, folder):
    """Earliest time per batch."""
    return ft.batch_timestamps(observations(spark, folder))


@register
def temporal_features(spark, folder):
    """Hour on the circle and weekday of each kept batch."""
    obs = observations(spark, folder)
    kept = ft.batch_features(obs, min_rows=microbatch.batch_size(), time=None)
    timed = ft.align(kept.select("batch_id"), ft.batch_timestamps(obs))
    return rounded(ft.temporal_features(timed), ["batch_id", "day_of_week"], ["hour_sin", "hour_cos"])


@register
def rolling_features(spark, folder):
    """Rolling means over the last three batches of the one global series."""
    rolled = ft.rolling_features(feature_table(spark, folder))
    return rounded(rolled, ["batch_id", "batch_ts"], [f"{f}_roll3" for f in ROLLING_FIELDS])


@register
def rolling_features_by_station(spark, folder):
    """Rolling means over the last three batches of each station."""
    kept = kept_features(spark, folder, by=["batch_id", "station_id"])
    kept = materialize(spark, kept, "features")
    rolled = ft.rolling_features(kept, keys=["station_id"])
    return rounded(rolled, ["batch_id", "batch_ts"], [f"{f}_roll3" for f in ROLLING_FIELDS])


# --- labels ------------------------------------------------------------------------------------

@register
def health_labels(spark, folder):
    """Health-risk label per batch."""
    return labels.health_labels(kept_features(spark, folder)).select("batch_id", "health_risk")


@register
def anomaly_labels(spark, folder):
    """Range-anomaly label per batch."""
    return labels.anomaly_labels(kept_features(spark, folder)).select("batch_id", "anomaly")


@register
def label_counts(spark, folder):
    """Batches per class of both labels."""
    kept = labels.anomaly_labels(labels.health_labels(kept_features(spark, folder)))
    return labels.label_counts(kept, "health_risk", "anomaly")


@register
def inject_anomalies(spark, folder):
    """Range features after shifting two percent of the batches, with the true labels."""
    injected = labels.inject_anomalies(feature_table(spark, folder))
    return rounded(injected, ["batch_id", "synthetic_anomaly"], RANGES)


# --- order, imputation, scaling ----------------------------------------------------------------

@register
def chrono_index(spark, folder):
    """Global chronological position of each kept batch."""
    indexed, _ = indexed_features(spark, folder)
    return indexed.select("batch_id", "batch_ts", "chrono_idx")


@register
def temporal_split(spark, folder):
    """First 80 % train, rest test."""
    return split_features(spark, folder).select("batch_id", "chrono_idx", "split")


@register
def time_series_folds(spark, folder):
    """Role of each batch in five expanding folds."""
    indexed, n = indexed_features(spark, folder)
    return folds.time_series_folds(indexed.select("batch_id", "chrono_idx"), n=n)


def _train_means(split: DataFrame) -> DataFrame:
    return prep.column_means(split.filter(F.col("split") == "train"), FEATURES)


def _filled(spark, folder):
    split = split_features(spark, folder)
    return prep.impute(split, FEATURES, _train_means(split))


@register
def impute_means(spark, folder):
    """Training means of all features."""
    return rounded(_train_means(split_features(spark, folder)), [], FEATURES)


@register
def imputed_features(spark, folder):
    """Features with missing values filled from the training means."""
    return rounded(_filled(spark, folder), ["batch_id", "split"], FEATURES)


@register
def scaled_features(spark, folder):
    """Features standardised with training means and population deviations."""
    split = split_features(spark, folder)
    stats = prep.fit_standardizer(split.filter(F.col("split") == "train"), FEATURES)
    return rounded(prep.standardize(split, FEATURES, stats), ["batch_id"], FEATURES)


@register
def threshold_baseline(spark, folder):
    """The health rule as a predictor on imputed features."""
    filled = _filled(spark, folder)
    return filled.select("batch_id", "split", labels.health_rule(FEATURES).alias("prediction"))


# --- evaluation --------------------------------------------------------------------------------

_FACTORS = {"rule": 1.0, "tight": 0.9, "loose": 1.1}


def _rule_predictions(df: DataFrame, keep: list[str], truth, predict) -> DataFrame:
    """Long prediction table of the rule at its own and at shifted bounds, in one pass."""
    models = F.array(*[
        F.struct(F.lit(m).alias("model"), predict(k).alias("pred")) for m, k in _FACTORS.items()
    ])
    return df.select(*keep, truth.alias("y"), F.inline(models))


def _health_at(factor: float):
    bounds = {f: {k: v * factor for k, v in b.items()} for f, b in HEALTH_BOUNDS.items()}
    return labels.health_rule(FEATURES, bounds)


def _range_at(factor: float):
    return labels.range_rule(FEATURES, {c: b * factor for c, b in RANGE_BOUNDS.items()})


def _health_predictions(df: DataFrame, keep: list[str]) -> DataFrame:
    return _rule_predictions(df, keep, labels.health_rule(FEATURES), _health_at)


@register
def confusion_counts(spark, folder):
    """Confusion counts of the rule at three bound levels."""
    predictions = _health_predictions(kept_features(spark, folder), ["batch_id"])
    return evaluate.confusion_counts(predictions, ["model"])


@register
def classification_metrics(spark, folder):
    """Classification report of the rule at three bound levels."""
    predictions = _health_predictions(kept_features(spark, folder), ["batch_id"])
    report = sinks.nested_as_text(evaluate.classification_report(predictions, ["model"]))
    return rounded(
        report, ["model", "n_samples", "n_positive", "n_negative", "confusion_matrix"],
        evaluate.METRICS,
    )


@register
def cv_summary(spark, folder):
    """Fold means and deviations of the metrics over the validation ranges."""
    indexed, n = indexed_features(spark, folder)
    parts = folds.time_series_folds(indexed, n=n)
    validated = parts.filter(F.col("role") == "validate")
    reports = evaluate.classification_report(
        _health_predictions(validated, ["fold"]), ["model", "fold"]
    )
    summary = evaluate.cv_summary(reports)
    return rounded(summary, ["model", "n_folds"], summary.columns[2:])


@register
def mcnemar_pairs(spark, folder):
    """McNemar counts and statistic for all pairs of bound levels."""
    predictions = _health_predictions(kept_features(spark, folder), ["batch_id"])
    counts = evaluate.mcnemar_counts(predictions, list(_FACTORS), sample="batch_id")
    return rounded(counts, ["model1", "model2", "b", "c"], ["statistic"])


@register
def mcnemar_p_values(spark, folder):
    """The same pairs with p-values."""
    predictions = _health_predictions(kept_features(spark, folder), ["batch_id"])
    tested = evaluate.mcnemar(predictions, list(_FACTORS), sample="batch_id")
    return rounded(tested, ["model1", "model2", "b", "c", "significant"], ["statistic", "p_value"])


@register
def anomaly_metrics(spark, folder):
    """Anomaly report of the range rule at three bound levels."""
    predictions = _rule_predictions(
        kept_features(spark, folder), ["batch_id"], labels.range_rule(FEATURES), _range_at
    )
    signed = predictions.withColumn("pred", F.when(F.col("pred") == 1, -1).otherwise(1))
    report = evaluate.anomaly_report(signed, ["model"])
    return rounded(
        report, ["model", "n_samples", "n_anomalies_detected", "n_true_anomalies"],
        ["precision", "recall", "f1"],
    )


# --- freshness and energy ----------------------------------------------------------------------

def _freshness(spark, folder, now):
    obs = fleet.readings(fleet.read_events(spark, folder).withColumn("station_id", F.col("user_id") % 8))
    row = freshness.freshness_status(obs, now)
    return rounded(
        wall_time(row, "last_measured_at", "checked_at"),
        ["last_measured_at", "checked_at", "status", "message"], ["age_hours"],
    )


@register
def freshness_status(spark, folder):
    """Freshness of the fleet at a fixed time (placement in batches is not needed)."""
    return _freshness(spark, folder, NOW)


@register
def freshness_alert(spark, folder):
    """The alert, text included, at a fixed time days after the last reading."""
    return _freshness(spark, folder, LATER)


def _gaps(spark, folder, hours):
    obs = fleet.readings(fleet.read_events(spark, folder).withColumn("station_id", F.col("user_id") % 8))
    gaps = freshness.data_gaps(obs, hours)
    return rounded(gaps, ["station_id", "gap_start", "gap_end"], ["gap_hours"])


@register
def data_gaps(spark, folder):
    """Pauses of more than six hours per station."""
    return _gaps(spark, folder, 6)


@register
def data_gaps_1h(spark, folder):
    """Pauses of more than one hour per station."""
    return _gaps(spark, folder, 1)


@register
def batch_energy(spark, folder):
    """Mean power and energy per batch."""
    spent = energy.batch_energy(fleet.runtime_metrics(observations(spark, folder)))
    return rounded(spent, ["batch_id", "n_cycles"], ["avg_power_w", "energy_wh"])


@register
def batch_read_times(spark, folder):
    """Total sensor read time per batch; one reading in eleven lacks the second sensor's time."""
    e = F.col("event_id")
    metrics = fleet.runtime_metrics(observations(spark, folder)).withColumns({
        "scd41_read_ms": (e % 7).cast("double"), "sps30_read_ms": (F.lit(2) * (e % 5)).cast("double"),
        "bme688_read_ms": F.when(e % 11 != 0, (e % 13).cast("double")),
    })
    return rounded(energy.read_times(metrics), ["batch_id", "n_cycles"], ["total_sensor_read_ms"])


@register
def cumulative_energy(spark, folder):
    """Energy since the first reading of the station."""
    metrics = fleet.runtime_metrics(observations(spark, folder))
    latest = tables.latest_metrics(metrics)
    return rounded(energy.cumulative_energy(latest), ["event_id"], ["cumulative_energy_wh"])


@register
def ingest_counts(spark, folder):
    """Rows, batches and last measurement."""
    return observations(spark, folder).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("batch_id").alias("n_batches"),
        F.max("measured_at").alias("last_measured_at"),
    )


# --- kept up to date ---------------------------------------------------------------------------

def _appended(rows, store, appends=3):
    """A store that took the rows in parts split by time, as days arrive."""
    spark = rows.sparkSession
    rows = materialize(spark, rows, "arrivals")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = rows.agg(F.min(at), F.max(at)).first()
    low, high = (0, 0) if low is None else (low, high)
    part = F.least(F.floor((at - low) * appends / F.lit(high - low + 1)), F.lit(appends - 1))
    for k in range(appends):
        store.append(rows.filter(part == k), k)
    return store.rows(spark)


@register
def incremental_microbatches(spark, folder):
    """Batch places of rows that arrive in three appends, each placed behind the state before it."""
    cycles = fleet.read_events(spark, folder).select(
        (F.col("user_id") % 8).alias("station_id"), "event_id", "ts", F.lit(0.0).alias("power_w"))
    placed = _appended(cycles, incremental.SeriesStore(scratch_dir(spark, "series")))
    n = microbatch.batch_size()
    return placed.select(
        "station_id", "event_id", microbatch.batch_key(F.col("station_id"), F.floor(F.col("seq") / n)).alias("batch_id"),
        (F.col("seq") % n).cast("int").alias("row_in_batch"))


@register
def incremental_energy(spark, folder):
    """Running energy over three appends; equals the full run."""
    latest = tables.latest_metrics(fleet.runtime_metrics(observations(spark, folder)))
    placed = _appended(latest, incremental.SeriesStore(scratch_dir(spark, "series")))
    return rounded(placed.withColumnRenamed("total", "cumulative_energy_wh"), ["event_id"], ["cumulative_energy_wh"])


@register
def sketch_errors(spark, folder):
    """Distinct counts and quantiles from merged sketches of the days, beside exact ones and the stated bounds."""
    events = fleet.read_events(spark, folder)
    days = materialize(spark, sketches.daily_sketches(events, ["event_id", "user_id"], ["value"]), "sketches")
    found = sketches.estimates(sketches.merged(days), [0.1, 0.5, 0.9]).first()  # one row
    exact = events.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_distinct(c).cast("double").alias(f"distinct_{c}") for c in ("event_id", "user_id")],
        *[F.expr(f"percentile(value, {q})").alias(f"q{round(q * 100)}_value") for q in (0.1, 0.5, 0.9)],
        *[F.count_if(F.col("value") < F.lit(found[f"q{p}_value"])).alias(f"_below{p}") for p in (10, 50, 90)],
        *[F.count_if(F.col("value") <= F.lit(found[f"q{p}_value"])).alias(f"_upto{p}") for p in (10, 50, 90)],
        F.count("value").alias("_n"),
    )
    rows = [
        F.struct(F.lit(f"distinct_{c}").alias("measure"), F.col(f"distinct_{c}").alias("exact"),
                 (F.abs(F.lit(found[f"distinct_{c}"]) - F.col(f"distinct_{c}")) <= sketches.HLL_ERROR * F.col(f"distinct_{c}")).alias("within"))
        for c in ("event_id", "user_id")
    ] + [
        F.struct(F.lit(f"q{p}_value").alias("measure"), F.col(f"q{p}_value").alias("exact"),
                 ((F.col(f"_below{p}") / F.col("_n") <= p / 100 + sketches.KLL_ERROR)
                  & (F.col(f"_upto{p}") / F.col("_n") >= p / 100 - sketches.KLL_ERROR)).alias("within"))
        for p in (10, 50, 90)
    ]
    return rounded(exact.select("n_rows", F.inline(F.array(*rows))), ["n_rows", "measure", "within"], ["exact"])
