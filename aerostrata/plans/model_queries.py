"""Registered queries that train, score or stream."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from aerostrata.models.logreg import fit_prefixes, gradient
from aerostrata.models.registry import ModelRegistry, latest_by_name
from aerostrata.models.scaler import FeatureScaler
from aerostrata.models.supervised import confidence, fit_classifiers
from aerostrata.operators import features as ft, labels, microbatch
from aerostrata.operators.folds import fold_bounds, temporal_split
from aerostrata.plans import fleet
from aerostrata.plans.catalog import (
    FEATURES, feature_table, kept_features, observations, register, rounded,
)
from aerostrata.plans.scoring import ANOMALY, CLASSIFICATION, SCORED_DETECTORS, score_batches
from aerostrata.plans.study import (
    anomaly_study, chronological_table, classification_study, enrich, fit_detector,
)
from aerostrata.schema import CORE_FIELDS, SYSTEM_FIELDS, feature_names
from aerostrata.session import materialize, scratch_dir
from aerostrata.sources import tables
from aerostrata.streaming import CountWindow, observation_stream, scorer, write_metrics
from aerostrata.streaming.event_time import LateRouter, append_table, join_metrics, outages, sessions

# --- supervised --------------------------------------------------------------------------------


def _classifier_scores(spark, folder, name):
    labelled = labels.health_labels(kept_features(spark, folder))
    table, n = chronological_table(labelled, "health_risk", 7, FEATURES)
    split = temporal_split(table, n=n)
    model = fit_classifiers(split.filter("split = 'train'"), FEATURES, [name])[name]
    scored = model.transform(split.filter("split = 'test'"))
    return scored.select("batch_id", "y", F.col("prediction").cast("int").alias("prediction"),
                         confidence().alias("score"))


@register
def score_logreg(spark, folder):
    """Logistic regression on the last fifth, by Newton steps; see logreg_fold_gradients for its oracle."""
    return _classifier_scores(spark, folder, "logistic_regression")


@register
def score_tree(spark, folder):
    """Decision tree on the last fifth; rows only."""
    return _classifier_scores(spark, folder, "decision_tree")


@register
def score_forest(spark, folder):
    """Random forest on the last fifth; rows only."""
    return _classifier_scores(spark, folder, "random_forest")


@register
def logreg_fold_gradients(spark, folder):
    """The logistic fits of all folds and of the final split: rows trained on, and the gradient at the answer."""
    labelled = labels.health_labels(kept_features(spark, folder))
    table, n = chronological_table(labelled, "health_risk", 7, FEATURES)
    n_train = int(n * 0.8)
    ends = {fold: first for fold, first, _ in fold_bounds(n_train)} | {-1: n_train}
    out = None
    for (fold, end), model in zip(ends.items(), fit_prefixes(table, FEATURES, list(ends.values()))):
        own = gradient(table.filter(F.col("chrono_idx") < end), model).select(
            F.lit(fold).alias("fold"), "term", "n_train", (F.abs(F.round("gradient", 6)) + 0.0).alias("gradient"))
        out = own if out is None else out.unionByName(own)
    return out


def _classification(spark, folder, report, temporal=False):
    table, columns = feature_table(spark, folder), FEATURES
    if temporal:
        table, columns = enrich(table, columns)
    return classification_study(table, columns).reports[report]


@register
def classification_cv(spark, folder):
    """Cross-validation summary of all classifiers with time and rolling features; rows only."""
    return _classification(spark, folder, "cv", temporal=True)


@register
def classification_final(spark, folder):
    """Hold-out report of all classifiers; rows only."""
    return _classification(spark, folder, "final")


@register
def classification_mcnemar(spark, folder):
    """McNemar tests between all classifiers on the hold-out part; rows only."""
    return _classification(spark, folder, "mcnemar")


# --- detectors ---------------------------------------------------------------------------------


def _detector_scores(spark, folder, name, exclude_self=True):
    table = feature_table(spark, folder)
    scaler = FeatureScaler(inputCols=FEATURES).fit(table)
    vectors = scaler.transform(table).select("batch_id", "features").persist()
    try:
        model = PipelineModel([scaler, *fit_detector(name, vectors, exclude_self)])
    finally:
        vectors.unpersist()
    return model.transform(table)


@register
def score_iforest(spark, folder):
    """Isolation forest scores; every choice follows a keyed hash."""
    return rounded(_detector_scores(spark, folder, "isolation_forest"), ["batch_id", "prediction"], ["score"])


@register
def score_lof(spark, folder):
    """Local outlier factor of every batch by exact neighbours."""
    scored = _detector_scores(spark, folder, "local_outlier_factor")
    return rounded(scored, ["batch_id", "prediction"], ["lof"])


@register
def score_lof_novelty(spark, folder):
    """The factor as a novelty detector gives it to its own training rows: each finds itself first."""
    scored = _detector_scores(spark, folder, "local_outlier_factor", exclude_self=False)
    return rounded(scored, ["batch_id", "prediction"], ["lof"])


@register
def score_lof_pca(spark, folder):
    """Local outlier factor on fifteen principal components; rows only."""
    scored = _detector_scores(spark, folder, "local_outlier_factor_pca")
    return scored.select("batch_id", "lof", "score", "prediction")


@register
def score_ocsvm(spark, folder):
    """One-class SVM scores; iterative and over random features, so rows only."""
    return _detector_scores(spark, folder, "one_class_svm").select("batch_id", "score", "prediction")


@register
def anomaly_rule_report(spark, folder):
    """Detectors against the range rule; rows only."""
    return anomaly_study(feature_table(spark, folder)).reports["rule"]


@register
def anomaly_synthetic_report(spark, folder):
    """All detectors against injected anomalies; rows only."""
    return anomaly_study(feature_table(spark, folder)).reports["synthetic"]


@register
def classification_final_system(spark, folder):
    """The hold-out report of all classifiers trained with system load: what they were judged on, and with how many features."""
    obs, fields = observations(spark, folder), CORE_FIELDS + SYSTEM_FIELDS
    scan = tables.scan_with_metrics(obs, fleet.runtime_metrics(obs), dedupe_metrics=True)
    table = materialize(spark, ft.batch_features(scan, fields, min_rows=microbatch.batch_size()), "features")
    study = classification_study(table, feature_names(fields))
    return study.reports["final"].select("model", "n_samples", "n_positive", "n_negative", F.lit(len(study.columns)).alias("n_features"))


@register
def anomaly_rule_temporal(spark, folder):
    """Detectors trained with time and rolling features, against the range rule, and how many features they saw."""
    study = anomaly_study(*enrich(feature_table(spark, folder), FEATURES))
    return study.reports["rule"].select("model", "n_samples", "n_true_anomalies", F.lit(len(study.columns)).alias("n_features"))


# --- registry and scoring ----------------------------------------------------------------------


def _all_models(table: DataFrame) -> dict[str, tuple[str, PipelineModel]]:
    """All classifiers and all detectors that score new batches, fitted on a feature table."""
    labelled = labels.health_labels(table, out="y")
    models = {name: (CLASSIFICATION, m) for name, m in fit_classifiers(labelled, FEATURES).items()}
    scaler = FeatureScaler(inputCols=FEATURES).fit(table)
    vectors = scaler.transform(table).select("batch_id", "features").persist()
    try:
        for name in SCORED_DETECTORS:
            models[name] = ANOMALY, PipelineModel([scaler, *fit_detector(name, vectors)])
    finally:
        vectors.unpersist()
    return models


@register
def registry_latest(spark, folder):
    """Newest entry per exact model name; names with a suffix are other models."""
    e = F.col("event_id")
    entries = fleet.read_events(spark, folder).select(
        F.when(e % 2 == 0, F.col("event_type")).otherwise(F.concat("event_type", F.lit("_scaler")))
        .alias("model_name"),
        F.col("ts").alias("saved_at"),
        F.concat(F.lit("models/"), e.cast("string")).alias("path"),
    )
    return latest_by_name(entries)


@register
def score_new_batches(spark, folder):
    """Train and save models, load the latest ones and score all batches, open ones too."""
    obs = materialize(spark, observations(spark, folder), "observations")
    registry = ModelRegistry(spark, scratch_dir(spark, "models"))
    for name, (_, model) in _all_models(feature_table(spark, folder)).items():
        registry.save(model, name)
    return score_batches(obs, registry)


# --- streams -----------------------------------------------------------------------------------


def _cycle_stream(spark, folder) -> DataFrame:
    """The event table as a stream of collection cycles."""
    schema = fleet.read_events(spark, folder).schema
    return _cycles(observation_stream(spark, folder, schema, pathGlobFilter="events.parquet"))


def _cycles(events: DataFrame) -> DataFrame:
    return events.withColumns({
        "station_id": F.col("user_id") % 8, "measured_at": F.expr("ts + INTERVAL '2' SECOND"),
    })


def _drained(query) -> None:
    query.awaitTermination()


def _windowed(spark, folder, arrivals: int = 3, change=None, **options) -> CountWindow:
    """A window that ran once for each part of the events, split by time; the state carries over."""
    window = CountWindow(scratch_dir(spark, "stream"), **options)
    events = fleet.read_events(spark, folder)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(at), F.max(at)).first()
    if low is None:
        low = high = 0
    part = F.least(F.floor((at - low) * arrivals / F.lit(high - low + 1)), F.lit(arrivals - 1))
    inbox, progress = scratch_dir(spark, "inbox"), scratch_dir(spark, "progress")
    for k in range(arrivals):
        events.filter(part == k).write.mode("append").parquet(inbox)
        cycles = _cycles(observation_stream(spark, inbox, events.schema))
        _drained(window.start(change(cycles) if change else cycles, progress))
    return window


@register
def stream_microbatches(spark, folder):
    """Closed batches as the stream delivers them; equals the batch form."""
    rows = _windowed(spark, folder).observations(spark)
    return rows.select("station_id", "event_id", "batch_id", "row_in_batch")


@register
def stream_microbatches_no_station(spark, folder):
    """The stream where every other cycle names no station: those are station 0."""
    unnamed = F.when(F.col("event_id") % 2 != 0, F.col("station_id"))
    window = _windowed(spark, folder, change=lambda cycles: cycles.withColumn("station_id", unnamed))
    return window.observations(spark).select("station_id", "event_id", "batch_id", "row_in_batch")


@register
def stream_headers(spark, folder):
    """Headers the stream wrote for closed batches."""
    headers = _windowed(spark, folder).headers(spark)
    return headers.select("batch_id", "start_ts", "end_ts", "record_count")


@register
def stream_metrics(spark, folder):
    """Metrics rows written by their own stream."""
    path = scratch_dir(spark, "metrics")
    e = F.col("event_id")
    metrics = _cycle_stream(spark, folder).filter(e % 17 != 0).select(
        "ts", "event_id", F.concat(F.lit("c"), e.cast("string")).alias("cycle_id"),
        ((e * 37) % 100).cast("double").alias("cpu_pct"),
        (F.lit(40) + e % 20).cast("double").alias("ram_percent"),
    )
    _drained(write_metrics(metrics, path, scratch_dir(spark, "progress")))
    return spark.read.parquet(path).select("event_id", "cycle_id", "cpu_pct", "ram_percent")


_DELAY_S = 3600


def _arrivals(rows: DataFrame, root: str, delayed=None, arrivals: int = 3) -> LateRouter:
    """Route `rows` in parts split by time, in no order inside a part, and a heartbeat that moves the
    clock on, so that what waits for the watermark comes out. `delayed` rows come with the last part."""
    spark = rows.sparkSession
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = rows.agg(F.min(at), F.max(at)).first()
    low, high = (0, 0) if low is None else (low, high)
    part = F.least(F.floor((at - low) * arrivals / F.lit(high - low + 1)), F.lit(arrivals - 1))
    if delayed is not None:
        part = F.when(delayed, arrivals - 1).otherwise(part)
    inbox, progress = scratch_dir(spark, "inbox"), scratch_dir(spark, "progress")
    router = LateRouter(root, delay_s=_DELAY_S)
    # The keys of a heartbeat are there: an outer join reads no row of its right side without them.
    ahead = F.timestamp_micros(F.lit(high + 30 * 86_400_000_000))
    sent = {"ts": ahead, "measured_at": ahead, "batch_id": F.lit(""), "row_in_batch": F.lit(-1)}
    beat = spark.range(1).select(*[sent.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema])
    for k in range(arrivals + 1):
        (rows.filter(part == k).orderBy(F.xxhash64("event_id")) if k < arrivals else beat).write.mode("append").parquet(inbox)
        _drained(router.start(observation_stream(spark, inbox, rows.schema), progress))
    return router


@register
def stream_with_metrics(spark, folder):
    """Observations and metrics as two streams with watermarks; equals the batch join."""
    obs = observations(spark, folder)
    metrics = fleet.runtime_metrics(obs).select("ts", "event_id", "batch_id", "row_in_batch", "cpu_pct", "ram_percent")
    sides = [_arrivals(x, scratch_dir(spark, "routed")).in_time(spark, x.schema) for x in (obs, metrics)]
    path = scratch_dir(spark, "joined")
    _drained(append_table(join_metrics(*sides, delay_s=_DELAY_S), path, scratch_dir(spark, "progress")))
    joined = spark.read.parquet(path).filter("event_id IS NOT NULL")
    scan = tables.scan_observations(joined, ["cpu_pct", "ram_percent"])
    return rounded(scan, [c for c in scan.columns if c not in CORE_FIELDS], CORE_FIELDS)


@register
def stream_outages(spark, folder):
    """Pauses of more than an hour from event-time sessions over rows in no order; equals data_gaps_1h."""
    obs = observations(spark, folder)
    stream = _arrivals(obs, scratch_dir(spark, "routed")).in_time(spark, obs.schema)
    path = scratch_dir(spark, "sessions")
    _drained(append_table(sessions(stream, 1, _DELAY_S), path, scratch_dir(spark, "progress")))
    closed = spark.read.parquet(path).filter("station_id IS NOT NULL")
    return rounded(outages(closed), ["station_id", "gap_start", "gap_end"], ["gap_hours"])


@register
def stream_late_rows(spark, folder):
    """Rows that come after the watermark has passed them, in a table of their own: one cycle in 97 is held back."""
    obs = observations(spark, folder).select("event_id", "station_id", "ts")
    router = _arrivals(obs, scratch_dir(spark, "routed"), delayed=F.col("event_id") % 97 == 0)
    return router.late(spark, obs.schema)


@register
def stream_scored(spark, folder):
    """Batches scored as they close, by all models fitted before; rows only."""
    models = _all_models(feature_table(spark, folder))
    path = scratch_dir(spark, "scores")
    hook = scorer(lambda: models, path, readings=fleet.readings)
    _windowed(spark, folder, on_closed=hook)
    return spark.read.parquet(path).drop("epoch", "timestamp")
