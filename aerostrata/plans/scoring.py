"""Scoring of new batches with the latest saved models."""

from __future__ import annotations

import sys

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, functions as F

from aerostrata.models.registry import ModelRegistry
from aerostrata.models.scaler import FeatureScalerModel
from aerostrata.models.supervised import CLASSIFIERS, confidence
from aerostrata.operators.features import batch_features
from aerostrata.session import materialize
from aerostrata.sources.sinks import union_reports

CLASSIFICATION, ANOMALY = "classification", "anomaly_detection"
SCORED_DETECTORS = ["isolation_forest", "local_outlier_factor", "one_class_svm"]


def latest_models(registry: ModelRegistry, task: str = "all") -> dict[str, tuple[str, PipelineModel]]:
    """Name -> (task, model) of the models to run; a model nobody trained is skipped."""
    wanted = []
    if task in ("classification", "all"):
        wanted += [(name, CLASSIFICATION) for name in CLASSIFIERS]
    if task in ("anomaly", "all"):
        wanted += [(name, ANOMALY) for name in SCORED_DETECTORS]
    if not wanted:
        raise ValueError(f"unknown task {task!r}")
    found = {}
    for name, kind in wanted:
        try:
            found[name] = (kind, registry.load_latest(name)[0])
        except FileNotFoundError as error:
            print(f"skip {name}: {error}", file=sys.stderr)
    if not found:
        raise ValueError("no saved model to score with; train first")
    return found


def score_features(
    features: DataFrame,
    models: dict[str, tuple[str, PipelineModel]],
    missing: str = "mean",
    at: Column | None = None,
) -> DataFrame:
    """One row per batch and model. All batches are scored, not only a first one.

    `missing="zero"` fills missing features with raw zeros instead of the training means.
    """
    stamp = F.current_timestamp() if at is None else at
    parts = []
    for name, (kind, model) in models.items():
        stages = [
            s.with_missing(missing) if isinstance(s, FeatureScalerModel) else s for s in model.stages
        ]
        scored = PipelineModel(stages).transform(features)
        prediction = F.col("prediction").cast("int")
        if kind == CLASSIFICATION:
            label = F.when(prediction == 1, "health_risk").otherwise("no_risk")
            score = confidence()
        else:
            label = F.when(prediction == -1, "anomaly").otherwise("normal")
            score = F.col("score")
        parts.append(scored.select(
            "batch_id", stamp.alias("timestamp"), F.lit(kind).alias("task"),
            F.lit(name).alias("model_name"), prediction.alias("prediction"),
            label.alias("prediction_label"), score.cast("double").alias("score"),
        ))
    return union_reports(parts)


def score_batches(
    obs: DataFrame,
    registry: ModelRegistry,
    task: str = "all",
    missing: str = "mean",
    min_rows: int | None = None,
) -> DataFrame:
    """Features of the observations and their scores; open batches count unless `min_rows` is set."""
    # Every model reads the features, and some start jobs of their own.
    features = materialize(obs.sparkSession, batch_features(obs, min_rows=min_rows), "features")
    return score_features(features, latest_models(registry, task), missing)
