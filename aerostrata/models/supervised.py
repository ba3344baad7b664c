"""Health-risk classifiers."""

from __future__ import annotations

import time

from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from aerostrata.models.logreg import NewtonLogisticRegression
from aerostrata.models.scaler import FeatureScaler
from aerostrata.session import settled

CLASSIFIERS = ["logistic_regression", "decision_tree", "random_forest"]


def class_counts(train: DataFrame, label: str = "y") -> dict[int, int]:
    """Rows per class; two rows at most come to the driver."""
    rows = train.groupBy(F.col(label).cast("int").alias("label")).count().collect()
    return {r["label"]: r["count"] for r in rows}


def balanced_weight(counts: dict[int, int], label: str = "y") -> Column:
    """n / (2 n_class) for each row; a class that is absent needs no weight."""
    n = sum(counts.values())
    weight = F.lit(1.0)
    for value, size in counts.items():
        weight = F.when(F.col(label) == value, F.lit(n / (2.0 * size))).otherwise(weight)
    return weight


def classifier(name: str):
    """The learner of that name with its fixed settings."""
    shared = dict(featuresCol="features", labelCol="y", weightCol="weight")
    if name == "logistic_regression":
        return NewtonLogisticRegression(**shared)
    if name == "decision_tree":
        return DecisionTreeClassifier(maxDepth=5, maxBins=256, seed=42, **shared)
    if name == "random_forest":
        return RandomForestClassifier(numTrees=50, maxDepth=5, seed=42, **shared)
    raise ValueError(f"unknown classifier {name}")


def fit_classifiers(
    train: DataFrame,
    columns: list[str],
    names: list[str] = CLASSIFIERS,
    label: str = "y",
    times_ms: dict[str, float] | None = None,
    key: str = "batch_id",
) -> dict[str, PipelineModel]:
    """Scale once, then fit each learner on the cached vectors; every result is a pipeline.

    `times_ms` receives the fitting time of each learner. `key` names a unique column; the models do
    not depend on how the rows are laid out.
    """
    counts = class_counts(train, label)
    if not counts:
        raise ValueError("no training rows")
    scaler = FeatureScaler(inputCols=columns).fit(train)
    vectors = scaler.transform(train).select(key, "features", F.col(label).cast("double").alias("y"))
    vectors = vectors.withColumn("weight", balanced_weight(counts))
    if "random_forest" in names:  # it draws its samples by partition
        vectors = settled(vectors, sum(counts.values()), key)
    vectors = vectors.drop(key).persist()
    try:
        fitted = {}
        for name in names:
            start = time.perf_counter()
            model = classifier(name).fit(vectors)
            fitted[name] = PipelineModel([scaler, model])
            if times_ms is not None:
                times_ms[name] = (time.perf_counter() - start) * 1000.0
        return fitted
    finally:
        vectors.unpersist()


def confidence(probability: str = "probability") -> Column:
    """Highest class probability."""
    return F.array_max(vector_to_array(probability))
