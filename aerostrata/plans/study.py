"""Training studies: classifiers under chronological splits, detectors on two kinds of truth."""

from __future__ import annotations

import time
import warnings
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import PCA
from pyspark.sql import DataFrame, SparkSession, functions as F

from aerostrata.models.iforest import IsolationForest
from aerostrata.models.lof import LocalOutlierFactor
from aerostrata.models.logreg import fit_prefixes
from aerostrata.models.ocsvm import OneClassSvm
from aerostrata.models.registry import ModelRegistry
from aerostrata.models.scaler import FeatureScaler
from aerostrata.models.supervised import CLASSIFIERS, class_counts, confidence, fit_classifiers
from aerostrata.operators import evaluate, features as ft, folds, labels, prep
from aerostrata.schema import CORE_FIELDS, CV_FOLDS, ROLLING_FIELDS, ROLLING_WINDOW, feature_names
from aerostrata.session import materialize, scratch_dir
from aerostrata.sources.sinks import union_reports

BASELINE = "threshold_baseline"
LOGISTIC = "logistic_regression"
RULE_BASELINE = "rule_based_baseline"
DETECTORS = [
    "isolation_forest", "local_outlier_factor", "local_outlier_factor_pca", "one_class_svm",
]


@dataclass
class Study:
    """Results of a study; reports are small frames, predictions one long written table."""

    predictions: DataFrame
    reports: dict[str, DataFrame]
    models: dict[str, PipelineModel]
    columns: list[str] = field(default_factory=list)


def enrich(features: DataFrame, columns: list[str], keys: list[str] | None = None):
    """Add time and rolling features; returns the frame and its feature columns."""
    rolled = ft.rolling_features(ft.temporal_features(features), keys=keys)
    extra = ["hour_sin", "hour_cos", "day_of_week"]
    extra += [f"{f}_roll{ROLLING_WINDOW}" for f in ROLLING_FIELDS if f in columns]
    return rolled, columns + extra


def chronological_table(
    features: DataFrame, label: str, need: int, columns: list[str]
) -> tuple[DataFrame, int]:
    """The labelled features with their index, written in time order, and their number.

    Time order on storage lets every fold read only its own range of row groups.
    """
    spark = features.sparkSession
    features = materialize(spark, features, "features")
    n = features.count()
    if n < need:
        raise ValueError(f"{n} batches are too few, {need} are needed")
    indexed = folds.chrono_index(features).select(
        "batch_id", "chrono_idx", F.col(label).alias("y"), *columns
    )
    return materialize(spark, indexed.repartitionByRange("chrono_idx"), "chronological"), n


def _between(table: DataFrame, first: int, end: int) -> DataFrame:
    return table.filter((F.col("chrono_idx") >= first) & (F.col("chrono_idx") < end))


def _predictions(scored: DataFrame, model: str, fold: int, score=None) -> DataFrame:
    return scored.select(
        F.lit(model).alias("model"), F.lit(fold).alias("fold"), "batch_id", "chrono_idx",
        F.col("y").cast("int").alias("y"), F.col("prediction").cast("int").alias("pred"),
        (F.lit(None) if score is None else score).cast("double").alias("score"),
    )


def classification_study(
    features: DataFrame,
    columns: list[str] | None = None,
    names: list[str] = CLASSIFIERS,
    n_folds: int = CV_FOLDS,
    train_share: float = 0.8,
    impute_fit: str = "train",
    registry: ModelRegistry | None = None,
) -> Study:
    """Fit the classifiers in expanding folds and on the whole training part; test on the rest.

    `features` holds batch_id, batch_ts and the feature columns. Missing values are filled with
    the means of the rows a model is trained on; `impute_fit="all"` takes the means of all rows.
    The driver loops over models and folds only; every fit and prediction is a Spark job, and the
    logistic fits of all folds share theirs.
    """
    columns = columns or feature_names()
    spark = features.sparkSession
    labelled = labels.health_labels(features)
    table, n = chronological_table(labelled, "health_risk", n_folds + 2, columns)
    if impute_fit == "all":
        table = materialize(spark, prep.impute(table, columns, prep.column_means(table, columns)), "filled")
    counts = class_counts(table)
    if len(counts) < 2:
        warnings.warn("all labels belong to one class; the classification is trivial", stacklevel=2)
    n_train = int(n * train_share)
    ranges = [(i, first, end) for i, first, end in folds.fold_bounds(n_train, n_folds)]
    path, times, models = scratch_dir(spark, "predictions"), [], {}
    parts_of = [*ranges, (-1, n_train, n)]
    logistic, others = {}, [name for name in names if name != LOGISTIC]
    if LOGISTIC in names:  # all folds share the passes over the table
        start = time.perf_counter()
        firsts = [first for _, first, _ in parts_of]
        logistic = dict(zip([fold for fold, _, _ in parts_of], fit_prefixes(table, columns, firsts)))
        shared_ms = (time.perf_counter() - start) * 1000.0 / len(parts_of)
    for fold, first, end in parts_of:
        train, held_out = _between(table, 0, first), _between(table, first, end)
        spent: dict[str, float] = {BASELINE: 0.0}
        models = fit_classifiers(train, columns, others, times_ms=spent) if others else {}
        if LOGISTIC in names:
            models[LOGISTIC], spent[LOGISTIC] = logistic[fold], shared_ms
        times += [(name, fold, ms) for name, ms in spent.items()]
        rule = models[names[0]].stages[0].filled(held_out)
        parts = [
            _predictions(rule.withColumn("prediction", labels.health_rule(columns)), BASELINE, fold)
        ] + [
            _predictions(model.transform(held_out), name, fold, confidence())
            for name, model in models.items()
        ]
        union_reports(parts).write.mode("append").parquet(path)
    predictions = spark.read.parquet(path)
    timing = spark.createDataFrame(times, "model string, fold int, train_time_ms double")
    report = evaluate.classification_report(predictions, ["model", "fold"]).join(
        F.broadcast(timing), ["model", "fold"]
    )
    reports = {
        "cv": evaluate.cv_summary(report.filter(F.col("fold") >= 0)),
        "final": report.filter(F.col("fold") < 0).drop("fold").withColumn(
            "split", F.lit("temporal_80_20")),
        "mcnemar": evaluate.mcnemar(predictions.filter(F.col("fold") < 0), [BASELINE, *names]),
    }
    if registry:
        for name, model in models.items():
            registry.save(model, name, {
                "task": "health_risk_classification", "feature_names": columns,
                "n_features": len(columns), "n_train": n_train, "n_test": n - n_train,
                "n_positive": counts.get(1, 0), "n_negative": counts.get(0, 0),
                "temporal_split": True, "cv_folds": n_folds,
            })
    return Study(predictions, reports, models, columns)


def fit_detector(name: str, vectors: DataFrame, exclude_self: bool = True) -> list:
    """Fitted stages of a detector over scaled vectors (batch_id, features)."""
    if name == "isolation_forest":
        return [IsolationForest().fit(vectors)]
    if name == "local_outlier_factor":
        return [LocalOutlierFactor(excludeSelf=exclude_self).fit(vectors)]
    if name == "local_outlier_factor_pca":
        width = len(vectors.first()["features"])
        pca = PCA(k=min(15, width), inputCol="features", outputCol="components").fit(vectors)
        lof = LocalOutlierFactor(excludeSelf=exclude_self, featuresCol="components")
        return [pca, lof.fit(pca.transform(vectors))]
    if name == "one_class_svm":
        return [OneClassSvm().fit(vectors)]
    raise ValueError(f"unknown detector {name}")


def anomaly_study(
    features: DataFrame,
    columns: list[str] | None = None,
    names: list[str] = DETECTORS,
    fraction: float = 0.02,
    seed: int = 42,
    exclude_self: bool = True,
    registry: ModelRegistry | None = None,
) -> Study:
    """Fit the detectors on all batches; judge them by the range rule and by injected anomalies."""
    columns = columns or feature_names()
    spark = features.sparkSession
    table = materialize(spark, labels.anomaly_labels(features, out="y"), "features")
    n = table.count()
    if n < 5:
        raise ValueError(f"{n} batches are too few, 5 are needed")
    scaler = FeatureScaler(inputCols=columns).fit(table)
    vectors = scaler.transform(table).select("batch_id", "features").persist()
    injected = labels.inject_anomalies(table.select("batch_id", *columns), fraction, seed)
    injected = materialize(spark, injected, "injected")
    injected = prep.impute(injected, columns, prep.column_means(injected, columns)).withColumnRenamed(
        "synthetic_anomaly", "y")
    path, times, models = scratch_dir(spark, "predictions"), [], {}

    def keep(scored: DataFrame, model: str, track: str) -> None:
        scored.select(
            F.lit(track).alias("track"), F.lit(model).alias("model"), "batch_id",
            F.col("y").cast("int").alias("y"), F.col("prediction").cast("int").alias("pred"),
            F.col("score").cast("double").alias("score"),
        ).write.mode("append").parquet(path)

    rule = table.withColumns({
        "prediction": F.when(F.col("y") == 1, -1).otherwise(1), "score": F.lit(None).cast("double"),
    })
    keep(rule, RULE_BASELINE, "rule")
    times.append((RULE_BASELINE, 0.0))
    try:
        for name in names:
            start = time.perf_counter()
            model = PipelineModel([scaler, *fit_detector(name, vectors, exclude_self)])
            times.append((name, (time.perf_counter() - start) * 1000.0))
            models[name] = model
            keep(model.transform(table), name, "rule")
            keep(model.transform(injected), name, "synthetic")
    finally:
        vectors.unpersist()
    predictions = spark.read.parquet(path)
    timing = spark.createDataFrame(times, "model string, train_time_ms double")
    report = evaluate.anomaly_report(predictions, ["track", "model"])
    reports = {
        "rule": report.filter("track = 'rule'").drop("track").join(F.broadcast(timing), "model"),
        "synthetic": report.filter("track = 'synthetic'").drop("track"),
    }
    if registry:
        flagged = class_counts(table).get(1, 0)
        for name, model in models.items():
            registry.save(model, name, {
                "task": "anomaly_detection", "feature_names": columns, "n_features": len(columns),
                "n_train": n, "n_rule_anomalies": flagged, "pca_applied": "pca" in name,
            })
    return Study(predictions, reports, models, columns)
