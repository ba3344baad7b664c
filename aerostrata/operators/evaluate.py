"""Evaluation of predictions held as one long table (model, sample, truth, prediction)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

METRICS = ["accuracy", "precision", "recall", "f1"]


def _ratio(top: Column, bottom: Column) -> Column:
    """A quotient that is 0 when there is nothing to divide by."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def confusion_counts(
    predictions: DataFrame, by: list[str], truth: str = "y", predicted: str = "pred"
) -> DataFrame:
    """tn, fp, fn, tp per group in one aggregate."""
    y, p = F.col(truth), F.col(predicted)
    return predictions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    )


def classification_report(
    predictions: DataFrame,
    by: list[str],
    truth: str = "y",
    predicted: str = "pred",
    label: str = "health_risk",
) -> DataFrame:
    """Counts, accuracy, precision, recall, F1 and the confusion matrix per group."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return confusion_counts(predictions, by, truth, predicted).select(
        *by,
        F.lit(label).alias("label"),
        "n_samples",
        (tp + fn).alias("n_positive"),
        (tn + fp).alias("n_negative"),
        _ratio(tp + tn, F.col("n_samples")).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        F.array(F.array(tn, fp), F.array(fn, tp)).alias("confusion_matrix"),
    )


def anomaly_report(
    predictions: DataFrame, by: list[str], predicted: str = "pred", truth: str | None = "y"
) -> DataFrame:
    """Detector report. Predictions are -1 (anomaly) or +1; the truth, when known, is 1 or 0."""
    found = F.when(F.col(predicted) == -1, 1).otherwise(0)
    if truth is None:
        return predictions.groupBy(*by).agg(
            F.count(F.lit(1)).alias("n_samples"), F.sum(found).alias("n_anomalies_detected")
        )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    flagged = predictions.withColumn("_found", found)
    return confusion_counts(flagged, by, truth, "_found").select(
        *by,
        "n_samples",
        (tp + fp).alias("n_anomalies_detected"),
        (tp + fn).alias("n_true_anomalies"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def cv_summary(fold_reports: DataFrame, by: str = "model") -> DataFrame:
    """Mean and population deviation over folds of every metric the reports hold."""
    known = [*METRICS, "latency_ms", "train_time_ms", "cpu_pct", "ram_percent"]
    aggs = [F.count(F.lit(1)).alias("n_folds")]
    for m in known:
        if m in fold_reports.columns:
            aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return fold_reports.groupBy(by).agg(*aggs)


@F.pandas_udf(T.DoubleType())
def _chi_square_tail(statistic: pd.Series) -> pd.Series:
    # Upper tail with one degree of freedom; Spark has no error function.
    return statistic.map(lambda x: math.erfc(math.sqrt(x / 2.0)))


def mcnemar_counts(predictions: DataFrame, models: list[str], sample: str = "chrono_idx") -> DataFrame:
    """b (only the first is right), c (only the second is right) and the statistic per pair.

    Pairs follow the order of `models`. Each sample is reduced to one row of right/wrong flags
    first, so no pair of rows is ever formed: one shuffle by sample, then one small aggregate.
    """
    right = predictions.groupBy(sample).pivot("model", models).agg(
        F.max((F.col("y") == F.col("pred")).cast("int"))
    )
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i + 1:]]
    counts = right.agg(*[
        expr
        for i, (m1, m2) in enumerate(pairs)
        for expr in (
            F.count_if((F.col(f"`{m1}`") == 1) & (F.col(f"`{m2}`") == 0)).alias(f"b{i}"),
            F.count_if((F.col(f"`{m1}`") == 0) & (F.col(f"`{m2}`") == 1)).alias(f"c{i}"),
        )
    ])
    listed = F.array(*[
        F.struct(
            F.lit(m1).alias("model1"), F.lit(m2).alias("model2"),
            F.col(f"b{i}").alias("b"), F.col(f"c{i}").alias("c"),
        )
        for i, (m1, m2) in enumerate(pairs)
    ])
    b, c = F.col("b"), F.col("c")
    return counts.select(F.inline(listed)).withColumn(
        "statistic", _ratio(F.pow(F.abs(b - c) - 1, F.lit(2)), b + c)
    )


def mcnemar(predictions: DataFrame, models: list[str], sample: str = "chrono_idx") -> DataFrame:
    """McNemar test with continuity correction for every pair; no disagreement gives p = 1."""
    return with_p_value(mcnemar_counts(predictions, models, sample))


def with_p_value(counts: DataFrame) -> DataFrame:
    p = F.when(F.col("b") + F.col("c") == 0, F.lit(1.0)).otherwise(_chi_square_tail("statistic"))
    return counts.withColumn("p_value", p).withColumn("significant", F.col("p_value") < 0.05)
