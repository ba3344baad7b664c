"""Logistic regression by Newton steps, for one training set or several expanding ones at once.

A task adds up, over its rows, the loss, the gradient and the matrix of second derivatives: for 60 columns
61 x 61 numbers, however many rows there are. The driver solves that system and sends the next
coefficients, so a fit is about ten passes and its answer can be checked: the gradient is zero there.

Folds that grow in time share their passes. What imputing and scaling need (counts, means, squared
deviations) is taken once per segment between two bounds and merged to the prefix of each fold;
each pass then serves all folds with one read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import (
    HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasWeightCol,
)
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from aerostrata.models.scaler import FeatureScalerModel

PENALTY = 1.0  # on half the squared coefficients, against the summed loss; the intercept is free
PASSES = 60
SUMS = 64  # rows of sums that come to the driver at most
_ONE_CLASS = 1e3  # intercept where only one class was seen


@dataclass
class Prefix:
    """The rows before `end` (all without one): how their columns are filled and scaled, how classes weigh."""

    end: int | None
    counts: dict[int, int]
    means: np.ndarray
    deviations: np.ndarray

    @property
    def n(self) -> int:
        return sum(self.counts.values())

    def class_weights(self) -> np.ndarray:
        """n / (2 n_class) by class."""
        return np.array([self.n / (2.0 * self.counts[c]) if self.counts.get(c) else 1.0 for c in (0, 1)])

    def scaler(self, columns: list[str]) -> FeatureScalerModel:
        model = FeatureScalerModel()
        return model._set(inputCols=columns, outputCol="features", missing="mean",
                          means=self.means.tolist(), deviations=self.deviations.tolist())


def prefixes(table: DataFrame, columns: list[str], ends: list[int], label: str = "y", idx: str = "chrono_idx") -> list[Prefix]:
    """What every prefix of the ordered rows needs, from one aggregate per segment between `ends`."""
    bounds = sorted(set(ends))
    segment = F.lit(0)
    for b in bounds:
        segment = segment + F.when(F.col(idx) >= b, 1).otherwise(0)
    values = [F.col(f"`{c}`").cast("double") for c in columns]
    aggs = [F.count_if(F.col(label) == v).alias(f"_y{v}") for v in (0, 1)]
    for k, v in enumerate(values):
        aggs += [F.count(v).alias(f"_n{k}"), F.avg(v).alias(f"_m{k}"), F.var_pop(v).alias(f"_v{k}")]
    rows = table.groupBy(segment.alias("_segment")).agg(*aggs).filter(F.col("_segment") < len(bounds)).collect()
    found, width = {}, len(columns)
    n, mean, squares = np.zeros(width), np.zeros(width), np.zeros(width)
    classes = np.zeros(2, np.int64)
    by_segment = {r["_segment"]: r for r in rows}  # one row per bound at most
    for i, end in enumerate(bounds):
        r = by_segment.get(i)
        if r is not None:
            m = np.array([r[f"_n{k}"] for k in range(width)], float)
            avg = np.array([r[f"_m{k}"] or 0.0 for k in range(width)])
            var = np.array([r[f"_v{k}"] or 0.0 for k in range(width)])
            both = np.maximum(n + m, 1.0)
            off = avg - mean
            squares = squares + var * m + off**2 * n * m / both
            mean = mean + off * m / both
            n, classes = n + m, classes + [r["_y0"], r["_y1"]]
        size = max(int(classes.sum()), 1)
        spread = np.sqrt(squares / size)  # filled rows lie on the mean
        found[end] = Prefix(end, {c: int(classes[c]) for c in (0, 1) if classes[c]}, mean.copy(), np.where(spread > 0, spread, 1.0))
    return [found[e] for e in ends]


def _sums(fits: list[Prefix], weights: np.ndarray):
    """Loss, gradient and second derivatives of every fit at its `weights`, summed over a partition."""
    width = weights.shape[1]
    size = 1 + width + width * width
    class_weights = [f.class_weights() for f in fits]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(fits), size))
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            y, at, own = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            for k, fit in enumerate(fits):
                rows = slice(None) if fit.end is None else at < fit.end
                z, t = x[rows], y[rows]
                if not len(z):
                    continue
                z = (np.where(np.isnan(z), fit.means, z) - fit.means) / fit.deviations
                z = np.column_stack([np.ones(len(z)), z])
                s = own[rows] * class_weights[k][t]
                margin = z @ weights[k]
                p = 0.5 * (1.0 + np.tanh(0.5 * margin))
                total[k, 0] += (s * (np.logaddexp(0.0, margin) - t * margin)).sum()
                total[k, 1:1 + width] += z.T @ (s * (p - t))
                total[k, 1 + width:] += (z.T @ (z * (s * p * (1 - p))[:, None])).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()])], ["sums"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for row in b.column(0):
            own = row.values.to_numpy()
            total = own.copy() if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["sums"])


def newton(rows: DataFrame, fits: list[Prefix], penalty: float = PENALTY, tolerance: float = 1e-10) -> np.ndarray:
    """Coefficients, intercept first, of every fit over `rows` (x: doubles, NaN for missing, y, idx, weight).

    All fits take their steps in the same passes. A step that does not lower the loss is halved.
    """
    width = len(fits[0].means) + 1
    ridge = np.r_[0.0, np.full(width - 1, penalty)]
    best, trial = np.zeros((len(fits), width)), np.zeros((len(fits), width))
    step, loss = np.zeros_like(best), np.full(len(fits), np.inf)
    open_ = np.array([len(f.counts) == 2 for f in fits])
    many = rows.rdd.getNumPartitions() > SUMS
    for _ in range(PASSES):
        if not open_.any():
            break
        now = np.flatnonzero(open_)
        summed = rows.mapInArrow(_sums([fits[k] for k in now], trial[now]), "sums array<double>")
        if many:
            summed = summed.repartition(SUMS).mapInArrow(_added, "sums array<double>")
        total = np.sum([r["sums"] for r in summed.collect()], axis=0).reshape(len(now), -1)
        for k, sums in zip(now, total):
            value = sums[0] + 0.5 * (ridge * trial[k] ** 2).sum()
            if value > loss[k] * (1 + 1e-12) + 1e-12 and np.abs(step[k]).max() > 1e-12:
                step[k] /= 2
                trial[k] = best[k] + step[k]
                continue
            best[k], loss[k] = trial[k], value
            gradient = sums[1:1 + width] + ridge * best[k]
            if np.abs(gradient).max() <= tolerance * fits[k].n:
                open_[k] = False
                continue
            second = sums[1 + width:].reshape(width, width) + np.diag(ridge)
            step[k] = -np.linalg.solve(second + 1e-12 * np.trace(second) / width * np.eye(width), gradient)
            trial[k] = best[k] + step[k]
    for k, fit in enumerate(fits):
        if len(fit.counts) < 2:
            best[k, 0] = _ONE_CLASS if 1 in fit.counts else -_ONE_CLASS
    return best


def fit_prefixes(
    table: DataFrame, columns: list[str], ends: list[int], label: str = "y", idx: str = "chrono_idx"
) -> list[PipelineModel]:
    """Balanced fits on the rows before each of `ends`: scaler and classifier as one pipeline each."""
    fits = prefixes(table, columns, ends, label, idx)
    x = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for c in columns])
    rows = table.filter(F.col(idx) < max(ends)).select(
        x.alias("x"), F.col(label).cast("int").alias("y"), F.col(idx).cast("long").alias("idx"), F.lit(1.0).alias("weight")
    ).persist()
    try:
        found = newton(rows, fits)
    finally:
        rows.unpersist()
    return [PipelineModel([f.scaler(columns), _model(w)]) for f, w in zip(fits, found)]


class _LogisticParams(HasFeaturesCol, HasLabelCol, HasWeightCol, HasPredictionCol, HasProbabilityCol):
    def __init__(self):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="y", predictionCol="prediction", probabilityCol="probability")


class NewtonLogisticRegression(Estimator, _LogisticParams, DefaultParamsReadable, DefaultParamsWritable):
    """Ridge-penalised logistic regression over a vector column, labels 0 and 1, optional weights."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="y", weightCol=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> "NewtonLogisticModel":
        weight = F.col(self.getWeightCol()) if self.isDefined(self.weightCol) else F.lit(1.0)
        rows = dataset.select(
            vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("int").alias("y"),
            F.lit(0).cast("long").alias("idx"), weight.cast("double").alias("weight"),
        ).persist()
        try:
            counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
            if not counts:
                raise ValueError("no training rows")
            width = len(rows.first()["x"])
            return self._copyValues(_model(newton(rows, [_Plain(None, counts, np.zeros(width), np.ones(width))])[0]))
        finally:
            rows.unpersist()


class _Plain(Prefix):
    """Scaled rows with weights of their own."""

    def class_weights(self) -> np.ndarray:
        return np.ones(2)


class NewtonLogisticModel(Model, _LogisticParams, DefaultParamsReadable, DefaultParamsWritable):
    """A few numbers per column are the whole model; scoring is one expression."""

    coefficients = Param(Params._dummy(), "coefficients", "one per feature", TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "of the margin", TypeConverters.toFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights = F.array(*[F.lit(c) for c in self.getOrDefault("coefficients")])
        terms = F.zip_with(vector_to_array(self.getFeaturesCol()), weights, lambda x, w: x * w)
        margin = F.aggregate(terms, F.lit(self.getOrDefault("intercept")), lambda a, x: a + x)
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_margin")))
        return dataset.withColumn("_margin", margin).withColumns({
            self.getProbabilityCol(): array_to_vector(F.array(F.lit(1.0) - p, p)),
            self.getPredictionCol(): F.when(F.col("_margin") > 0, 1.0).otherwise(0.0),
        }).drop("_margin")


def _model(weights: np.ndarray) -> NewtonLogisticModel:
    return NewtonLogisticModel()._set(intercept=float(weights[0]), coefficients=weights[1:].tolist())


def gradient(table: DataFrame, model: PipelineModel, label: str = "y", penalty: float = PENALTY) -> DataFrame:
    """The mean gradient of a balanced fit's penalised loss over its training rows: (term, n_train, gradient).

    Recomputed from the model's own predictions in one aggregate; zero everywhere exactly at the answer.
    """
    scaler, logistic = model.stages
    names = ["intercept", *scaler.getInputCols()]
    scored = model.transform(table).select(
        vector_to_array("features").alias("x"), vector_to_array("probability")[1].alias("p"), F.col(label).cast("int").alias("t")
    )
    sizes = scored.groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()
    n = sum(r["n"] for r in sizes)
    weight = F.lit(0.0)
    for r in sizes:
        weight = F.when(F.col("t") == r["t"], n / (2.0 * r["n"])).otherwise(weight)
    pull = (weight * (F.col("p") - F.col("t"))).alias("r")
    width = len(names) - 1
    sums = scored.select("x", pull).agg(F.sum("r").alias("g0"), *[F.sum(F.col("r") * F.col("x")[k]).alias(f"g{k + 1}") for k in range(width)])
    ridge = [0.0, *(penalty * c for c in logistic.getOrDefault("coefficients"))]
    terms = F.array(*[
        F.struct(F.lit(name).alias("term"), ((F.col(f"g{k}") + F.lit(w)) / n).alias("gradient")) for k, (name, w) in enumerate(zip(names, ridge))
    ])
    return sums.select(F.inline(terms)).select("term", F.lit(n).cast("bigint").alias("n_train"), "gradient")
