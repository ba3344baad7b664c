"""Imputation and scaling as a pipeline stage that keeps its training means."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from aerostrata.operators.prep import fit_standardizer


class _ScalerParams(HasInputCols, HasOutputCol):
    missing = Param(
        Params._dummy(), "missing", "value for missing inputs: 'mean' of training, or raw 'zero'",
        TypeConverters.toString,
    )

    def __init__(self):
        super().__init__()
        self._setDefault(missing="mean", outputCol="features")


class FeatureScaler(Estimator, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fit means and population deviations of the input columns in one aggregate."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol="features", missing="mean"):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> "FeatureScalerModel":
        cols = self.getInputCols()
        row = fit_standardizer(dataset, cols).first()
        model = FeatureScalerModel()
        model._set(
            inputCols=cols, outputCol=self.getOutputCol(), missing=self.getOrDefault("missing"),
            means=[row[f"_m_{c}"] for c in cols], deviations=[row[f"_s_{c}"] for c in cols],
        )
        return model


class FeatureScalerModel(Model, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    """Adds a vector of standardised features; a few numbers per column are the whole model."""

    means = Param(Params._dummy(), "means", "training means", TypeConverters.toListFloat)
    deviations = Param(
        Params._dummy(), "deviations", "population deviations, 1 for constants",
        TypeConverters.toListFloat,
    )

    def with_missing(self, rule: str) -> "FeatureScalerModel":
        """A copy that fills missing inputs by another rule."""
        return self.copy({self.missing: rule})

    def filled(self, dataset: DataFrame) -> DataFrame:
        """The raw columns with missing values filled from the training means."""
        return dataset.withColumns({
            c: F.expr(f"coalesce(CAST(`{c}` AS DOUBLE), {m!r}D)")
            for c, m in zip(self.getInputCols(), self.getOrDefault("means"))
        })

    def _transform(self, dataset: DataFrame) -> DataFrame:
        zero = self.getOrDefault("missing") == "zero"
        parts = [
            f"(coalesce(CAST(`{c}` AS DOUBLE), {'0D' if zero else repr(m) + 'D'}) - {m!r}D) / {s!r}D"
            for c, m, s in zip(
                self.getInputCols(), self.getOrDefault("means"), self.getOrDefault("deviations")
            )
        ]
        vector = array_to_vector(F.expr(f"array({', '.join(parts)})"))
        return dataset.withColumn(self.getOutputCol(), vector)
