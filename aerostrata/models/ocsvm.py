"""One-class SVM with an RBF kernel, as a linear problem over random cosine features.

Random Fourier features (Rahimi, Recht 2007) turn the kernel into a dot product; the primal
one-class objective (Schoelkopf et al. 2001) is then minimised by subgradient steps. A step is
one aggregate over all rows; only vectors of the feature count travel to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from aerostrata.session import compact


def cosine_features(points: np.ndarray, directions: np.ndarray, phases: np.ndarray) -> np.ndarray:
    return np.sqrt(2.0 / len(phases)) * np.cos(points @ directions.T + phases)


class _SvmParams(HasFeaturesCol, HasPredictionCol, HasSeed):
    nu = Param(Params._dummy(), "nu", "expected share of outliers", TypeConverters.toFloat)
    numFeatures = Param(Params._dummy(), "numFeatures", "random features", TypeConverters.toInt)
    maxIter = Param(Params._dummy(), "maxIter", "subgradient steps", TypeConverters.toInt)
    scoreCol = Param(Params._dummy(), "scoreCol", "decision value, negative for anomalies",
                     TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(
            featuresCol="features", predictionCol="prediction", seed=42, nu=0.05,
            numFeatures=256, maxIter=25, scoreCol="score",
        )


class OneClassSvm(Estimator, _SvmParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, nu=0.05, numFeatures=256, maxIter=25, seed=42):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "OneClassSvmModel":
        nu, size = self.getOrDefault("nu"), self.getOrDefault("numFeatures")
        rows = dataset.select(vector_to_array(self.getFeaturesCol()).alias("_x"))
        rows = compact(rows, rows.count()).persist()
        try:
            n, width, spread = _shape(rows)
            if n == 0:
                raise ValueError("no rows to fit")
            gamma = 1.0 / (width * spread) if spread > 0 else 1.0
            rng = np.random.default_rng(self.getOrDefault("seed"))
            directions = rng.normal(0.0, np.sqrt(2.0 * gamma), (size, width))
            phases = rng.uniform(0.0, 2.0 * np.pi, size)
            # Start from the mean of all features: the solution for nu = 1.
            w, rho = _step(rows, directions, phases, None, None, nu)[0], None
            average, weight = np.zeros(size), 0.0
            for step in range(self.getOrDefault("maxIter") + 1):
                mean, share, next_rho = _step(rows, directions, phases, w, rho, nu)
                if rho is not None:  # the first pass only finds an offset
                    rate = 1.0 / (step + 1)
                    w = (1.0 - rate) * w + rate * (share / nu) * mean
                    average, weight = average + step * w, weight + step
                rho = next_rho
            w = average / weight
            rho = _quantile(rows, directions, phases, w, nu)
        finally:
            rows.unpersist()
        model = OneClassSvmModel()
        self._copyValues(model)
        model._set(
            gamma=float(gamma), width=int(width), weights=w.tolist(), offset=float(rho)
        )
        return model


def _shape(rows: DataFrame) -> tuple[int, int, float]:
    """Row count, vector width and the variance over all cells."""
    cells = rows.select(
        F.size("_x").alias("d"),
        F.aggregate("_x", F.lit(0.0), lambda a, v: a + v).alias("s"),
        F.aggregate("_x", F.lit(0.0), lambda a, v: a + v * v).alias("q"),
    )
    r = cells.agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("d"), F.sum("s").alias("s"),
                  F.sum("q").alias("q")).first()
    if not r["n"]:
        return 0, 0, 0.0
    total = r["n"] * r["d"]
    return r["n"], r["d"], max(r["q"] / total - (r["s"] / total) ** 2, 0.0)


def _quantile(rows, directions, phases, w, nu) -> float:
    """The offset that leaves a share `nu` of the rows below it."""

    @F.pandas_udf("double")
    def project(x: pd.Series) -> pd.Series:
        return pd.Series(cosine_features(np.stack(x.to_numpy()), directions, phases) @ w)

    scored = rows.select(project("_x").alias("_f"))
    return float(scored.agg(F.percentile_approx("_f", nu, 10_000)).first()[0])


_BINS = 1 << 16


def _step(rows, directions, phases, w, rho, nu) -> tuple[np.ndarray, float, float]:
    """One pass: mean feature vector of the rows below `rho` (of all rows without weights), their
    share, and the offset that leaves a share `nu` below it under the weights `w`.

    Each task sends one partial sum per feature and a sparse histogram of its scores; both meet
    in a grouped aggregate, so the driver sees a fixed number of rows.
    """
    size = len(phases)
    reach = 1.0 if w is None else np.sqrt(2.0) * float(np.linalg.norm(w)) + 1e-12

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, hits = np.zeros(size), 0
        bins = np.zeros(_BINS, dtype=np.int64)
        for pdf in batches:
            if len(pdf) == 0:
                continue
            z = cosine_features(np.stack(pdf["_x"].to_numpy()), directions, phases)
            score = np.zeros(len(z)) if w is None else z @ w
            below = np.ones(len(z), dtype=bool) if w is None or rho is None else score <= rho
            total += z[below].sum(axis=0)
            hits += int(below.sum())
            at = np.clip(((score + reach) / (2 * reach) * _BINS).astype(int), 0, _BINS - 1)
            bins += np.bincount(at, minlength=_BINS)
        used = np.flatnonzero(bins)
        yield pd.DataFrame({"kind": 0, "at": np.arange(size), "total": total})
        yield pd.DataFrame({"kind": 1, "at": used, "total": bins[used].astype(float)})
        yield pd.DataFrame({"kind": 2, "at": [0], "total": [float(hits)]})

    summed = (
        rows.mapInPandas(partial, "kind int, at int, total double")
        .groupBy("kind", "at")
        .agg(F.sum("total").alias("total"))
        .toPandas()
        .sort_values(["kind", "at"])
    )
    sums = summed.loc[summed["kind"] == 0, "total"].to_numpy()
    scores = summed[summed["kind"] == 1]
    hits, seen = float(summed.loc[summed["kind"] == 2, "total"].sum()), scores["total"].sum()
    upto = np.searchsorted(scores["total"].cumsum().to_numpy(), nu * seen)
    edge = (scores["at"].iloc[min(int(upto), len(scores) - 1)] + 1) / _BINS
    mean = sums / hits if hits else np.zeros(size)
    return mean, hits / seen, float(edge * 2 * reach - reach)


class OneClassSvmModel(Model, _SvmParams, DefaultParamsReadable, DefaultParamsWritable):
    """score = w.z(x) - offset; below zero is an anomaly (-1)."""

    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    width = Param(Params._dummy(), "width", "input vector width", TypeConverters.toInt)
    weights = Param(Params._dummy(), "weights", "weights", TypeConverters.toListFloat)
    offset = Param(Params._dummy(), "offset", "offset", TypeConverters.toFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        size, width = self.getOrDefault("numFeatures"), self.getOrDefault("width")
        rng = np.random.default_rng(self.getOrDefault("seed"))  # the same draws as in training
        directions = rng.normal(0.0, np.sqrt(2.0 * self.getOrDefault("gamma")), (size, width))
        phases = rng.uniform(0.0, 2.0 * np.pi, size)
        w, rho = np.array(self.getOrDefault("weights")), self.getOrDefault("offset")

        @F.pandas_udf("double")
        def decision(x: pd.Series) -> pd.Series:
            if len(x) == 0:
                return pd.Series([], dtype="float64")
            return pd.Series(cosine_features(np.stack(x.to_numpy()), directions, phases) @ w - rho)

        score = self.getOrDefault("scoreCol")
        return dataset.withColumn(score, decision(vector_to_array(self.getFeaturesCol()))).withColumn(
            self.getPredictionCol(), F.when(F.col(score) < 0, -1).otherwise(1)
        )
