import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from aerostrata.models.logreg import NewtonLogisticModel, NewtonLogisticRegression, fit_prefixes, gradient, prefixes
from aerostrata.models.scaler import FeatureScaler
from aerostrata.session import scratch_dir


def _rows(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, [1, 5, 0.2], (n, 3)) + [10, 0, -3]
    y = (x[:, 0] - 10 + 0.3 * x[:, 1] + rng.normal(0, 1, n) > 0.5).astype(int)
    rows = [(i, int(y[i]), *(None if rng.random() < 0.1 else float(v) for v in x[i]), 4.0) for i in range(n)]
    return spark.createDataFrame(rows, "chrono_idx long, y int, a double, b double, c double, d double").repartition(3)


COLUMNS = ["a", "b", "c", "d"]


def test_newton_equals_the_iterative_solver(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (300, 4))
    y = (x[:, 0] - x[:, 1] > 0).astype(float)  # separable: only the penalty bounds the answer
    weight = np.where(y == 1, 300 / (2 * y.sum()), 300 / (2 * (300 - y.sum())))
    df = spark.createDataFrame([(Vectors.dense(v), float(t), float(w)) for v, t, w in zip(x, y, weight)], ["features", "y", "weight"])
    own = NewtonLogisticRegression(weightCol="weight").fit(df)
    other = LogisticRegression(maxIter=2000, tol=1e-14, regParam=1 / 300, standardization=False, labelCol="y", weightCol="weight").fit(df)
    assert np.allclose(own.getOrDefault("coefficients"), other.coefficients.toArray(), atol=1e-4)
    assert own.getOrDefault("intercept") == pytest.approx(other.intercept, abs=1e-4)
    a, b = own.transform(df).collect(), other.transform(df).collect()
    assert np.allclose([r["probability"].toArray() for r in a], [r["probability"].toArray() for r in b], atol=1e-4)
    assert [r["prediction"] for r in a] == [r["prediction"] for r in b]
    path = scratch_dir(spark, "logistic")
    PipelineModel([own]).write().save(path)
    again = PipelineModel.load(path).stages[0]
    assert isinstance(again, NewtonLogisticModel) and again.getOrDefault("coefficients") == own.getOrDefault("coefficients")


def test_folds_equal_fits_of_their_own(spark):
    table = _rows(spark)
    ends = [60, 150, 400]
    for end, model in zip(ends, fit_prefixes(table, COLUMNS, ends)):
        train = table.filter(F.col("chrono_idx") < end)
        alone = FeatureScaler(inputCols=COLUMNS).fit(train)
        assert np.allclose(model.stages[0].getOrDefault("means"), alone.getOrDefault("means"))
        assert np.allclose(model.stages[0].getOrDefault("deviations"), alone.getOrDefault("deviations"))
        counts = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
        weight = F.when(F.col("y") == 1, end / (2.0 * counts[1])).otherwise(end / (2.0 * counts[0]))
        single = NewtonLogisticRegression(weightCol="w").fit(alone.transform(train).withColumn("w", weight))
        assert np.allclose(model.stages[1].getOrDefault("coefficients"), single.getOrDefault("coefficients"), atol=1e-8)
        rows = gradient(train, model).collect()
        assert [r["term"] for r in rows] == ["intercept", *COLUMNS] and {r["n_train"] for r in rows} == {end}
        assert max(abs(r["gradient"]) for r in rows) < 1e-8


def test_one_class_and_an_empty_segment(spark):
    table = _rows(spark, 50).withColumn("y", F.when(F.col("chrono_idx") < 10, 1).otherwise(F.col("y")))
    first, second, whole = prefixes(table, COLUMNS, [10, 10, 500])
    assert first.counts == second.counts == {1: 10} and whole.n == 50
    model = fit_prefixes(table, COLUMNS, [10, 500])[0]
    assert {r["prediction"] for r in model.transform(table).collect()} == {1.0}
    with pytest.raises(ValueError):
        NewtonLogisticRegression().fit(FeatureScaler(inputCols=COLUMNS).fit(table).transform(table).filter("y > 5"))
