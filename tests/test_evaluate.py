import pytest
from pyspark.sql import functions as F

from aerostrata.operators import evaluate, folds, prep
from aerostrata.sources import sinks


def _from_matrix(spark, model, tn, fp, fn, tp):
    rows = [(0, 0)] * tn + [(0, 1)] * fp + [(1, 0)] * fn + [(1, 1)] * tp
    return spark.createDataFrame([(model, y, p) for y, p in rows], "model string, y int, pred int")


# Published confusion counts and their metrics.
@pytest.mark.parametrize("matrix, want", [
    ((209, 129, 9, 317), (0.7922, 0.7108, 0.9724, 0.8212)),
    ((338, 0, 13, 313), (0.9804, 1.0, 0.9601, 0.9797)),
    ((338, 0, 0, 326), (1.0, 1.0, 1.0, 1.0)),
    ((5, 0, 0, 0), (1.0, 0.0, 0.0, 0.0)),
])
def test_classification_report(spark, matrix, want):
    row = evaluate.classification_report(_from_matrix(spark, "m", *matrix), ["model"]).first()
    assert [round(row[m], 4) for m in evaluate.METRICS] == list(want)
    tn, fp, fn, tp = matrix
    assert row["confusion_matrix"] == [[tn, fp], [fn, tp]]
    assert (row["n_positive"], row["n_negative"]) == (tp + fn, tn + fp)


# Published detector reports.
@pytest.mark.parametrize("flagged, hits, true, want", [
    (131, 51, 55, (0.3893, 0.9273, 0.5484)), (170, 55, 55, (0.3235, 1.0, 0.4889)),
    (186, 59, 66, (0.3172, 0.8939, 0.4683)),
])
def test_anomaly_report(spark, flagged, hits, true, want):
    df = _from_matrix(spark, "m", 3319 - flagged - true + hits, flagged - hits, true - hits, hits)
    signed = df.withColumn("pred", F.when(F.col("pred") == 1, -1).otherwise(1))
    row = evaluate.anomaly_report(signed, ["model"]).first()
    assert (row["n_anomalies_detected"], row["n_true_anomalies"], row["n_samples"]) == (flagged, true, 3319)
    assert tuple(round(row[m], 4) for m in ("precision", "recall", "f1")) == want
    bare = evaluate.anomaly_report(signed, ["model"], truth=None)
    assert bare.columns == ["model", "n_samples", "n_anomalies_detected"]


# Published McNemar results.
@pytest.mark.parametrize("b, c, statistic, p", [
    (138, 0, 136.00725, 0.0), (13, 0, 11.07692, 0.000874087), (13, 138, 101.82781, 0.0), (0, 0, 0.0, 1.0),
])
def test_mcnemar(spark, b, c, statistic, p):
    rows = []
    for i in range(b + c + 4):
        first = i >= c  # the first model is wrong on c samples, the second on b others
        second = not c <= i < b + c
        rows += [("one", i, 1, int(first)), ("two", i, 1, int(second))]
    df = spark.createDataFrame(rows, "model string, chrono_idx int, y int, pred int")
    row = evaluate.mcnemar(df, ["one", "two"]).first()
    assert (row["model1"], row["model2"], row["b"], row["c"]) == ("one", "two", b, c)
    assert round(row["statistic"], 5) == statistic
    assert row["p_value"] == pytest.approx(p, abs=1e-9)
    assert row["significant"] == (p < 0.05)


def test_cv_summary_uses_population_deviation(spark):
    reports = spark.createDataFrame([("m", 0.5, 1.0), ("m", 1.0, 1.0)], "model string, f1 double, recall double")
    row = evaluate.cv_summary(reports).first()
    assert (row["n_folds"], row["f1_mean"], row["f1_std"], row["recall_std"]) == (2, 0.75, 0.25, 0.0)
    assert "accuracy_mean" not in row.asDict()


def test_fold_bounds():
    bounds = folds.fold_bounds(2655)
    assert bounds[0] == (0, 445, 887) and bounds[-1] == (4, 2213, 2655)
    assert all(b[1] == a[2] for a, b in zip(bounds, bounds[1:]))
    assert int(3319 * 0.8) == 2655
    with pytest.raises(ValueError):
        folds.fold_bounds(5)


@pytest.mark.parametrize("known", [True, False])
def test_folds_never_look_ahead(spark, known):
    n = 47
    idx = spark.range(n).select(F.col("id").alias("chrono_idx"))
    rows = folds.time_series_folds(idx, n=n if known else None).collect()
    for fold, first, end in folds.fold_bounds(n):
        train = sorted(r["chrono_idx"] for r in rows if r["fold"] == fold and r["role"] == "train")
        held = sorted(r["chrono_idx"] for r in rows if r["fold"] == fold and r["role"] == "validate")
        assert train == list(range(first)) and held == list(range(first, end))
    split = folds.temporal_split(idx, n=n if known else None).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"train": 37, "test": 10}


def test_imputation_and_scaling(spark):
    df = spark.createDataFrame(
        [(1.0, 5.0, None), (2.0, 5.0, None), (None, 5.0, None), (3.0, 5.0, None)], "a double, b double, c double")
    means = prep.column_means(df, ["a", "b", "c"])
    assert tuple(means.first()) == (2.0, 5.0, 0.0)
    filled = prep.impute(df, ["a", "b", "c"], means)
    apart = prep.scale(filled, ["a", "b", "c"], prep.scaling(filled, ["a", "b", "c"])).collect()
    at_once = prep.standardize(df, ["a", "b", "c"], prep.fit_standardizer(df, ["a", "b", "c"])).collect()
    for x, y in zip(apart, at_once):
        assert tuple(x) == pytest.approx(tuple(y))
    assert apart[0]["a"] == pytest.approx(-1 / 0.5**0.5) and apart[0]["b"] == 0.0  # population deviation


def test_reports_are_written(spark, tmp_path):
    one = evaluate.classification_report(_from_matrix(spark, "m", 1, 2, 3, 4), ["model"])
    two = spark.createDataFrame([("x", 0.5)], "model string, extra double")
    both = sinks.union_reports([one, two])
    assert both.columns == [*one.columns, "extra"]
    js, cs = sinks.save_report(both, str(tmp_path), "r")
    back = {r["model"]: r for r in spark.read.json(js).collect()}
    assert back["m"]["confusion_matrix"] == [[1, 2], [3, 4]] and back["x"]["extra"] == 0.5
    flat = {r["model"]: r for r in spark.read.csv(cs, header=True, escape='"').collect()}
    assert flat["m"]["confusion_matrix"] == "[[1,2],[3,4]]" and flat["m"]["extra"] is None
