import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from aerostrata.models import FeatureScaler, IsolationForest, LocalOutlierFactor, OneClassSvm
from aerostrata.models.lof import _distinct
from aerostrata.models.neighbors import build_index, knn_join
from aerostrata.plans.catalog import FEATURES, feature_table
from aerostrata.models.registry import ModelRegistry
from aerostrata.models.supervised import balanced_weight, class_counts, fit_classifiers
from aerostrata.plans.scoring import latest_models, score_features
from aerostrata.plans.study import anomaly_study, classification_study
from aerostrata.schema import feature_names
from aerostrata.session import scratch_dir


def _points(seed=0, n=150, d=6):
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.normal(0, 1, (n - 10, d)), rng.normal(6, 0.2, (10, d))])
    x[5] = x[6] = x[7]  # three copies
    x[20:40] = x[20]  # a mass of copies
    return x


def _vectors(spark, x):
    return spark.createDataFrame([(f"b{i:04d}", Vectors.dense(v)) for i, v in enumerate(x)],
                                 ["batch_id", "features"])


def _brute_lof(train, queries, k, own):
    """All-pairs factor. `own[i]` is the training row that query i is, or None to keep it."""
    def near(points, skip):
        dist = np.sqrt(((points[:, None] - train[None]) ** 2).sum(-1))
        for i, j in enumerate(skip):
            if j is not None:
                dist[i, j] = np.inf
        order = np.argsort(dist, axis=1, kind="stable")[:, :k]
        return order, np.take_along_axis(dist, order, 1)

    idx, dist = near(train, list(range(len(train))))
    kdist = dist[:, -1]
    lrd = 1.0 / (np.maximum(dist, kdist[idx]).mean(1) + 1e-10)
    qi, qd = near(queries, own)
    return lrd[qi].mean(1) * (np.maximum(qd, kdist[qi]).mean(1) + 1e-10)


@pytest.mark.parametrize("block", [15, 40, 1000])
def test_neighbours_equal_brute_force(spark, block):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (120, 4))
    q = rng.normal(0.5, 2, (30, 4))
    points = spark.createDataFrame([(f"p{i}", [float(a) for a in v], 1) for i, v in enumerate(x)],
                                   "vid string, v array<double>, m bigint")
    asked = spark.createDataFrame([(f"q{i}", [float(a) for a in v]) for i, v in enumerate(q)],
                                  "vid string, v array<double>")
    index = build_index(points, scratch_dir(spark, "index"), block)
    if block < 120:
        sizes = [r["count"] for r in index.points.groupBy("leaf").count().collect()]
        assert len(sizes) > 120 // block - 1 and max(sizes) <= 2 * block
    got = {}
    for r in knn_join(asked, index, 5, visit_rows=7).collect():
        got.setdefault(r["vid"], []).append((r["d"], r["o"]))
    dist = np.sqrt(((q[:, None] - x[None]) ** 2).sum(-1))
    for i in range(len(q)):
        best = np.argsort(dist[i])[:5]
        assert [o for _, o in sorted(got[f"q{i}"])] == [f"p{j}" for j in best]
        assert np.allclose([d for d, _ in sorted(got[f"q{i}"])], dist[i, best])


def test_a_search_shuffles_vectors_once(spark):
    """However many leaves are visited: one grouping of the queries, and copies and ties stay exact."""
    rng = np.random.default_rng(8)
    x = np.unique(np.vstack([rng.integers(0, 3, (150, 4)) * 1.0, rng.normal(1e4, 1e-3, (40, 4)), np.zeros((1, 4))]), axis=0)
    names = [f"p{i:03d}" for i in range(len(x))]
    points = spark.createDataFrame([(n, [float(a) for a in v], 1) for n, v in zip(names, x)],
                                   "vid string, v array<double>, m bigint")
    index = build_index(points, scratch_dir(spark, "index"), 20)
    found = knn_join(index.points, index, 5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1 and "CoGroups" not in plan and "Window" not in plan
    got = {}
    for r in found.collect():
        got.setdefault(r["vid"], []).append((r["d"], r["o"]))
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for i, name in enumerate(names):
        want = sorted((d, o) for d, o in zip(dist[i], names) if o != name)[:5]
        assert [o for _, o in sorted(got[name])] == [o for _, o in want]
        assert np.allclose([d for d, _ in sorted(got[name])], [d for d, _ in want], rtol=1e-12, atol=0)


def test_visits_grow_slower_than_the_leaves(spark):
    """Ten times the batches: more leaves, and each query visits a smaller share of them."""
    share, visits = [], []
    for sf in ("sf0.01", "sf0.1"):
        table = feature_table(spark, f"/root/testdata/{sf}")
        scaled = FeatureScaler(inputCols=FEATURES).fit(table).transform(table)
        keyed = LocalOutlierFactor()._keyed(scaled)
        index = build_index(_distinct(keyed), scratch_dir(spark, "tree"), block_rows=150)
        found: dict[str, int] = {}
        rows = knn_join(index.points, index, 5, stats=found)
        n = index.points.count()
        assert rows.count() == 5 * n
        visits.append(found["visits"] / n)
        share.append(found["visits"] / n / found["leaves"])
        assert index.points.groupBy("leaf").count().agg(F.max("count")).first()[0] <= 2 * 150
    assert share[1] < 0.7 * share[0], (visits, share)


@pytest.mark.parametrize("block", [25, 2000])
def test_lof_equals_brute_force(spark, block):
    x = _points()
    df = _vectors(spark, x)
    model = LocalOutlierFactor(blockRows=block).fit(df)
    rows = model.transform(df).orderBy("batch_id").collect()
    got = np.array([r["lof"] for r in rows])
    # Copies tie, and which of several copies counts is open; their factors agree all the same.
    want = _brute_lof(x, x, 5, list(range(len(x))))
    assert np.allclose(got, want, rtol=1e-6)
    assert [r["prediction"] for r in rows] == [-1 if w > 1.5 else 1 for w in got]
    new = np.array([[9.0] * 6, [0.0] * 6])
    far, near = model.transform(_vectors(spark, new)).orderBy("batch_id").collect()
    assert np.allclose([far["lof"], near["lof"]], _brute_lof(x, new, 5, [None, None]), rtol=1e-6)
    assert far["prediction"] == -1 and near["prediction"] == 1
    novelty = model.copy({model.excludeSelf: False}).transform(df).orderBy("batch_id").collect()
    assert np.allclose([r["lof"] for r in novelty], _brute_lof(x, x, 5, [None] * len(x)), rtol=1e-6)


def test_forest_and_svm_find_planted_points(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 1, (600, 5)), rng.normal(0, 1, (6, 5)) + 12])
    df = _vectors(spark, x)
    for estimator in (IsolationForest(), OneClassSvm()):
        rows = estimator.fit(df).transform(df).orderBy("batch_id").collect()
        assert all(r["prediction"] == -1 for r in rows[600:])
        scores = np.array([r["score"] for r in rows])
        assert np.median(scores[600:]) < np.quantile(scores[:600], 0.02)
        assert all((r["score"] < 0) == (r["prediction"] == -1) for r in rows)
    flagged = np.mean(scores < 0)
    assert 0.02 < flagged < 0.09  # nu = 0.05
    again = IsolationForest().fit(df.repartition(5)).transform(df).orderBy("batch_id").collect()
    first = IsolationForest().fit(df).transform(df).orderBy("batch_id").collect()
    assert [r["score"] for r in again] == [r["score"] for r in first]  # independent of the layout


def test_scaler(spark):
    df = spark.createDataFrame([(1.0, 4.0, None), (3.0, 4.0, None), (None, 4.0, None)], "a double, b double, c double")
    model = FeatureScaler(inputCols=["a", "b", "c"]).fit(df)
    rows = [list(r["features"]) for r in model.transform(df).collect()]
    sd = (2 / 3) ** 0.5  # the filled column is 1, 3, 2
    assert np.allclose(rows, [[-1 / sd, 0, 0], [1 / sd, 0, 0], [0, 0, 0]])
    other = spark.createDataFrame([(None, 6.0, 2.0)], "a double, b double, c double")
    assert list(model.transform(other).first()["features"]) == pytest.approx([0.0, 2.0, 2.0])
    zero = model.with_missing("zero").transform(other).first()["features"]
    assert list(zero) == pytest.approx([-2 / sd, 2.0, 2.0])


def _features(spark, n=60, positives=True):
    rng = np.random.default_rng(5)
    names = feature_names()
    rows = []
    for i in range(n):
        v = rng.uniform(0, 1, len(names))
        by = dict(zip(names, (float(a) for a in v)))
        by["scd_temp_c_min"], by["scd_humidity_pct_min"] = 21.0, 40.0
        if positives and i % 3 == 0:
            by["co2_ppm_max"] = 1500.0
        rows.append((f"b{i:03d}", *[by[c] for c in names]))
    df = spark.createDataFrame(rows, "batch_id string, " + ", ".join(f"{c} double" for c in names))
    return df.withColumn("batch_ts", F.timestamp_seconds(F.substring("batch_id", 2, 3).cast("int") * 60))


def test_weights_and_classifiers(spark):
    df = _features(spark).withColumn("y", (F.col("co2_ppm_max") > 1000).cast("int"))
    counts = class_counts(df)
    assert counts == {1: 20, 0: 40}
    weights = {r["y"]: r["w"] for r in df.select("y", balanced_weight(counts).alias("w")).distinct().collect()}
    assert weights == {1: 1.5, 0: 0.75}
    models = fit_classifiers(df, feature_names(), ["decision_tree"])
    scored = models["decision_tree"].transform(df)
    assert scored.filter("y = prediction").count() == 60


def test_studies(spark, tmp_path):
    registry = ModelRegistry(spark, str(tmp_path / "models"))
    study = classification_study(_features(spark), names=["decision_tree", "logistic_regression"],
                                 n_folds=2, impute_fit="all", registry=registry)
    final = {r["model"]: r for r in study.reports["final"].collect()}
    assert final["threshold_baseline"]["f1"] == 1.0 and final["decision_tree"]["f1"] == 1.0
    assert final["decision_tree"]["n_samples"] == 12 and final["decision_tree"]["split"] == "temporal_80_20"
    cv = {r["model"]: r for r in study.reports["cv"].collect()}
    assert cv["threshold_baseline"]["f1_mean"] == 1.0 and cv["logistic_regression"]["n_folds"] == 2
    pairs = [(r["model1"], r["model2"]) for r in study.reports["mcnemar"].collect()]
    assert pairs[0] == ("threshold_baseline", "decision_tree") and len(pairs) == 3
    for few in (6, 4):
        with pytest.raises(ValueError):
            (classification_study if few == 6 else anomaly_study)(_features(spark, few))
    with pytest.warns(UserWarning, match="one class"):
        classification_study(_features(spark, 30, positives=False), names=["decision_tree"], n_folds=2)

    found = anomaly_study(_features(spark), names=["isolation_forest"], registry=registry)
    rule = {r["model"]: r for r in found.reports["rule"].collect()}
    assert rule["rule_based_baseline"]["n_anomalies_detected"] == rule["rule_based_baseline"]["n_true_anomalies"]
    assert found.reports["synthetic"].first()["n_true_anomalies"] == 1

    names = [r["model_name"] for r in registry.list_models().collect()]
    assert names == ["decision_tree", "isolation_forest", "logistic_regression"]
    models = latest_models(registry)  # models nobody trained are skipped
    assert set(models) == {"logistic_regression", "decision_tree", "isolation_forest"}
    scored = score_features(_features(spark), models)
    assert scored.count() == 180
    assert {r[0] for r in scored.select("prediction_label").distinct().collect()} <= {
        "health_risk", "no_risk", "anomaly", "normal"}
    assert set(latest_models(registry, "anomaly")) == {"isolation_forest"}


def test_registry_uses_the_exact_name(spark, tmp_path):
    registry = ModelRegistry(spark, str(tmp_path / "models"))
    with pytest.raises(FileNotFoundError):
        registry.load_latest("m")
    df = spark.createDataFrame([(1.0,), (2.0,)], "a double")
    for name, missing in (("m", "mean"), ("m", "zero"), ("m_scaler", "mean")):
        registry.save(PipelineModel([FeatureScaler(inputCols=["a"], missing=missing).fit(df)]), name, {"n": missing})
    model, meta = registry.load_latest("m")
    assert meta["model_name"] == "m" and meta["n"] == "zero"
    assert model.stages[0].getOrDefault("missing") == "zero"
    with pytest.raises(ValueError):
        latest_models(registry)


def test_classifiers_do_not_depend_on_the_layout(spark):
    from aerostrata.models.supervised import CLASSIFIERS, fit_classifiers

    rows = spark.range(400).selectExpr(
        "concat('b', id) AS batch_id", "CAST(id % 17 AS DOUBLE) AS a", "CAST((id * 7) % 23 AS DOUBLE) AS b",
        "CAST((id * 13) % 11 > 4 AS INT) AS y")
    scores = []
    for parts in (1, 5):
        models = fit_classifiers(rows.repartition(parts), ["a", "b"])
        scores.append({
            name: {r["batch_id"]: r["probability"][1] for r in models[name].transform(rows).collect()} for name in CLASSIFIERS
        })
    for name in ("decision_tree", "random_forest"):
        assert scores[0][name] == scores[1][name]
    for k, v in scores[0]["logistic_regression"].items():
        assert abs(v - scores[1]["logistic_regression"][k]) < 1e-6


def test_latest_entry_is_one_entry(spark):
    from aerostrata.models.registry import latest_by_name

    entries = spark.sql("SELECT 'm' model_name, TIMESTAMP'2024-01-01' saved_at, p path, x metadata FROM VALUES ('a', 'z'), ('b', 'y') AS t(p, x)")
    row = latest_by_name(entries).first()
    assert (row["path"], row["metadata"]) == ("b", "y")
