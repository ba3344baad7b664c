"""Isolation forest (Liu, Ting, Zhou 2008): random trees over small samples.

Every choice follows a keyed hash, so a forest can be rebuilt elsewhere, in SQL for example:

* A row's place in a tree's lottery is (a * m + b) mod (2^31 - 1), m = 1 + (7919 tree + 104729 seed) mod
  (2^31 - 2); a and b are the first and the second eight hex digits of md5("id|seed"), mod 2^31. The
  smallest places are the sample; equal ones follow the id.
* Nodes are numbered as in a heap: 1 is the root, 2i and 2i + 1 are the children of i. Node i splits by the
  eight hex digits u and w of md5("seed|tree|i"): on the (u mod k)-th of its k features that vary, at
  low + w / 2^32 (high - low); what is at most that goes left.
"""

from __future__ import annotations

import hashlib
import json
import math

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

_PRIME = (1 << 31) - 1
_TREE = "tree int, number array<bigint>, size array<int>, feature array<int>, cut array<double>, left array<int>, right array<int>, length array<double>"


def expected_length(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def grow_tree(points: np.ndarray, seed: int, tree: int, limit: int) -> dict[str, list]:
    """One tree as parallel node lists; leaves have feature -1 and their path length."""
    nodes: dict[str, list] = {k: [] for k in ("number", "size", "feature", "cut", "left", "right", "length")}

    def add(number: int, size: int) -> int:
        for key, value in (("number", number), ("size", size), ("feature", -1), ("cut", 0.0), ("left", -1), ("right", -1), ("length", 0.0)):
            nodes[key].append(value)
        return len(nodes["feature"]) - 1

    todo = [(add(1, len(points)), np.arange(len(points)), 0)]
    while todo:
        node, rows, depth = todo.pop()
        low, high = points[rows].min(axis=0), points[rows].max(axis=0)
        varying = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(varying) == 0:
            nodes["length"][node] = depth + expected_length(len(rows))
            continue
        number = nodes["number"][node]
        digest = hashlib.md5(f"{seed}|{tree}|{number}".encode()).hexdigest()
        f = int(varying[int(digest[:8], 16) % len(varying)])
        cut = float(low[f] + int(digest[8:16], 16) / 2.0**32 * (high[f] - low[f]))
        goes_left = points[rows, f] <= cut
        nodes["feature"][node], nodes["cut"][node] = f, cut
        for side, number, part in (("left", 2 * number, rows[goes_left]), ("right", 2 * number + 1, rows[~goes_left])):
            nodes[side][node] = add(number, len(part))
            todo.append((nodes[side][node], part, depth + 1))
    return nodes


class _ForestParams(HasFeaturesCol, HasPredictionCol, HasSeed):
    idCol = Param(Params._dummy(), "idCol", "row id that drives the sampling", TypeConverters.toString)
    numTrees = Param(Params._dummy(), "numTrees", "number of trees", TypeConverters.toInt)
    sampleSize = Param(Params._dummy(), "sampleSize", "rows per tree", TypeConverters.toInt)
    scoreCol = Param(Params._dummy(), "scoreCol", "decision value, negative for anomalies",
                     TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(
            featuresCol="features", predictionCol="prediction", seed=42, idCol="batch_id",
            numTrees=50, sampleSize=256, scoreCol="score",
        )


class IsolationForest(Estimator, _ForestParams, DefaultParamsReadable, DefaultParamsWritable):
    """Each tree sees `sampleSize` rows drawn without replacement by a keyed hash of the row id."""

    @keyword_only
    def __init__(self, *, idCol="batch_id", numTrees=50, sampleSize=256, seed=42):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "IsolationForestModel":
        trees, size, seed = (self.getOrDefault(p) for p in ("numTrees", "sampleSize", "seed"))
        rows = dataset.select(
            F.col(self.getOrDefault("idCol")).alias("_id"),
            vector_to_array(self.getFeaturesCol()).alias("_x"),
        )
        n = rows.count()
        if n == 0:
            raise ValueError("no rows to fit")
        # A row is a candidate for a tree when its hash is small: half as many again as needed,
        # so a shortfall is out of reach. The smallest hashes among them are the sample.
        share = min(1.0, 1.5 * size / n)
        digest = F.md5(F.concat_ws("|", F.col("_id").cast("string"), F.lit(str(seed))).cast("binary"))
        a, b = (F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint") % (1 << 31) for at in (1, 9))
        rows = rows.withColumns({"_a": a, "_b": b})
        hashed = F.transform(
            F.sequence(F.lit(0), F.lit(trees - 1)),
            lambda t: F.struct(
                t.alias("tree"),
                ((F.col("_a") * (1 + (7919 * t.cast("bigint") + 104729 * seed) % (_PRIME - 1)) + F.col("_b")) % _PRIME).alias("h"),
            ),
        )
        limit = int(share * _PRIME)
        drawn = rows.withColumn("_draws", F.filter(hashed, lambda d: d["h"] <= F.lit(limit)))
        candidates = drawn.filter(F.size("_draws") > 0).select("_id", "_x", F.inline("_draws"))
        first = Window.partitionBy("tree").orderBy("h", "_id")
        sample = (
            candidates.withColumn("_nth", F.row_number().over(first))
            .filter(F.col("_nth") <= size)
            .select("tree", "_nth", "_x")
        )

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            tree = int(pdf["tree"].iloc[0])
            points = np.stack(pdf.sort_values("_nth")["_x"].to_numpy())
            limit_depth = math.ceil(math.log2(max(len(points), 2)))
            nodes = grow_tree(points, seed, tree, limit_depth)
            return pd.DataFrame([{"tree": tree, **nodes}])

        # Every group is one tree's sample: at most `sampleSize` rows. The forest itself, at most
        # trees x 2 x sampleSize nodes, is the model and comes to the driver.
        grown = sample.groupBy("tree").applyInPandas(build, _TREE).orderBy("tree").collect()
        model = IsolationForestModel()
        self._copyValues(model)
        forest = [{k: v for k, v in r.asDict().items() if k != "tree"} for r in grown]
        model._set(forest=json.dumps(forest), sampleSize=min(size, n))
        return model


class IsolationForestModel(Model, _ForestParams, DefaultParamsReadable, DefaultParamsWritable):
    """score = 0.5 - 2^(-E[path] / c(sample)); below zero is an anomaly (-1)."""

    forest = Param(Params._dummy(), "forest", "trees as JSON node lists", TypeConverters.toString)

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The forest as a table: tree, number (as in a heap), size, feature (-1: a leaf), cut, length."""
        rows = [
            (t, *values) for t, tree in enumerate(json.loads(self.getOrDefault("forest")))
            for values in zip(*(tree[k] for k in ("number", "size", "feature", "cut", "length")))
        ]
        return spark.createDataFrame(rows, "tree int, number bigint, size int, feature int, cut double, length double")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        forest = [
            {k: np.asarray(v) for k, v in tree.items()}
            for tree in json.loads(self.getOrDefault("forest"))
        ]
        norm = max(expected_length(self.getOrDefault("sampleSize")), 1e-12)

        @F.pandas_udf("double")
        def decision(x: pd.Series) -> pd.Series:
            if len(x) == 0:
                return pd.Series([], dtype="float64")
            points = np.stack(x.to_numpy())
            total = np.zeros(len(points))
            for tree in forest:
                at = np.zeros(len(points), dtype=np.int64)
                moving = np.flatnonzero(tree["feature"][at] >= 0)
                while len(moving):
                    node = at[moving]
                    left = points[moving, tree["feature"][node]] <= tree["cut"][node]
                    at[moving] = np.where(left, tree["left"][node], tree["right"][node])
                    moving = moving[tree["feature"][at[moving]] >= 0]
                total += tree["length"][at]
            return pd.Series(0.5 - 2.0 ** (-(total / len(forest)) / norm))

        score = self.getOrDefault("scoreCol")
        return dataset.withColumn(score, decision(vector_to_array(self.getFeaturesCol()))).withColumn(
            self.getPredictionCol(), F.when(F.col(score) < 0, -1).otherwise(1)
        )
