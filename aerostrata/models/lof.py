"""Local outlier factor (Breunig et al. 2000) on exact neighbours."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
    MLReadable, MLReader, MLWritable, MLWriter,
)
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from aerostrata.models.neighbors import BLOCK_ROWS, build_index, knn_join, load_index, read_points, write_points
from aerostrata.session import materialize, scratch_dir

_TABLES = ("nodes", "near", "density")  # and the points, in folders by leaf


class _LofParams(HasFeaturesCol, HasPredictionCol):
    k = Param(Params._dummy(), "k", "neighbours", TypeConverters.toInt)
    threshold = Param(Params._dummy(), "threshold", "factor above which a row is an anomaly",
                      TypeConverters.toFloat)
    excludeSelf = Param(
        Params._dummy(), "excludeSelf",
        "a row that equals a training row is that row, and not its own neighbour",
        TypeConverters.toBoolean,
    )
    blockRows = Param(Params._dummy(), "blockRows", "points per block", TypeConverters.toInt)
    factorCol = Param(Params._dummy(), "factorCol", "outlier factor", TypeConverters.toString)
    scoreCol = Param(Params._dummy(), "scoreCol", "decision value, negative for anomalies",
                     TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(
            featuresCol="features", predictionCol="prediction", k=5, threshold=1.5,
            excludeSelf=True, blockRows=BLOCK_ROWS, factorCol="lof", scoreCol="score",
        )

    def _keyed(self, dataset: DataFrame) -> DataFrame:
        """Add the vector as an array and a 128-bit key of its content: copies share a key."""
        v = F.transform(vector_to_array(self.getFeaturesCol()), lambda x: x + F.lit(0.0))
        return dataset.withColumn("_v", v).withColumn(
            "_vid",
            F.concat(F.hex(F.xxhash64("_v")), F.lit("-"), F.hex(F.xxhash64(F.lit(7), F.col("_v")))),
        )


def _distinct(keyed: DataFrame) -> DataFrame:
    """One row per vector with its number of copies, so a mass of copies is a single point."""
    return keyed.groupBy(F.col("_vid").alias("vid")).agg(
        F.first("_v").alias("v"), F.count(F.lit(1)).alias("m")
    )


def _weighted(neighbours: DataFrame, own: DataFrame, k: int) -> DataFrame:
    """Neighbours with the number of copies that count towards k, own copies first.

    `own` holds (vid, m): copies of the query itself at distance 0.
    """
    mine = own.filter(F.col("m") > 0).select("vid", F.col("vid").alias("o"), F.lit(0.0).alias("d"), "m")
    before = Window.partitionBy("vid").orderBy("d", F.col("o") != F.col("vid"), "o").rowsBetween(
        Window.unboundedPreceding, -1
    )
    taken = F.coalesce(F.sum("m").over(before), F.lit(0))
    return (
        neighbours.unionByName(mine)
        .withColumn("w", F.greatest(F.lit(0), F.least(F.col("m"), F.lit(k) - taken)))
        .filter(F.col("w") > 0)
        .select("vid", "o", "d", "w")
    )


def _local_density(weighted: DataFrame, reach_of: DataFrame) -> DataFrame:
    """1 / mean reachability distance; the small constant guards against copies."""
    reach = F.greatest(F.col("d"), F.col("kdist"))
    mean = F.sum(F.col("w") * reach) / F.sum("w")
    return (
        weighted.join(reach_of.select(F.col("vid").alias("o"), "kdist"), "o")
        .groupBy("vid")
        .agg((F.lit(1.0) / (mean + F.lit(1e-10))).alias("lrd"))
    )


class LocalOutlierFactor(Estimator, _LofParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(
        self, *, k=5, threshold=1.5, excludeSelf=True, blockRows=BLOCK_ROWS, featuresCol="features"
    ):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "LocalOutlierFactorModel":
        spark = dataset.sparkSession
        root = scratch_dir(spark, "lof")
        index = build_index(_distinct(self._keyed(dataset)), root, self.getOrDefault("blockRows"))
        total = index.points.agg(F.sum("m")).first()[0]
        k = max(1, min(self.getOrDefault("k"), total - 1))
        own = index.points.select("vid", (F.col("m") - 1).alias("m"))
        knn_join(index.points, index, k).write.parquet(f"{root}/near")
        weighted = _weighted(spark.read.parquet(f"{root}/near"), own, k)
        kdist = weighted.groupBy("vid").agg(F.max("d").alias("kdist"))
        density = index.points.select("vid", "m").join(kdist, "vid").join(
            _local_density(weighted, kdist), "vid"
        )
        density.write.parquet(f"{root}/density")
        model = LocalOutlierFactorModel()
        self._copyValues(model)
        model._set(k=k, tables=root)
        return model


class _LofWriter(MLWriter):
    def __init__(self, model: "LocalOutlierFactorModel"):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        write_points(read_points(self.sparkSession, self.model.getOrDefault("tables")), path)
        for name in _TABLES:
            self.model._table(self.sparkSession, name).write.parquet(f"{path}/{name}")


class _LofReader(MLReader):
    def load(self, path: str) -> "LocalOutlierFactorModel":
        model = DefaultParamsReader(LocalOutlierFactorModel).load(path)
        return model._set(tables=path)


class LocalOutlierFactorModel(Model, _LofParams, MLWritable, MLReadable):
    """score = threshold - factor; below zero is an anomaly (-1). The training points are tables."""

    tables = Param(Params._dummy(), "tables", "folder of the point tables", TypeConverters.toString)

    def write(self) -> MLWriter:
        return _LofWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _LofReader()

    def _table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.getOrDefault('tables')}/{name}")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        spark, k = dataset.sparkSession, self.getOrDefault("k")
        index = load_index(spark, self.getOrDefault("tables"))
        density = self._table(spark, "density")
        keyed = self._keyed(dataset)
        queries = _distinct(keyed)
        less = 1 if self.getOrDefault("excludeSelf") else 0
        own = queries.select("vid").join(density.select("vid", (F.col("m") - less).alias("m")), "vid")
        # Training vectors know their neighbours; only the others are searched for.
        queries = materialize(spark, queries, "queries")
        near = self._table(spark, "near").join(queries.select("vid"), "vid", "left_semi")
        others = queries.join(density.select("vid"), "vid", "left_anti")
        if not others.isEmpty():
            near = near.unionByName(materialize(spark, knn_join(others, index, k), "near"))
        weighted = _weighted(near, own, k)
        mine = _local_density(weighted, density)
        around = (
            weighted.join(density.select(F.col("vid").alias("o"), "lrd"), "o")
            .groupBy("vid")
            .agg((F.sum(F.col("w") * F.col("lrd")) / F.sum("w")).alias("_around"))
        )
        factor = around.join(mine, "vid").select(
            F.col("vid").alias("_vid"), (F.col("_around") / F.col("lrd")).alias("_factor")
        )
        limit = F.lit(self.getOrDefault("threshold"))
        return (
            keyed.join(factor, "_vid", "left")
            .withColumns({
                self.getOrDefault("factorCol"): F.col("_factor"),
                self.getOrDefault("scoreCol"): limit - F.col("_factor"),
                self.getPredictionCol(): F.when(F.col("_factor") > limit, -1).otherwise(1),
            })
            .drop("_vid", "_v", "_factor")
        )
