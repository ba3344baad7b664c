from pyspark.sql import functions as F

from aerostrata.operators.features import rolling_features


def test_rolling_features_use_several_tasks(spark):
    """A series of 60,000 batches is cut into slices enough for a cluster, and the means stay exact."""
    rows = spark.range(60_000).select(
        F.concat(F.lit("b"), "id").alias("batch_id"), F.timestamp_seconds(F.col("id") * 60).alias("batch_ts"),
        F.col("id").cast("double").alias("co2_ppm_mean"),
    )
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(merge)
    spark.conf.set(merge, "false")
    try:
        rolled = rolling_features(rows, fields=["co2_ppm_mean"]).withColumn("p", F.spark_partition_id())
        found = rolled.agg(
            F.countDistinct("p").alias("tasks"), F.count(F.lit(1)).alias("n"),
            F.sum(F.expr("int(co2_ppm_mean_roll3 <> greatest(co2_ppm_mean - 1, co2_ppm_mean / 2))")).alias("wrong"),
        ).first()
    finally:
        spark.conf.set(merge, before)
    assert found.n == 60_000 and found.wrong == 0
    assert found.tasks > 1
