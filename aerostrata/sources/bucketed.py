"""A store of batches in buckets of their id, so that appends check for repeats without shuffling it.

New rows are shuffled to the store's buckets and merged with it bucket by bucket; the stored side is
read where it lies, and of it only the id column. Batch ids are spread evenly, so buckets are, too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


class BucketedStore:
    """The catalog table `name`, bucketed and sorted by `key`; an external one if `path` is given."""

    def __init__(self, spark: SparkSession, name: str, buckets: int, path: str | None = None, key: str = "batch_id"):
        self.spark, self.name, self.buckets, self.path, self.key = spark, name, buckets, path, key

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def new_only(self, rows: DataFrame) -> DataFrame:
        """The rows of batches that are not stored yet; rows without a batch id stay."""
        if not self.spark.catalog.tableExists(self.name):
            return rows
        dealt = rows.repartition(self.buckets, F.col(self.key))
        return dealt.join(self.table().select(self.key).hint("merge"), self.key, "left_anti")

    def append(self, rows: DataFrame) -> None:
        """Add the rows of batches that are new. Rows of one batch must come in one append."""
        # One file per bucket and append, not one per task and bucket.
        fresh = self.new_only(rows).repartition(self.buckets, F.col(self.key))
        writer = fresh.write.bucketBy(self.buckets, self.key).sortBy(self.key).mode("append").format("parquet")
        if self.path:
            writer = writer.option("path", self.path)
        writer.saveAsTable(self.name)
