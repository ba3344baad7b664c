"""Saved models by name and time, with their metadata in a table."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from aerostrata.schema import MODEL_REGISTRY


def latest_by_name(entries: DataFrame, name: str | None = None) -> DataFrame:
    """The newest entry of every name, or of exactly one; names that merely start alike differ."""
    if name is not None:
        entries = entries.filter(F.col("model_name") == name)
    rest = [c for c in entries.columns if c not in ("model_name", "saved_at")]
    # One struct, so that all columns come from one entry even among equal times.
    latest = entries.groupBy("model_name").agg(F.max(F.struct("saved_at", *rest)).alias("_latest"))
    return latest.select("model_name", *[F.col(f"_latest.{c}").alias(c) for c in ("saved_at", *rest)])


class ModelRegistry:
    """Pipelines below `root`; the entry is written after the model, so an entry is complete."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @property
    def _table(self) -> str:
        return f"{self.root}/_entries"

    def save(self, model: PipelineModel, name: str, metadata: dict | None = None) -> str:
        at = datetime.now(timezone.utc)
        path = f"{self.root}/{name}/{at:%Y%m%dT%H%M%S%fZ}"
        model.write().save(path)
        record = {**(metadata or {}), "model_name": name, "saved_at": at.isoformat()}
        row = [(name, at, path, json.dumps(record, default=str))]
        entries = self.spark.createDataFrame(row, MODEL_REGISTRY)
        entries.coalesce(1).write.mode("append").parquet(self._table)
        return path

    def entries(self) -> DataFrame:
        """All entries; none when nothing was saved yet."""
        try:
            return self.spark.read.schema(MODEL_REGISTRY).parquet(self._table)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], MODEL_REGISTRY)

    def list_models(self) -> DataFrame:
        return self.entries().orderBy("model_name", "saved_at")

    def load_latest(self, name: str) -> tuple[PipelineModel, dict]:
        row = latest_by_name(self.entries(), name).first()
        if row is None:
            raise FileNotFoundError(f"no saved model named {name!r} below {self.root}")
        return PipelineModel.load(row["path"]), json.loads(row["metadata"])
