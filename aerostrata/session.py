"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime settings every query relies on.
#  * UTC: observation times are instants, hours and weekdays are UTC ones.
#  * codegen.maxFields: the batch feature aggregate has 60-90 output columns; above the
#    default of 100 fields (inputs included) Spark drops whole-stage code generation.
_RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.codegen.maxFields": "400",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Settings that only a new session can take: call sites recorded for every column expression make
# wide plans slow to build.
_AT_START = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session (cluster sizing stays as given)."""
    for key, value in _RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(
    master: str = "local[*]", app: str = "aerostrata", extra: dict[str, str] | None = None
) -> SparkSession:
    """Start a session for local use; on a cluster pass your own session to `configure`."""
    builder = SparkSession.builder.master(master).appName(app).config("spark.ui.enabled", "false")
    for key, value in {**_RUNTIME, **_AT_START, **(extra or {})}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in `spark.checkpoint.dir`.

    Only a local session may go without one; it gets a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="aerostrata-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path for written intermediate tables below the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(spark: SparkSession, df, name: str):
    """Write `df` to the shared folder and read it back, so lost executors cost no lineage."""
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables of the shared folder that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def compact(df, rows: int, rows_per_task: int = 50_000):
    """Fewer partitions for an iterative job over few rows; large inputs keep theirs.

    Each pass of such a job pays a fixed cost per partition, so a partition must be worth it.
    """
    return df.coalesce(max(1, -(-rows // rows_per_task)))


def settled(df, rows: int, key: str, rows_per_task: int = 50_000):
    """A layout that depends on the rows alone: partitions by hash of a unique `key`, sorted by it.

    For learners that draw by partition, so that the cluster's and the input's layout do not matter.
    """
    parts = max(1, -(-rows // rows_per_task))
    return df.repartition(parts, key).sortWithinPartitions(key)
