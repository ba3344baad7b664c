"""Rule labels and synthetic anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from aerostrata.functions.scalar import any_true
from aerostrata.schema import HEALTH_BOUNDS, RANGE_BOUNDS


def health_rule(columns: list[str], bounds: dict[str, dict[str, float]] = HEALTH_BOUNDS) -> Column:
    """1 when a batch maximum is above, or a batch minimum below, its bound (strictly)."""
    tests = []
    for field, limit in bounds.items():
        if "max" in limit and f"{field}_max" in columns:
            tests.append(F.col(f"{field}_max") > limit["max"])
        if "min" in limit and f"{field}_min" in columns:
            tests.append(F.col(f"{field}_min") < limit["min"])
    return any_true(tests).cast("int")


def range_rule(columns: list[str], bounds: dict[str, float] = RANGE_BOUNDS) -> Column:
    """1 when the swing of a signal inside the batch is above its bound (strictly)."""
    return any_true([F.col(c) > b for c, b in bounds.items() if c in columns]).cast("int")


def health_labels(features: DataFrame, bounds=HEALTH_BOUNDS, out: str = "health_risk") -> DataFrame:
    return features.withColumn(out, health_rule(features.columns, bounds))


def anomaly_labels(features: DataFrame, bounds=RANGE_BOUNDS, out: str = "anomaly") -> DataFrame:
    return features.withColumn(out, range_rule(features.columns, bounds))


def label_counts(labelled: DataFrame, *labels: str) -> DataFrame:
    """Rows per class and number of classes of each label (one class makes training trivial).

    All labels are counted in one pass; the window only sees one row per label and class.
    """
    listed = F.array(*[
        F.struct(F.lit(name).alias("task"), F.col(name).alias("label")) for name in labels
    ])
    counts = (
        labelled.select(F.inline(listed)).groupBy("task", "label").agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.withColumn("n_classes", F.count(F.lit(1)).over(Window.partitionBy("task")))


def inject_anomalies(
    features: DataFrame, fraction: float = 0.02, seed: int = 42, shift: float = 3.0
) -> DataFrame:
    """Shift one range feature of a chosen fraction of batches by `shift` standard deviations.

    max(1, int(n * fraction)) batches are chosen by the order of a keyed digest, and the digest
    also picks the column, so the choice is random in effect yet reproducible. A chosen batch is
    labelled 1 even where the column has no spread; a missing value stays missing.
    """
    columns = [c for c in features.columns if c.endswith("_range")]
    if not columns:
        raise ValueError("no _range columns to shift")
    digest = F.md5(F.concat(F.col("batch_id"), F.lit(f"|{seed}")))
    marked = features.withColumn("_digest", digest)
    pick = (F.conv(F.substring("_digest", 25, 8), 16, 10).cast("bigint") % len(columns)).cast("int")
    last = chosen_digests(marked.select("_digest"), fraction)
    spread = features.agg(*[F.stddev_samp(c).alias(f"_sd_{c}") for c in columns])
    changed = marked.join(F.broadcast(spread)).join(F.broadcast(last))
    chosen = F.col("_digest") <= F.col("_last")
    shifted = {
        c: F.when(
            chosen & (pick == i) & (F.col(f"_sd_{c}") > 0), F.col(c) + shift * F.col(f"_sd_{c}")
        ).otherwise(F.col(c))
        for i, c in enumerate(columns)
    }
    return changed.withColumns(shifted).withColumn("synthetic_anomaly", chosen.cast("int")).select(
        *features.columns, "synthetic_anomaly"
    )


_HEAD = 3      # hex digits that one round looks at: 4,096 counts at most come to the driver
_FEW = 4_096   # digests that are looked at one by one


def chosen_digests(digests: DataFrame, fraction: float) -> DataFrame:
    """One row with the k-th smallest digest `_digest`, k = max(1, int(n * fraction)); none without rows.

    Digests are counted by their next digits, and the range that holds the k-th one is narrowed until it
    holds few or a single one. No rows are ordered, however many there are or equal each other.
    """
    spark, prefix, left = digests.sparkSession, "", None
    while True:
        inside = digests.filter(F.col("_digest").startswith(prefix)) if prefix else digests
        head = F.substring("_digest", len(prefix) + 1, _HEAD)
        counts = sorted((r[0], r[1]) for r in inside.groupBy(head).agg(F.count(F.lit(1))).collect())
        if left is None:
            n = sum(c for _, c in counts)
            if not n:
                return spark.createDataFrame([], "_last string")
            left = max(1, int(n * fraction))
        for digits, count in counts:
            if left <= count:
                break
            left -= count
        prefix += digits
        if len(prefix) >= 32:
            return spark.createDataFrame([(prefix,)], "_last string")
        if count <= _FEW:
            few = sorted(r[0] for r in digests.filter(F.col("_digest").startswith(prefix)).select("_digest").collect())
            return spark.createDataFrame([(few[left - 1],)], "_last string")
