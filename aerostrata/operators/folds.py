"""Chronological index, hold-out split and expanding time-series folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from aerostrata.operators.ordering import add_position
from aerostrata.schema import CV_FOLDS


def chrono_index(batches: DataFrame, time: str = "batch_ts", out: str = "chrono_idx") -> DataFrame:
    """0-based position of each batch in time; batches without a time come last.

    Ties follow the batch id through its hash, which lets a large tie be cut into parts.
    """
    return add_position(
        batches, time=time, tie=F.xxhash64("batch_id"), last_tie=["batch_id"], out=out
    )


def temporal_split(
    indexed: DataFrame, train_share: float = 0.8, idx: str = "chrono_idx", n: int | None = None
) -> DataFrame:
    """Add `split`: the first int(share * n) batches train, the rest test.

    Pass `n` when the number of batches is known; otherwise a one-row count joins in.
    """
    test = F.col(idx) >= F.floor(F.col("_total") * F.lit(train_share))
    return (
        _with_total(indexed, n)
        .withColumn("split", F.when(test, "test").otherwise("train"))
        .drop("_total")
    )


def _with_total(indexed: DataFrame, n: int | None) -> DataFrame:
    if n is not None:
        return indexed.withColumn("_total", F.lit(n).cast("bigint"))
    return indexed.join(F.broadcast(indexed.agg(F.count(F.lit(1)).alias("_total"))))


def fold_bounds(n: int, folds: int = CV_FOLDS) -> list[tuple[int, int, int]]:
    """(fold, first, end) of each validation range; training is everything before `first`."""
    size = n // (folds + 1)
    if size == 0:
        raise ValueError(f"{n} samples are too few for {folds} folds")
    return [(i, n - (folds - i) * size, n - (folds - 1 - i) * size) for i in range(folds)]


def time_series_folds(
    indexed: DataFrame, folds: int = CV_FOLDS, idx: str = "chrono_idx", n: int | None = None
) -> DataFrame:
    """One row per batch and fold it takes part in, with its role.

    A batch validates in at most one fold and trains in all later ones: at most `folds` copies,
    made without a join.
    """
    size = F.floor(F.col("_total") / (folds + 1))
    fold = F.col("fold")
    first = F.col("_total") - (F.lit(folds) - fold) * size
    end = first + size
    role = F.when(F.col(idx) < first, "train").when(F.col(idx) < end, "validate")
    return (
        _with_total(indexed, n)
        .withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
        .withColumn("role", role)
        .filter(F.col("role").isNotNull())
        .drop("_total")
    )
