"""Counts of distinct values and quantiles that are kept up to date: a sketch per day, written once, merged.

A day's sketches are a few kilobytes whatever the day holds. A new day is sketched alone; any span of
days is a merge of its sketches, without the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from aerostrata.functions.scalar import as_instant

HLL_BITS = 12     # registers: 2^12; relative deviation about 1.04 / sqrt(2^12) = 1.6 %
KLL_K = 800       # rank error below 0.7 % at 99 %
HLL_ERROR = 0.05  # stated bounds: three deviations of the counts
KLL_ERROR = 0.01  # and of the ranks


def daily_sketches(rows: DataFrame, distinct: list[str], values: list[str], time: str = "ts") -> DataFrame:
    """One row per day: n_rows, a distinct-count sketch per column of `distinct`, quantile ones per `values`."""
    return rows.groupBy(F.to_date(as_instant(time)).alias("day")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.hll_sketch_agg(F.col(c), F.lit(HLL_BITS)).alias(f"hll_{c}") for c in distinct],
        *[F.expr(f"kll_sketch_agg_double(CAST(`{c}` AS DOUBLE), {KLL_K})").alias(f"kll_{c}") for c in values],
    )


def merged(days: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sketches of all days, or of each group of `by`; the same columns, without the rows."""
    hll = [c for c in days.columns if c.startswith("hll_")]
    kll = [c for c in days.columns if c.startswith("kll_")]
    return days.groupBy(*(by or [])).agg(
        F.sum("n_rows").alias("n_rows"),
        *[F.hll_union_agg(c).alias(c) for c in hll],
        *[F.expr(f"kll_merge_agg_double({c})").alias(c) for c in kll],
    )


def estimates(sketches: DataFrame, quantiles: list[float]) -> DataFrame:
    """`distinct_<column>` and `q<percent>_<column>` of every row of sketches."""
    out = [c for c in sketches.columns if not c.startswith(("hll_", "kll_"))]
    named = [F.hll_sketch_estimate(c).alias(f"distinct_{c[4:]}") for c in sketches.columns if c.startswith("hll_")]
    for c in sketches.columns:
        if c.startswith("kll_"):
            named += [F.expr(f"kll_sketch_get_quantile_double({c}, {q!r}D)").alias(f"q{round(q * 100)}_{c[4:]}") for q in quantiles]
    return sketches.select(*out, *named)
