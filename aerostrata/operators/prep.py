"""Imputation and scaling as aggregates, joined back as one broadcast row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def column_means(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row of means over valid values; a column without any has mean 0."""
    return df.selectExpr(*[f"CAST(`{c}` AS DOUBLE) AS `{c}`" for c in columns]).agg(
        *[F.expr(f"coalesce(avg(`{c}`), 0D) AS `{c}`") for c in columns]
    )


def impute(df: DataFrame, columns: list[str], means: DataFrame) -> DataFrame:
    """Fill missing values from a one-row frame of means."""
    row = means.selectExpr(*[f"`{c}` AS `_m_{c}`" for c in columns])
    wanted = set(columns)
    return df.join(F.broadcast(row)).selectExpr(*[
        f"coalesce(`{c}`, `_m_{c}`) AS `{c}`" if c in wanted else f"`{c}`" for c in df.columns
    ])


def scaling(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row of means and population deviations; a constant column is divided by 1."""
    stats = df.agg(
        *[F.expr(f"avg(`{c}`) AS `_m_{c}`") for c in columns],
        *[F.expr(f"stddev_pop(`{c}`) AS `_s_{c}`") for c in columns],
    )
    return stats.selectExpr(
        *[f"`_m_{c}`" for c in columns],
        *[f"CASE WHEN `_s_{c}` > 0 THEN `_s_{c}` ELSE 1D END AS `_s_{c}`" for c in columns],
    )


def scale(df: DataFrame, columns: list[str], stats: DataFrame) -> DataFrame:
    """Standardise the columns with the one-row result of `scaling`."""
    wanted = set(columns)
    return df.join(F.broadcast(stats)).selectExpr(*[
        f"(`{c}` - `_m_{c}`) / `_s_{c}` AS `{c}`" if c in wanted else f"`{c}`" for c in df.columns
    ])


def fit_standardizer(df: DataFrame, columns: list[str]) -> DataFrame:
    """Means and population deviations of the mean-imputed columns, in a single aggregate.

    Filling with the mean leaves the mean as it is and spreads the squared deviations of the
    valid values over all rows, so no imputed copy of the data has to be scanned.
    """
    stats = df.agg(
        F.expr("count(1) AS _rows"),
        *[F.expr(f"avg(CAST(`{c}` AS DOUBLE)) AS `_a_{c}`") for c in columns],
        *[F.expr(f"var_pop(CAST(`{c}` AS DOUBLE)) * count(`{c}`) AS `_q_{c}`") for c in columns],
    )
    return stats.selectExpr(
        *[f"coalesce(`_a_{c}`, 0D) AS `_m_{c}`" for c in columns],
        *[f"CASE WHEN `_q_{c}` > 0 THEN sqrt(`_q_{c}` / _rows) ELSE 1D END AS `_s_{c}`"
          for c in columns],
    )


def standardize(df: DataFrame, columns: list[str], stats: DataFrame) -> DataFrame:
    """Mean-impute and scale with the one-row result of `fit_standardizer`."""
    wanted = set(columns)
    return df.join(F.broadcast(stats)).selectExpr(*[
        f"(coalesce(`{c}`, `_m_{c}`) - `_m_{c}`) / `_s_{c}` AS `{c}`" if c in wanted else f"`{c}`"
        for c in df.columns
    ])
