"""Scalar expressions shared by the operators; all stay inside code generation."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Reported doubles are rounded to six digits. Means of two-decimal readings fall exactly on
# halves of that digit quite often, where the last bit decides; the shift moves them off.
_TIE_SHIFT = 1e-7


def fixed(col: Column | str) -> Column:
    """A double rounded for reports, stable against summation order."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c + F.lit(_TIE_SHIFT), 6)


def fixed_sql(column: str) -> str:
    """`fixed` of a column as SQL text; long select lists are built faster from text."""
    return f"round(`{column}` + {_TIE_SHIFT!r}D, 6)"


def clean_nan(df: DataFrame) -> DataFrame:
    """NaN means missing: turn it into NULL in every floating column.

    Spark orders NaN above all numbers and lets it spoil averages, so it must not get past a scan.
    """
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[
        F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns
    ])


def any_true(conditions: list[Column]) -> Column:
    """OR over conditions where an unknown one counts as false; no condition gives false."""
    return reduce(or_, [F.coalesce(c, F.lit(False)) for c in conditions], F.lit(False))


def as_instant(col: Column | str) -> Column:
    """A time column as an instant (zone-less times are UTC under the session settings)."""
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("timestamp")


def parse_time(col: Column | str) -> Column:
    """ISO-8601 text to an instant; text that cannot be read gives NULL."""
    c = F.col(col) if isinstance(col, str) else col
    return F.try_to_timestamp(c.cast("string"))


def micros(col: Column | str) -> Column:
    """Microseconds since the epoch."""
    return F.unix_micros(as_instant(col))


def hours_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(3_600_000_000.0)
