"""Column helpers."""

from aerostrata.functions.scalar import (
    any_true, as_instant, clean_nan, fixed, hours_between, micros, parse_time,
)

__all__ = [
    "any_true", "as_instant", "clean_nan", "fixed", "hours_between", "micros", "parse_time",
]
