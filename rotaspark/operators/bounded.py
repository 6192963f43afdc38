"""Bounded results: fail closed instead of cutting off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

# Most scopes on a date, most 15-minute intervals in one business day.
MAX_SCOPES = 128
MAX_INTERVALS = 104
MAX_LABEL_CHARS = 160


class BoundExceededError(RuntimeError):
    """The result is larger than its contract allows."""


def at_most(df: DataFrame, bound: int, label: str) -> DataFrame:
    """SL-02: the frame itself, or an error when it has more than `bound` rows."""
    if df.limit(bound + 1).count() > bound:
        raise BoundExceededError(f"{label} exceeds {bound} rows")
    return df


def first_row(df: DataFrame, *order: Column | str) -> DataFrame:
    """SL-03 / SL-05: first row by a total order (a top-1, not a global sort)."""
    return df.orderBy(*order).limit(1)
