"""Newest-wins operators.

`row_number() = 1` is planned with a window group limit: every task keeps one
row per key before the shuffle, so copies of a hot key never travel together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key under a total order."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def newest_export(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """WN-01: per key the row of the newest file, then greatest key and position."""
    order = [F.desc("source_mtime"), F.desc("source_key"), F.desc("source_row")]
    return keep_first(df, keys, order)


def schedule_precedence(cells: DataFrame) -> DataFrame:
    """WN-02: one published cell per agent and date."""
    order = [F.desc("source_mtime"), F.desc("source_key"), F.desc("source_row"), F.desc("source_column")]
    return keep_first(cells, ["roster_client_id", "business_date"], order)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AG-14: keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("row_count")).filter("row_count > 1")


def require_unique(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """AG-14 as a gate for small control tables: raise on the first repeated key."""
    repeated = duplicate_keys(df, keys).limit(1).collect()
    if repeated:
        raise ValueError(f"{label} repeats a key: {repeated[0].asDict()}")
    return df
