"""Adapter registry: name -> function, plus the bounds of a normalised batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Adapter:
    """A vendor format: which file keys it takes, and how rows become canonical."""

    source_type: str
    version: str
    matches: Callable[[str], bool]
    normalize: Callable[[DataFrame], DataFrame]
    date_column: str = "business_date"


class AdapterRegistry:
    def __init__(self) -> None:
        self._adapters: dict[str, Adapter] = {}

    def register(self, adapter: Adapter) -> None:
        if adapter.source_type in self._adapters:
            raise ValueError(f"adapter already registered: {adapter.source_type}")
        self._adapters[adapter.source_type] = adapter

    def get(self, source_type: str) -> Adapter:
        return self._adapters[source_type]

    def for_key(self, source_key: str) -> Adapter | None:
        found = [a for a in self._adapters.values() if a.matches(source_key)]
        if len(found) > 1:
            raise ValueError(f"several adapters match {source_key}")
        return found[0] if found else None


def batch_bounds(batch: DataFrame, source_type: str, date_column: str = "business_date") -> DataFrame:
    """AG-19: source type and date range of a normalised batch, one row."""
    return batch.agg(
        F.min(date_column).alias("min_business_date"), F.max(date_column).alias("max_business_date")
    ).withColumn("source_type", F.lit(source_type))
