"""Bronze, silver and gold tables as Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_bronze(rows: DataFrame, root: str, source_type: str, generation_id: int) -> str:
    """SRC-14: source rows of one generation, owned by that generation for good."""
    path = f"{root}/bronze/{source_type}/generation_id={generation_id}"
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return path


def write_mart(
    mart: DataFrame, root: str, layer: str, name: str, generation_id: int, by: Sequence[str] = ("business_date",)
) -> str:
    """SRC-15: one generation of a silver or gold table, partitioned by date.

    The rebalance hint brings the rows of a date together; AQE splits a date that
    holds very many rows over several tasks and joins small ones.
    """
    path = f"{root}/{layer}/{name}/generation_id={generation_id}"
    writer = mart.hint("rebalance", *by) if by else mart
    writer.write.mode("overwrite").partitionBy(*by).option("compression", "zstd").parquet(path)
    return path


def overwrite_dates(mart: DataFrame, path: str, by: Sequence[str] = ("business_date",)) -> None:
    """GN-08: replace only the date partitions present in `mart`."""
    (
        mart.hint("rebalance", *by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .option("compression", "zstd")
        .parquet(path)
    )


def read_mart(spark: SparkSession, root: str, layer: str, name: str, generation_id: int) -> DataFrame:
    return spark.read.parquet(f"{root}/{layer}/{name}/generation_id={generation_id}")


def export_csv(mart: DataFrame, path: str) -> None:
    """DX-18: hand a gold table over as CSV; arrays become JSON text."""
    flat = [
        (F.to_json(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name)).alias(f.name)
        for f in mart.schema.fields
    ]
    mart.select(*flat).write.mode("overwrite").option("header", True).csv(path)
