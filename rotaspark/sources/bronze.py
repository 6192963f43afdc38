"""Bronze by source date: source rows as text, in one folder per type, generation and date.

A row's source date comes from its own cells and its adapter only, so it never moves when a mapping or policy does. Two
small control tables go with the folders: rows per source and date, and columns, files and bytes per folder. With them
a refresh opens the folders of the dates it needs, knows their columns without reading footers, and sees from the file
system's listing whether a folder is still whole.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rotaspark.functions.temporal import add_seconds, duration_seconds, parse_datetime
from rotaspark.plans.actuals import lilo_date
from rotaspark.sources.readers import is_header_date

BRONZE_PART = (
    "generation_id bigint, source_type string, source_key string, source_date date, row_count bigint, carry_days int"
)
BRONZE_FOLDER = "generation_id bigint, source_type string, columns array<string>, files bigint, bytes bigint"
#: Types of the columns that are not text.
_TYPES = {"source_row": "bigint", "source_mtime": "timestamp", "header_cells": "array<string>"}
_NO_DATE = "__HIVE_DEFAULT_PARTITION__"


def source_date(rows: DataFrame, source_type: str) -> Column:
    """The business date of a source row; NULL where it has none (rejected rows, rosters, registers, schedules)."""
    if source_type == "call_by_call":
        return F.to_date(parse_datetime(F.col("`Call Date/Time`")))
    if source_type == "agent_status":
        return F.to_date(parse_datetime(F.col("[Status Start Date and Time]")))
    if source_type == "lilo":
        return lilo_date(rows)
    return F.lit(None).cast("date")


def _carry_days(source_type: str) -> Column:
    """How many dates beyond its own a row reaches: status segments may go on over midnight."""
    if source_type != "agent_status":
        return F.lit(0)
    start = parse_datetime(F.col("[Status Start Date and Time]"))
    end = add_seconds(start, duration_seconds(F.col("[Status Duration]")))
    return F.greatest(F.coalesce(F.datediff(F.to_date(end), F.to_date(start)), F.lit(0)), F.lit(0))


def write(rows: DataFrame, root: str, source_type: str, generation_id: int) -> DataFrame:
    """Writes the rows of a type for one generation and reads them back."""
    path = f"{root}/bronze/{source_type}/generation_id={generation_id}"
    dated = rows.withColumn("source_date", source_date(rows, source_type))
    dated.write.mode("overwrite").partitionBy("source_date").option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(dated.schema).parquet(path)


def parts_of(written: DataFrame, source_type: str, generation_id: int) -> DataFrame:
    """BRONZE_PART of what was written. A schedule has the dates of its header, with no rows of their own."""
    found = written.groupBy("source_key", "source_date").agg(
        F.count("*").alias("row_count"), F.max(_carry_days(source_type)).cast("int").alias("carry_days")
    )
    if source_type == "published_schedule":
        headers = written.groupBy("source_key").agg(F.first("header_cells").alias("cells"))
        cells = headers.select("source_key", F.explode("cells").alias("cell"))
        days = {r["cell"]: is_header_date(r["cell"]) for r in cells.select("cell").distinct().collect()}
        table = written.sparkSession.createDataFrame([(c, d) for c, d in days.items() if d], "cell string, source_date date")
        named = cells.join(table, "cell").select("source_key", "source_date", F.lit(0).alias("row_count"), F.lit(0).alias("carry_days"))
        found = found.unionByName(named.distinct())
    return found.select(
        F.lit(generation_id).cast("bigint").alias("generation_id"), F.lit(source_type).alias("source_type"), "source_key",
        "source_date", F.col("row_count").cast("bigint").alias("row_count"), F.col("carry_days").cast("int").alias("carry_days"),
    )


def content(spark: SparkSession, path: str) -> tuple[int, int]:
    """Files and bytes under a folder, from the file system's listing; (0, 0) where it is missing."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return 0, 0
    found = files.getContentSummary(folder)
    return found.getFileCount(), found.getLength()


def folder_of(spark: SparkSession, written: DataFrame, root: str, source_type: str, generation_id: int) -> DataFrame:
    """BRONZE_FOLDER of what was written."""
    files, size = content(spark, f"{root}/bronze/{source_type}/generation_id={generation_id}")
    columns = [c for c in written.columns if c != "source_date"]
    return spark.createDataFrame([(generation_id, source_type, columns, files, size)], BRONZE_FOLDER)


def broken(spark: SparkSession, root: str, source_type: str, folders: Iterable) -> list[int]:
    """Generations whose folder of a type no longer has the files and bytes that were recorded."""
    return [
        r["generation_id"] for r in folders
        if content(spark, f"{root}/bronze/{source_type}/generation_id={r['generation_id']}") != (r["files"], r["bytes"])
    ]


def read(
    spark: SparkSession, root: str, source_type: str, columns: Iterable[str], places: Iterable[tuple[int, date | None]] | Iterable[int]
) -> DataFrame | None:
    """The rows of some (generation, date) folders, or of whole generations; None where there is none.

    Columns that a folder does not have are NULL.
    """
    base = f"{root}/bronze/{source_type}"
    paths = [
        f"{base}/generation_id={p}" if isinstance(p, int) else f"{base}/generation_id={p[0]}/source_date={p[1] or _NO_DATE}"
        for p in places
    ]
    if not paths:
        return None
    ddl = ", ".join(f"`{c.replace('`', '``')}` {_TYPES.get(c, 'string')}" for c in dict.fromkeys(columns))
    reader = spark.read.schema(f"{ddl}, generation_id bigint, source_date date").option("basePath", base)
    return reader.parquet(*sorted(paths))
