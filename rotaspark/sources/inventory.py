"""File metadata and content fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _glob(suffix: str | None) -> str:
    """Suffix pattern that ignores case."""
    if not suffix:
        return "*"
    return "*" + "".join(f"[{ch.lower()}{ch.upper()}]" if ch.isalpha() else ch for ch in suffix)


def source_key(path: Column, root: str) -> Column:
    """Path relative to the source root, with forward slashes."""
    base = root.rstrip("/").split("://")[-1].removeprefix("file:").rstrip("/") + "/"
    return F.substring_index(path, base, -1)


def inventory(
    spark: SparkSession, root: str, folder: str, suffix: str | None, source_type: str, recursive: bool = False
) -> DataFrame:
    """SRC-01 / SRC-12 / SRC-17: type, key, size and mtime of the candidate files.

    Only file metadata is read: the content column is pruned from the scan.
    Names starting with `~$` or `.` are skipped.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", _glob(suffix))
        .option("recursiveFileLookup", str(recursive).lower())
        .load(f"{root.rstrip('/')}/{folder}".rstrip("/"))
        .select("path", "length", "modificationTime")
    )
    name = F.element_at(F.split("path", "/"), -1)
    kept = files.filter(~name.startswith("~$") & ~name.startswith("."))
    return kept.select(
        F.lit(source_type).alias("source_type"),
        source_key(F.col("path"), root).alias("source_key"),
        F.col("length").alias("file_size"),
        F.col("modificationTime").alias("mtime"),
        "path",
    )


def ordered(entries: DataFrame) -> DataFrame:
    """Candidates by lower-cased name, as the refresh visits them."""
    return entries.orderBy("source_type", F.lower("source_key"), "source_key")


def fingerprint(spark: SparkSession, paths: list[str]) -> DataFrame:
    """SRC-13: SHA-256 of whole files, one task per few files; call it for changed files only."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select(
        "path", F.col("length").alias("file_size"), F.col("modificationTime").alias("mtime"),
        F.sha2("content", 256).alias("content_sha256"),
    )


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """SRC-13: files whose size or mtime moved, or that came or went, between two inventories."""
    b = before.select("source_type", "source_key", F.struct("file_size", "mtime").alias("_before"))
    a = after.select("source_type", "source_key", F.struct("file_size", "mtime").alias("_after"))
    return (
        b.join(a, ["source_type", "source_key"], "full_outer")
        .filter(~F.col("_before").eqNullSafe(F.col("_after")))
        .select("source_type", "source_key")
    )
