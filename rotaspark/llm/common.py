"""Shared pieces of the training-data operators: table access, stages in the shared folder, successor keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the word definitions: the ASCII characters 0x20 and 0x09 to 0x0D.
BLANKS = " \t\n\x0b\f\r"

_OWN_FOLDER: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; on one machine without that setting, a temporary folder.

    A cluster without the setting is refused: its executors share no local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _OWN_FOLDER.setdefault("path", f"file://{tempfile.mkdtemp(prefix='llm-stage-')}")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes a frame to the shared folder and reads it back: later plans start there, and lost executors cost a read."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def successors(keys: DataFrame, key: str, block: int = 4096) -> DataFrame:
    """(key, next_key) for distinct integer keys in ascending order; the last key's next is NULL.

    Windows only ever see the keys of one block; blocks are linked by the same step on their numbers, twice,
    so the last window, the only one over all that is left, has one row for block**2 key values.
    """
    return _successors(keys.select(F.col(key).cast("long").alias("_k")), block, 2).select(
        F.col("_k").alias(key), F.col("_next").alias("next_key")
    )


def _successors(keys: DataFrame, block: int, levels: int) -> DataFrame:
    if not levels:
        return keys.select("_k", F.lead("_k").over(Window.orderBy("_k")).alias("_next"))
    number = F.expr(f"(_k - pmod(_k, {block}L)) div {block}L")
    blocked = keys.withColumn("_block", number)
    inside = blocked.withColumn("_next", F.lead("_k").over(Window.partitionBy("_block").orderBy("_k")))
    first = blocked.groupBy("_block").agg(F.min("_k").alias("_first"))
    links = _successors(first.select(F.col("_block").alias("_k")), block, levels - 1).select(
        F.col("_k").alias("_block"), F.col("_next").alias("_to")
    )
    following = links.join(first.select(F.col("_block").alias("_to"), "_first"), "_to").select("_block", "_first")
    return inside.join(following, "_block", "left").select("_k", F.coalesce("_next", "_first").alias("_next"))
