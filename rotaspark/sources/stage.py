"""Silver tables as written stages between jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from rotaspark.session import checkpoint_root

_FALLBACK: dict[str, str] = {}


def stage_root(spark: SparkSession) -> str:
    """A fresh folder under the cluster's shared checkpoint folder, one per application.

    A session on one machine may do without that setting and gets a temporary
    folder. Executors of a cluster would each write to their own disk, so there
    the setting is required.
    """
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        one_machine = spark.sparkContext.master.split("[")[0] == "local"
        unset = not spark.conf.get("spark.checkpoint.dir", None)
        base = tempfile.mkdtemp(prefix="rotaspark-") if one_machine and unset else checkpoint_root(spark)
        _FALLBACK[app] = f"{base.rstrip('/')}/stages-{uuid.uuid4().hex}"
    return _FALLBACK[app]


def write_stage(df: DataFrame, name: str, root: str | None = None) -> str:
    """Write `df` as Parquet under the stage folder and return its path."""
    path = f"{root or stage_root(df.sparkSession)}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.option("compression", "zstd").parquet(path)
    return path


def staged(df: DataFrame, name: str, root: str | None = None) -> DataFrame:
    """`df` written and read back: lineage is cut, a lost executor costs a re-read only."""
    return df.sparkSession.read.parquet(write_stage(df, name, root))
