"""Session settings shared by jobs, tests and benchmarks."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Wall-clock timestamps are TIMESTAMP_NTZ throughout; UTC makes the few casts
# to TIMESTAMP exact. A forced skew join lets AQE split a hot agent or hot
# file even when an aggregation follows the join (the aggregation then gets
# its own exchange, fed by partial results). HotSpot never compiles a method of
# more than 8000 bytes of bytecode: the long expressions of a parser fused into
# one such method are interpreted, so stages that need one are not fused. Each
# adaptive step prints the whole plan, and the driver keeps the text of a thousand
# queries: one of hundreds of KB, as a parser has, is cut in print, never in the plan.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.maxPlanStringLength": "65536",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that already exists."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("rotaspark")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def checkpoint_root(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared checkpoint folder named by the cluster, or `fallback` when unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if fallback is None:
        raise ValueError("spark.checkpoint.dir is not set and no fallback folder was given")
    return fallback
