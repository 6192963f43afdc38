"""Streaming call legs and service intervals (SS-01..SS-05).

The same column functions run in batch and in streams. `withWatermark` needs a
TIMESTAMP, so event times are cast under the session's UTC zone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rotaspark.operators.bounded import MAX_INTERVALS
from rotaspark.operators.latest import newest_export
from rotaspark.plans.calls import INTERVAL_KEYS, interval_rows
from rotaspark.policy import ServiceRules
from rotaspark.schemas import SERVICE_MEASURES
from rotaspark.streaming.versions import VersionedTable, checkpoint_id


def dedup_stream(legs: DataFrame, lateness: str = "2 days") -> DataFrame:
    """SS-03: first arrival of each call key within the watermark."""
    timed = legs.withColumn("event_time", F.col("call_start").cast("timestamp"))
    return timed.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark(["call_key"])


def interval_stream(legs: DataFrame, rules: ServiceRules, lateness: str = "2 days", timed: bool = False) -> DataFrame:
    """SS-02: tumbling 15-minute service components under the keys of the batch table.

    `timed` legs already carry a watermark.
    """
    rows = interval_rows(legs, rules).drop("interval_start")
    if not timed:
        rows = rows.withColumn("event_time", F.col("call_start").cast("timestamp")).withWatermark(
            "event_time", lateness
        )
    sums = rows.groupBy(F.window("event_time", "15 minutes").alias("w"), "business_date", *INTERVAL_KEYS[2:]).agg(*[F.sum(f"m_{m}").alias(m) for m in SERVICE_MEASURES])
    return sums.select(
        "business_date",
        F.col("w.start").cast("timestamp_ntz").alias("interval_start"),
        F.col("w.end").cast("timestamp_ntz").alias("interval_end"),
        *INTERVAL_KEYS[2:], *SERVICE_MEASURES,
    )


def merge_newest(spark: SparkSession, path: str, checkpoint: str) -> Callable[[DataFrame, int], None]:
    """SS-01: `foreachBatch` sink that keeps the newest export of each leg per date.

    Only the folders of the batch's dates are read and rewritten. A batch counts once per checkpoint, whatever fails in
    between; a query with a fresh checkpoint goes on from the rows that are there.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        table = VersionedTable(spark, path)
        table.apply(batch, batch_id, checkpoint_id(spark, checkpoint), lambda rows: newest_export(rows, ["call_key"]))

    return write


def current_legs(spark: SparkSession, path: str) -> DataFrame:
    """The table kept by `merge_newest`."""
    rows = VersionedTable(spark, path).read()
    if rows is None:
        raise FileNotFoundError(path)
    return rows


def start_ingest(legs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """SS-01: run the ingest over all files that are present, then stop."""
    return (
        legs.writeStream.foreachBatch(merge_newest(legs.sparkSession, path, checkpoint))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def reevaluate(
    model: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None]
) -> Callable[[DataFrame, int], None]:
    """SS-04: per micro-batch, re-judge the dates that received evidence.

    `model` gets the touched dates, with the dates before and after them whose
    overnight shifts share the evidence, and returns their agent-days under the
    current evaluation time; a provisional day becomes complete this way.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        days = batch.select(F.col("extract_date").alias("business_date")).distinct()
        near = days.select(
            F.explode(F.array(F.date_sub("business_date", 1), "business_date", F.date_add("business_date", 1))).alias("business_date")
        ).distinct()
        sink(model(near), batch_id)

    return write


def split_overlong_days(intervals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SS-05: the intervals of days within the bound, and those of the days beyond it with the day's count.

    Every row is in one of the two.
    """
    size = intervals.select("business_date", "interval_start").distinct().groupBy("business_date").agg(
        F.count("*").alias("interval_count")
    )
    over = size.filter(F.col("interval_count") > MAX_INTERVALS)
    return intervals.join(over, "business_date", "left_anti"), intervals.join(over, "business_date")
