"""Registered queries: Structured Streaming runs over all given files, checked against batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rotaspark.plans import calls
from rotaspark.schemas import SERVICE_MEASURES
from rotaspark.sources.stage import stage_root
from rotaspark.streaming import calls as streams
from testbed import shape
from testbed.oracle import day, iso, sums
from testbed.queries import _SILVER, _call_lanes, _legs, _silver, query


def _folder(spark, name: str) -> str:
    return f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"


def _stream(spark, sf, name: str, build):
    """A stage of the silver layer as a stream of files."""
    schema = _silver(spark, sf, name, build).schema
    path = _SILVER[(spark.sparkContext.applicationId, sf, name)]
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(path)


@query(
    f"""SELECT {iso('call_start')} AS call_start, coalesce(ref, '') AS call_reference_number, coalesce(call_id, '') AS call_id, source_key, source_row FROM legs"""
)
def stream_newest_legs(spark, sf):
    """SS-01: every export in micro-batches, merged per date; the newest export of each leg stays."""
    legs = _stream(spark, sf, "call_accepted", lambda s, d: calls.accepted(_call_lanes(s, d)))
    path = _folder(spark, "stream-legs")
    streams.start_ingest(legs, path, _folder(spark, "stream-checkpoint")).awaitTermination()
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return streams.current_legs(spark, path).select(
        "call_start", text("call_reference_number"), text("call_id"), "source_key", "source_row"
    )


@query(
    f"""SELECT {day('business_date')} AS business_date, {iso('interval_start')} AS interval_start, {iso('interval_end')} AS interval_end, service_scope, comparison_scope, queue, designation, language, {sums()} FROM intervals GROUP BY ALL"""
)
def stream_service_intervals(spark, sf):
    """SS-02 / SS-03: deduplicated legs into service intervals, under the keys of the batch table."""
    legs = streams.dedup_stream(_stream(spark, sf, "call_leg", lambda s, d: _legs(s, d)), "60 days")
    sums_ = streams.interval_stream(legs, shape.RULES, timed=True)
    path = _folder(spark, "stream-intervals")
    run = (
        sums_.writeStream.outputMode("complete")
        .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
        .option("checkpointLocation", _folder(spark, "stream-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.parquet(path).select(
        "business_date", "interval_start", "interval_end", "service_scope", "comparison_scope", "queue", "designation",
        "language", *SERVICE_MEASURES,
    )
