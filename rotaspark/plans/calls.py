"""Call legs and 15-minute service intervals (PR-03, PR-04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotaspark.functions import keys
from rotaspark.functions.rules import sorted_codes
from rotaspark.functions.temporal import (
    duration_seconds,
    overnight_end,
    parse_datetime,
    quarter_end,
    quarter_start,
)
from rotaspark.functions.text import clean, interval_language, normalize_id, tri_state
from rotaspark.operators.identity import map_queues, resolve_agents
from rotaspark.operators.latest import newest_export
from rotaspark.operators.quality import CALL_COUNTERS, counted_findings, source_counters
from rotaspark.policy import ServiceRules
from rotaspark.schemas import SERVICE_MEASURES

# Source headers, after blanks and brackets are stripped.
REQUIRED_HEADERS = (
    "Call Date/Time", "Call End Date/Time", "Call ID", "Call Reference Number", "Agent ID", "Agent",
    "Talk Time", "Hold Time", "Total Wrap Time",
)
OPTIONAL_HEADERS = (
    "BusinessPartnerID", "Call Completion Code", "Call Direction", "Call Treatment", "CallProgress",
    "Clearing Party", "Communication Type", "Direct", "Internal", "Language", "LineOfBusiness",
    "PCSStatus", "PostCallSurveyMode", "Queue", "Queue ID", "Ringing Duration", "Service",
    "Shared Call Reference", "Total Queue Wait Time", "Transferred?",
)
_TEXT_FIELDS = {
    "communication_type": "Communication Type",
    "call_direction": "Call Direction",
    "business_partner_id": "BusinessPartnerID",
    "lob": "LineOfBusiness",
    "service": "Service",
    "call_reference_number": "Call Reference Number",
    "call_id": "Call ID",
    "call_progress": "CallProgress",
    "queue": "Queue",
    "call_treatment": "Call Treatment",
    "agent_name": "Agent",
    "clearing_party": "Clearing Party",
    "completion_code": "Call Completion Code",
    "shared_call_reference": "Shared Call Reference",
    "language": "Language",
    "post_call_survey_mode": "PostCallSurveyMode",
    "pcs_status": "PCSStatus",
}
_DURATIONS = {
    "queue_wait_seconds": "Total Queue Wait Time",
    "talk_seconds": "Talk Time",
    "hold_seconds": "Hold Time",
    "wrap_seconds": "Total Wrap Time",
    "ringing_seconds": "Ringing Duration",
}
_FLAGS = {"transferred": "Transferred?", "internal": "Internal", "direct": "Direct"}
_ADDED = ("source_key", "source_row", "source_mtime")
UNNAMED_QUEUE = "UNNAMED MAPPED QUEUE"


def parse_calls(raw: DataFrame, roster: DataFrame, mapping: DataFrame) -> DataFrame:
    """Call rows with a `lane` (FL-03): accepted, outside, or invalid.

    A row is admitted when its agent resolves on the roster or its queue is
    mapped. Business partner and line of business are kept as evidence and
    never widen the service scope.
    """
    cells = [c for c in raw.columns if c not in _ADDED]
    cell = lambda name: F.col(f"`{name}`") if name in cells else F.lit(None).cast("string")
    start = parse_datetime(cell("Call Date/Time"))
    rows = raw.select(
        *[c for c in _ADDED if c in raw.columns],
        start.alias("call_start"),
        parse_datetime(cell("Call End Date/Time")).alias("_end"),
        normalize_id(cell("Agent ID")).alias("source_agent_id"),
        normalize_id(cell("Queue ID")).alias("queue_id"),
        *[clean(cell(header)).alias(name) for name, header in _TEXT_FIELDS.items()],
        *[duration_seconds(cell(header)).alias(f"_{name}") for name, header in _DURATIONS.items()],
        *[clean(cell(header)).isNotNull().alias(f"_has_{name}") for name, header in _DURATIONS.items()],
        *[tri_state(cell(header)).alias(name) for name, header in _FLAGS.items()],
        keys.raw_json(cells).alias("raw_payload_json"),
    ).withColumn("business_date", F.to_date("call_start"))
    rows = map_queues(resolve_agents(rows, roster), mapping)

    resolved = F.col("scope_match") != "none"
    mapped = F.col("mapping_status") == "MAPPED"
    direction = F.upper(F.coalesce(F.col("call_direction"), F.lit("")))
    rows = (
        rows.withColumn("call_end", overnight_end(F.col("call_start"), F.col("_end")))
        .withColumn("agent_eligible", resolved)
        .withColumn("service_eligible", mapped & (direction == "I"))
        .withColumn(
            "lane",
            F.when(F.col("call_start").isNull(), "invalid").when(resolved | mapped, "accepted").otherwise("outside"),
        )
        .withColumn("scope_match", F.when(resolved, F.col("scope_match")).otherwise("queue"))
    )
    bad_duration: Column = F.lit(False)
    for name in _DURATIONS:
        value = F.col(f"_{name}")
        rows = rows.withColumn(name, F.when(value >= 0, value))
        bad_duration = bad_duration | (F.col(f"_has_{name}") & F.col(name).isNull())
    rows = rows.withColumn(
        "validation_codes",
        sorted_codes(
            (bad_duration, "INVALID_DURATION"),
            (F.col("queue").isNull(), "MISSING_QUEUE"),
            (~direction.isin("I", "O"), "MISSING_CALL_DIRECTION"),
            (F.col("service_eligible") & F.col("queue_wait_seconds").isNull(), "MISSING_RESPONSE_CLOCK"),
        ),
    )
    key = keys.call_key(
        F.col("call_reference_number"), F.col("call_id"), F.col("call_direction"),
        F.coalesce("roster_client_id", "source_agent_id"), F.col("call_start"), F.col("clearing_party"),
        F.col("raw_payload_json"),
    )
    rows = rows.withColumn("call_key", key).withColumn(
        "interaction_key",
        keys.interaction_key(
            F.col("shared_call_reference"), F.col("call_reference_number"), F.col("call_id"), F.col("call_key")
        ),
    )
    return rows.drop("_end", "roster_row", "roster_key", *[f"_{n}" for n in _DURATIONS], *[f"_has_{n}" for n in _DURATIONS])


def accepted(lanes: DataFrame) -> DataFrame:
    return lanes.filter("lane = 'accepted'").drop("lane")


def call_counters(lanes: DataFrame) -> DataFrame:
    """AG-08 for calls."""
    return source_counters(
        lanes,
        "business_date",
        service_rows=F.col("service_eligible"),
        unmapped_rows=F.col("mapping_status") != "MAPPED",
        degraded_rows=F.size("validation_codes") > 0,
    )


def call_findings(lanes: DataFrame) -> DataFrame:
    """DQ-08."""
    return counted_findings(call_counters(lanes), CALL_COUNTERS)


def canonical_calls(legs: DataFrame) -> DataFrame:
    """PR-03 / WN-01: newest export of each call leg."""
    return newest_export(legs, ["call_key"])


def with_service_measures(legs: DataFrame, rules: ServiceRules) -> DataFrame:
    """FL-09..FL-11: the twelve additive measures of one leg."""
    zero = F.lit(0).cast("bigint")
    talk, hold, wrap = (F.coalesce(F.col(f"{n}_seconds"), zero) for n in ("talk", "hold", "wrap"))
    answered = F.col("source_agent_id").isNotNull() | (talk + hold + wrap > 0)
    # NULL wait keeps the clock unknown, and an unknown clock is in no band.
    clock = F.col("queue_wait_seconds") + F.coalesce(F.col("ringing_seconds"), zero)
    flag = lambda cond: F.when(cond, 1).otherwise(0).cast("bigint")
    in_target = (clock >= rules.short_abandon_seconds) & (clock < rules.target_seconds)
    measures = {
        "offered": F.lit(1).cast("bigint"),
        "answered": flag(answered),
        "abandoned": flag(~answered),
        "short_abandoned": flag(~answered & (clock < rules.short_abandon_seconds)),
        "abandoned_within_target": flag(~answered & in_target),
        "answered_within_target": flag(answered & (clock < rules.target_seconds)),
        "talk_seconds": talk,
        "hold_seconds": hold,
        "wrap_seconds": wrap,
        "handled_seconds": talk + hold + wrap,
        "call_legs": F.lit(1).cast("bigint"),
        "transferred_legs": flag(F.coalesce(F.col("transferred"), F.lit(False))),
    }
    return legs.withColumns({f"m_{name}": value for name, value in measures.items()})


INTERVAL_KEYS = (
    "business_date", "interval_start", "service_scope", "comparison_scope", "queue", "designation", "language",
)


def interval_rows(legs: DataFrame, rules: ServiceRules) -> DataFrame:
    """Service-eligible legs with the interval keys and their measures."""
    rows = legs.filter("service_eligible").withColumn("interval_start", quarter_start(F.col("call_start")))
    rows = (
        rows.withColumn("language", interval_language(F.col("service_scope"), F.col("language")))
        .withColumn("queue", F.coalesce(F.col("queue"), F.lit(UNNAMED_QUEUE)))
        .withColumn("designation", F.coalesce(F.col("designation"), F.lit("")))
    )
    return with_service_measures(rows, rules)


def service_intervals(legs: DataFrame, rules: ServiceRules) -> DataFrame:
    """PR-04 / AG-01.

    Sums are taken per interval and source file first: that stage is a plain
    hash aggregate over fixed-width buffers, combined before the shuffle. Only
    its small result gathers the file list per interval.
    """
    rows = interval_rows(legs, rules)
    per_file = rows.groupBy(*INTERVAL_KEYS, "source_key").agg(
        *[F.sum(f"m_{name}").alias(name) for name in SERVICE_MEASURES]
    )
    merged = per_file.groupBy(*INTERVAL_KEYS).agg(
        *[F.sum(name).alias(name) for name in SERVICE_MEASURES],
        F.to_json(F.array_sort(F.collect_list("source_key"))).alias("source_files_json"),
    )
    return merged.select(
        "business_date",
        "interval_start",
        quarter_end(F.col("interval_start")).alias("interval_end"),
        F.lit("CALL_BY_CALL").alias("source_system"),
        *INTERVAL_KEYS[2:],
        *SERVICE_MEASURES,
        "source_files_json",
    )


def service_ratios(intervals: DataFrame, *by: str) -> DataFrame:
    """DX-15: ratios of summed components; an empty denominator gives NULL."""
    sums = intervals.groupBy(*by).agg(*[F.sum(m).cast("bigint").alias(m) for m in SERVICE_MEASURES])
    ratio = lambda top, bottom: top / F.nullif(bottom, F.lit(0))
    return sums.withColumns(
        {
            "answer_rate": ratio(F.col("answered"), F.col("offered")),
            "abandon_rate": ratio(F.col("abandoned"), F.col("offered")),
            "service_level": ratio(F.col("answered_within_target"), F.col("offered")),
            "average_handle_seconds": ratio(F.col("handled_seconds"), F.col("answered")),
        }
    )
