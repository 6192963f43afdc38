"""Declared tables: Spark types and the value sets that go with them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rotaspark.functions.rules import CATEGORIES


def _schema(ddl: str) -> str:
    """Schemas stay DDL texts: they parse where a session exists, and `createDataFrame` takes them."""
    return ddl


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


RAW_FTE_AGENT = _schema(
    "source_key string, source_row bigint, client_id string, employment_status string, "
    "agent_name string, team_leader string, ops_manager string, lob string, market string, "
    "language string, location string, city string, fte double, end_date date, valid boolean, "
    "validation_codes array<string>"
)
RAW_FTE_TIME_OFF = _schema(
    "source_key string, source_row bigint, source_kind string, client_id string, agent_name string, "
    "start_date date, end_date date, day_coverage string, start_sec int, end_sec int, "
    "absence_type string, record_status string, comment string, valid boolean, "
    "validation_codes array<string>, overlay_eligible boolean"
)
RAW_SCHEDULE_SHIFT = _schema(
    "source_key string, source_row bigint, source_column int, business_date date, "
    "source_agent_id string, roster_client_id string, agent_name string, raw_assignment string, "
    "assignment string, assignment_type string, scheduled_start timestamp_ntz, "
    "scheduled_end timestamp_ntz, schedule_state string, is_overnight boolean, "
    "in_roster_scope boolean, scope_match string, valid boolean, validation_codes array<string>"
)
SCHEDULE_SHIFT = _schema(
    "business_date date, roster_client_id string, source_agent_id string, agent_name string, "
    "assignment string, assignment_type string, scheduled_start timestamp_ntz, "
    "scheduled_end timestamp_ntz, schedule_state string, is_overnight boolean, scope_match string, "
    "source_key string, source_row bigint, source_column int"
)
RAW_LILO = _schema(
    "source_key string, source_row bigint, extract_date date, source_agent_id string, "
    "roster_client_id string, agent_name string, first_login timestamp_ntz, "
    "raw_last_logout timestamp_ntz, last_logout timestamp_ntz, overnight_adjusted boolean, "
    "scope_match string"
)
RAW_AGENT_STATUS = _schema(
    "source_key string, source_row bigint, serial_number string, extract_date date, "
    "source_agent_id string, roster_client_id string, agent_name string, status string, "
    "actual_category string, status_start timestamp_ntz, status_end timestamp_ntz, "
    "duration_seconds bigint, queue string, scope_match string"
)
CALL_LEG = _schema(
    "source_key string, source_row bigint, call_key string, interaction_key string, "
    "business_date date, call_start timestamp_ntz, call_end timestamp_ntz, "
    "communication_type string, call_direction string, business_partner_id string, lob string, "
    "service string, call_reference_number string, call_id string, call_progress string, "
    "queue_wait_seconds bigint, queue_id string, queue string, call_treatment string, "
    "source_agent_id string, roster_client_id string, agent_name string, clearing_party string, "
    "talk_seconds bigint, hold_seconds bigint, wrap_seconds bigint, completion_code string, "
    "transferred boolean, shared_call_reference string, ringing_seconds bigint, internal boolean, "
    "direct boolean, language string, post_call_survey_mode string, pcs_status string, "
    "raw_payload_json string, service_scope string, comparison_scope string, designation string, "
    "mapping_status string, agent_eligible boolean, service_eligible boolean, scope_match string, "
    "validation_codes array<string>"
)
SERVICE_MEASURES = (
    "offered", "answered", "abandoned", "short_abandoned", "abandoned_within_target",
    "answered_within_target", "talk_seconds", "hold_seconds", "wrap_seconds", "handled_seconds",
    "call_legs", "transferred_legs",
)
SERVICE_INTERVAL = _schema(
    "business_date date, interval_start timestamp_ntz, interval_end timestamp_ntz, "
    "source_system string, service_scope string, comparison_scope string, queue string, "
    "designation string, language string, "
    + ", ".join(f"{m} bigint" for m in SERVICE_MEASURES)
    + ", source_files_json string"
)
ATTENDANCE_AGENT_DAY = _schema(
    "agent_day_key string, business_date date, roster_client_id string, assignment string, "
    "assignment_type string, scheduled_start timestamp_ntz, scheduled_end timestamp_ntz, "
    "scheduled_minutes bigint, planned_work_minutes bigint, planned_time_off_minutes bigint, "
    "actual_first_seen timestamp_ntz, actual_last_seen timestamp_ntz, actual_evidence string, "
    "status_covered_minutes bigint, status_coverage_ratio double, status_is_primary boolean, "
    "raw_late_minutes bigint, late_minutes bigint, early_leave_minutes bigint, "
    "no_show_minutes bigint, attendance_result string, evidence_state string, "
    "status_source_loaded boolean, lilo_source_loaded boolean, lilo_row_present boolean, "
    "evaluation_as_of timestamp_ntz, schedule_source_key string, source_keys_json string, "
    "policy_fingerprint string"
)
ATTENDANCE_GAP = _schema(
    "gap_key string, agent_day_key string, business_date date, roster_client_id string, "
    "gap_type string, gap_start timestamp_ntz, gap_end timestamp_ntz, gap_minutes bigint, "
    "evidence_basis string, source_keys_json string, is_provisional boolean, "
    "policy_fingerprint string"
)
GENERATION = _schema(
    "generation_id bigint, event_seq int, status string, base_generation_id bigint, "
    "catalog_sha256 string, model_version string, event_at timestamp, failure_reason string"
)
SOURCE_MANIFEST = _schema(
    "generation_id bigint, source_type string, source_key string, state string, file_size bigint, "
    "mtime timestamp, content_sha256 string, adapter_version string, policy_fingerprint string, "
    "row_count bigint, bronze_generation_id bigint, date_from date, date_to date"
)
QUALITY_ISSUE = _schema(
    "generation_id bigint, issue_code string, severity string, source_key string, "
    "source_row bigint, source_column bigint, details string"
)
SERVICE_INTERVAL_DEMAND = _schema(
    "business_date date, interval_start timestamp_ntz, service_scope string, offered double, "
    "handled double, handle_seconds double, source_version string"
)
STAFFING_INTERVAL = _schema(
    "business_date date, interval_start timestamp_ntz, service_scope string, "
    "required_productive_fte double, required_scheduled_fte double, scheduled_fte double, "
    "present_fte double, effective_fte double, staffing_gap double, service_level double"
)
FORECAST_ACCURACY = _schema(
    "business_date date, interval_start timestamp_ntz, service_scope string, "
    "forecast_created_at timestamp_ntz, model_id string, forecast_volume double, "
    "actual_volume double, absolute_error double, signed_error double"
)
DECISION_LOG = _schema(
    "decision_id bigint, decided_at timestamp_ntz, service_scope string, intervention_type string, "
    "expected_service_impact double, outcome_window_minutes int"
)
SCENARIO = _schema(
    "scenario_id bigint, name string, volume_multiplier double, aht_delta_seconds double, "
    "additional_fte double, shrinkage double"
)

# The states and results a table may hold.
SCHEDULE_STATES = ("SHIFT", "OFF", "INVALID")
SCOPE_MATCHES = ("id", "name", "none")
GAP_TYPES = ("LATE", "LOGGED_OFF", "UNAVAILABLE", "EARLY_LEAVE", "NO_SHOW")
EVIDENCE_STATES = ("NOT_REQUIRED", "NOT_STARTED", "PROVISIONAL", "UNKNOWN", "COMPLETE")


def constraints(table: str) -> dict[str, Column]:
    """DQ-11 / DQ-12: checks of a declared table, as conditions that must hold."""
    col = F.col
    if table == "raw_agent_status":
        return {
            "category_known": col("actual_category").isin(*CATEGORIES),
            "duration_positive": col("duration_seconds") > 0,
            "ends_after_start": col("status_end") > col("status_start"),
            "scope_known": col("scope_match").isin("id", "name"),
        }
    if table == "schedule_shift":
        return {
            "state_known": col("schedule_state").isin("SHIFT", "OFF"),
            "shift_has_bounds": (col("schedule_state") == "OFF")
            | F.coalesce(col("scheduled_end") > col("scheduled_start"), F.lit(False)),
        }
    if table == "service_interval":
        counts = {f"{m}_not_negative": col(m) >= 0 for m in SERVICE_MEASURES}
        return counts | {
            "offered_splits": col("offered") == col("answered") + col("abandoned"),
            "handled_adds_up": col("handled_seconds")
            == col("talk_seconds") + col("hold_seconds") + col("wrap_seconds"),
            "interval_is_quarter": col("interval_end")
            == col("interval_start") + F.expr("INTERVAL 15 MINUTES"),
        }
    if table == "attendance_agent_day":
        return {
            "state_known": col("evidence_state").isin(*EVIDENCE_STATES),
            "minutes_not_negative": F.least(
                "scheduled_minutes", "planned_work_minutes", "planned_time_off_minutes",
                "late_minutes", "early_leave_minutes", "no_show_minutes", "status_covered_minutes",
            )
            >= 0,
            "ratio_not_negative": col("status_coverage_ratio") >= 0,
        }
    if table == "attendance_gap":
        return {
            "type_known": col("gap_type").isin(*GAP_TYPES),
            "ends_after_start": col("gap_end") > col("gap_start"),
            "minutes_positive": col("gap_minutes") > 0,
        }
    raise KeyError(table)
