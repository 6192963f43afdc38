"""The registered queries: a Spark function and, where SQL can say it, its check."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rotaspark.functions import temporal as tm
from rotaspark.operators import identity as ident
from rotaspark.operators import intervals as iv
from rotaspark.operators import latest, quality
from rotaspark.plans import actuals, attendance, calls, evidence, roster
from rotaspark.policy import StatusPolicy
from rotaspark.schemas import SERVICE_MEASURES, constraints
from rotaspark.session import configure
from rotaspark.sources.stage import write_stage
from testbed import shape
from testbed.oracle import day, iso, sql, sums

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(check: str | None = None):
    """Register a query under its function name, with the SQL that must agree."""

    def wrap(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(fn(configure(spark), sf_dir))

        QUERIES[fn.__name__] = run
        if check is not None:
            ORACLES[fn.__name__] = sql(check)
        return run

    return wrap


def plain(df: DataFrame) -> DataFrame:
    """Interchange form: ISO texts for dates and times, 0/1 for booleans, JSON for arrays."""

    def one(field) -> Column:
        c, kind = F.col(f"`{field.name}`"), field.dataType.typeName()
        if kind in ("timestamp", "timestamp_ntz"):
            c = tm.iso(c.cast("timestamp_ntz"))
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind == "boolean":
            c = c.cast("int")
        elif kind == "array":
            c = F.to_json(c)
        elif kind == "double":
            c = F.round(c, 6)
        elif kind == "decimal":
            c = c.cast("bigint")
        return c.alias(field.name)

    return df.select(*[one(f) for f in df.schema.fields])


# --- shared inputs ----------------------------------------------------------
#
# `_x_lanes` and friends parse the extracts. Downstream products read silver
# tables, as they do in a refresh: each is written once per session and data
# folder, then read back from Parquet.

_SILVER: dict[tuple[str, str, str], str] = {}


def _silver(spark: SparkSession, sf: str, name: str, build: Query) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _SILVER:
        _SILVER[key] = write_stage(build(spark, sf), name)
    return spark.read.parquet(_SILVER[key])


def _parsed_roster(spark, sf):
    return roster.parse_roster(shape.roster_raw(spark, sf))


def _roster(spark, sf):
    return _silver(spark, sf, "roster", _parsed_roster)


def _parsed_time_off(spark, sf):
    pto, away = shape.registers_raw(spark, sf)
    return roster.parse_time_off(_roster(spark, sf), pto, away)


def _time_off(spark, sf):
    return _silver(spark, sf, "time_off", _parsed_time_off)


def _parsed_cells(spark, sf):
    wide, dates = shape.schedule_raw(spark, sf)
    return roster.parse_schedule(wide, dates, _roster(spark, sf))


def _cells(spark, sf):
    return _silver(spark, sf, "schedule_cells", _parsed_cells)


def _schedule(spark, sf):
    return _silver(spark, sf, "schedule_shift", lambda s, d: roster.canonical_schedule(_cells(s, d)))


def _status_lanes(spark, sf):
    return actuals.parse_status(shape.status_raw(spark, sf), _roster(spark, sf), StatusPolicy())


def _status(spark, sf):
    return _silver(spark, sf, "agent_status", lambda s, d: actuals.accepted(_status_lanes(s, d)))


def _lilo_lanes(spark, sf):
    return actuals.parse_lilo(shape.lilo_raw(spark, sf), _roster(spark, sf))


def _lilo(spark, sf):
    return _silver(spark, sf, "lilo", lambda s, d: actuals.accepted(_lilo_lanes(s, d)))


def _call_lanes(spark, sf):
    return calls.parse_calls(shape.calls_raw(spark, sf), _roster(spark, sf), shape.mapping(spark))


def _parsed_legs(spark, sf):
    return calls.canonical_calls(calls.accepted(_call_lanes(spark, sf)))


def _legs(spark, sf):
    return _silver(spark, sf, "call_leg", _parsed_legs)


def _intervals(spark, sf):
    return _silver(spark, sf, "service_interval", lambda s, d: calls.service_intervals(_legs(s, d), shape.RULES))


def _built_model(spark, sf):
    return attendance.attendance_model(
        _schedule(spark, sf), _status(spark, sf), _lilo(spark, sf),
        roster.canonical_time_off(_time_off(spark, sf)), shape.ATTENDANCE, shape.AS_OF,
    )


def _model(spark, sf):
    return _silver(spark, sf, "attendance_model", _built_model)


def _shifts(spark, sf):
    return attendance.shift_frame(_schedule(spark, sf), shape.AS_OF)


# --- calls and service intervals ---------------------------------------------

_INTERVAL_SELECT = (
    f"{day('business_date')} AS business_date, {iso('interval_start')} AS interval_start, "
    f"{iso('interval_end')} AS interval_end"
)


@query(
    f"SELECT {_INTERVAL_SELECT}, 'CALL_BY_CALL' AS source_system, service_scope, comparison_scope, queue, designation, "
    f"language, {', '.join(SERVICE_MEASURES)}, source_files_json FROM intervals"
)
def service_interval_15m(spark, sf):
    """PR-04, from the raw exports."""
    return calls.service_intervals(_parsed_legs(spark, sf), shape.RULES)


@query(
    f"""SELECT {iso('call_start')} AS call_start, {iso('call_end')} AS call_end, coalesce(ref, '') AS call_reference_number,
    coalesce(call_id, '') AS call_id, source_key, source_row, coalesce(roster_client_id, '') AS roster_client_id,
    kind AS pcs_status, transferred::INT AS transferred FROM legs"""
)
def call_dedup_latest(spark, sf):
    """WN-01 / PR-03: the newest export of each leg."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return _parsed_legs(spark, sf).select(
        "call_start", "call_end", text("call_reference_number"), text("call_id"), "source_key", "source_row",
        text("roster_client_id"), "pcs_status",
        F.coalesce("transferred", F.lit(False)).alias("transferred"),
    )


@query(
    f"""SELECT source_key, count(*) FILTER (WHERE lane = 'accepted')::BIGINT AS accepted_rows, count(*) FILTER (WHERE lane = 'outside')::BIGINT AS outside_rows,
    count(*) FILTER (WHERE lane = 'invalid')::BIGINT AS rejected_rows, count(*) FILTER (WHERE lane = 'accepted' AND service_eligible)::BIGINT AS service_rows,
    count(*) FILTER (WHERE lane = 'accepted' AND NOT mapped)::BIGINT AS unmapped_rows, count(*) FILTER (WHERE lane = 'accepted' AND len(codes) > 0)::BIGINT AS degraded_rows,
    {day("min(business_date) FILTER (WHERE lane = 'accepted')")} AS date_from, {day("max(business_date) FILTER (WHERE lane = 'accepted')")} AS date_to
    FROM call_lanes GROUP BY 1"""
)
def call_admission_counts(spark, sf):
    """FL-03 / AG-08."""
    return calls.call_counters(_call_lanes(spark, sf))


@query(
    """SELECT code, count(*)::BIGINT AS row_count FROM (SELECT unnest(codes) AS code FROM call_lanes WHERE lane = 'accepted') GROUP BY 1"""
)
def call_row_codes(spark, sf):
    """DQ-09."""
    legs = calls.accepted(_call_lanes(spark, sf))
    return legs.select(F.explode("validation_codes").alias("code")).groupBy("code").agg(F.count("*").alias("row_count"))


@query(
    """SELECT x.code AS issue_code, x.severity, source_key, x.n AS row_count FROM (
      SELECT source_key, unnest([{'code': 'CALL_REJECTED_ROWS', 'severity': 'warning', 'n': count(*) FILTER (WHERE lane = 'invalid')},
        {'code': 'CALL_OUTSIDE_SCOPE_ROWS', 'severity': 'info', 'n': count(*) FILTER (WHERE lane = 'outside')},
        {'code': 'CALL_UNMAPPED_AGENT_ROWS', 'severity': 'info', 'n': count(*) FILTER (WHERE lane = 'accepted' AND NOT mapped)},
        {'code': 'CALL_DEGRADED_ROWS', 'severity': 'warning', 'n': count(*) FILTER (WHERE lane = 'accepted' AND len(codes) > 0)}]) AS x
      FROM call_lanes GROUP BY source_key) WHERE x.n > 0"""
)
def call_findings(spark, sf):
    """DQ-08."""
    return calls.call_findings(_call_lanes(spark, sf)).select("issue_code", "severity", "source_key", "row_count")


@query(
    """SELECT coalesce(queue, '') AS queue, coalesce(q.service_scope, '') AS service_scope, coalesce(q.comparison_scope, '') AS comparison_scope,
    coalesce(q.designation, '') AS designation, CASE WHEN q.queue_key IS NULL THEN 'UNMAPPED' ELSE 'MAPPED' END AS mapping_status, count(*)::BIGINT AS row_count
    FROM calls0 LEFT JOIN queues q ON q.queue_key = regexp_replace(upper(queue), '[^A-Z0-9]', '', 'g') GROUP BY ALL"""
)
def queue_mapping_resolution(spark, sf):
    """JN-03 / JN-04."""
    raw = shape.calls_raw(spark, sf).withColumn("queue", F.nullif("Queue", F.lit("")))
    mapped = ident.map_queues(raw, shape.mapping(spark))
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return mapped.groupBy(
        text("queue"), text("service_scope"), text("comparison_scope"), text("designation"), "mapping_status"
    ).agg(F.count("*").alias("row_count"))


@query(
    """SELECT source_system, coalesce(k.service_scope, lob, '') AS service_scope, CASE WHEN k.service_scope IS NOT NULL THEN 'MAPPED' ELSE 'FALLBACK_LOB' END AS mapping_status, count(*)::BIGINT AS row_count
    FROM (SELECT 'STORM' AS source_system, c_mktsegment AS lob, regexp_replace(upper(event_type), '[^A-Z0-9]', '', 'g') AS part,
            'Q' || regexp_replace(upper(event_type), '[^A-Z0-9]', '', 'g') AS qk, event_id
          FROM events JOIN customer ON c_custkey = user_id) x
    LEFT JOIN queues k ON k.queue_key = CASE WHEN event_id % 2 = 0 THEN qk ELSE 'Q' || part END GROUP BY ALL"""
)
def queue_mapping_fallbacks(spark, sf):
    """JN-03 with all lanes: queue, then business partner, then line of business."""
    e = shape.table(spark, sf, "events").select("event_id", "user_id", "event_type")
    c = shape.table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("lob"))
    facts = e.join(c, F.col("user_id") == F.col("c_custkey")).selectExpr(
        "event_id AS source_row",
        "CASE WHEN event_id % 2 = 0 THEN concat('q ', event_type) ELSE '-' END AS queue",
        "concat('Q_', event_type) AS partner",
        "lob",
    )
    mapped = ident.map_queues(facts, shape.mapping(spark), source_system="STORM", partner="partner", lob="lob")
    return mapped.groupBy(
        F.lit("STORM").alias("source_system"), F.coalesce("service_scope", F.lit("")).alias("service_scope"), "mapping_status"
    ).agg(F.count("*").alias("row_count"))


@query(
    """SELECT l_returnflag AS service_scope, l_returnflag || l_linestatus AS queue, strftime(l_shipdate, '%Y-%m-%d') AS business_date,
    strftime(time_bucket(INTERVAL 15 MINUTE, l_shipdate + to_seconds((l_orderkey * 37 + l_linenumber * 911) % 86400)), '%Y-%m-%dT%H:%M:%S') AS interval_start,
    count(*)::BIGINT AS offered, count(*) FILTER (WHERE l_orderkey % 4 <> 0)::BIGINT AS answered,
    coalesce(sum(l_quantity::BIGINT) FILTER (WHERE l_orderkey % 4 <> 0), 0)::BIGINT AS handled_seconds,
    count(*) FILTER (WHERE l_orderkey % 4 <> 0 AND l_orderkey % 17 <> 0 AND l_quantity::BIGINT + l_linenumber % 3 < 30)::BIGINT AS answered_within_target
    FROM lineitem GROUP BY ALL"""
)
def bulk_service_intervals(spark, sf):
    """AG-01 on the largest table."""
    out = calls.service_intervals(shape.bulk_calls(spark, sf), shape.RULES)
    return out.groupBy("service_scope", "queue", "business_date", "interval_start").agg(
        *[F.sum(m).alias(m) for m in ("offered", "answered", "handled_seconds", "answered_within_target")]
    )


# --- identity and roster -----------------------------------------------------


@query(
    """SELECT id AS source_agent_id, coalesce(roster_client_id, '') AS roster_client_id, scope_match, count(*)::BIGINT AS row_count
    FROM status2 WHERE status_start IS NOT NULL GROUP BY ALL"""
)
def agent_resolution(spark, sf):
    """JN-01 over all status rows with a date."""
    lanes = _status_lanes(spark, sf).filter("status_start IS NOT NULL")
    return lanes.groupBy(
        "source_agent_id", F.coalesce("roster_client_id", F.lit("")).alias("roster_client_id"), "scope_match"
    ).agg(F.count("*").alias("row_count"))


@query("SELECT name_key, source_row, status AS employment_status FROM unique_names")
def unique_names(spark, sf):
    """JN-02."""
    return ident.unique_names(_roster(spark, sf)).select("name_key", "source_row", "employment_status")


@query("SELECT client_id, source_row, valid::INT AS valid FROM roster WHERE dup")
def roster_duplicate_winner(spark, sf):
    """WN-03."""
    rows = _parsed_roster(spark, sf)
    return rows.filter(F.array_contains("validation_codes", "DUPLICATE_CLIENT_ID")).select("client_id", "source_row", "valid")


@query(
    """SELECT code AS issue_code, 'warning' AS severity, source_row FROM (
      SELECT source_row, unnest(list_filter([CASE WHEN client_id IS NULL THEN 'BLANK_CLIENT_ID' END, CASE WHEN agent_name IS NULL THEN 'MISSING_AGENT_NAME' END,
        CASE WHEN status IS NULL THEN 'UNKNOWN_EMPLOYMENT_STATUS' END, CASE WHEN status = 'Leaver' AND end_date IS NULL THEN 'LEAVER_END_DATE_REQUIRED' END,
        CASE WHEN status = 'Active' AND end_date IS NOT NULL THEN 'ACTIVE_END_DATE_NOT_ALLOWED' END, CASE WHEN bad_end THEN 'INVALID_END_DATE' END,
        CASE WHEN bad_fte THEN 'INVALID_FTE' END, CASE WHEN fte < 0 THEN 'NEGATIVE_FTE' END, CASE WHEN missing_fte THEN 'MISSING_FTE' END,
        CASE WHEN dup THEN 'DUPLICATE_CLIENT_ID' END], lambda x: x IS NOT NULL)) AS code FROM roster)"""
)
def roster_quality(spark, sf):
    """DQ-01 / DQ-02."""
    return roster.roster_findings(_parsed_roster(spark, sf)).select("issue_code", "severity", "source_row")


@query(
    """SELECT client_id, status AS employment_status, source_row FROM by_id UNION ALL
    SELECT x.roster_client_id, r.status, r.source_row FROM (
      SELECT roster_client_id, arg_min(roster_row, (source_key, source_row, source_column)) AS rr FROM cells
      WHERE schedule_state <> 'INVALID' AND scope_match = 'name' AND roster_client_id IS NOT NULL GROUP BY 1) x
    JOIN roster r ON r.source_row = x.rr WHERE x.roster_client_id NOT IN (SELECT client_id FROM by_id)"""
)
def canonical_roster(spark, sf):
    """PR-01 / JN-11."""
    return roster.canonical_roster(_roster(spark, sf), _cells(spark, sf)).select("client_id", "employment_status", "source_row")


@query(
    """SELECT code AS issue_code, 'warning' AS severity, source_row FROM (SELECT source_row, unnest(codes) AS code FROM off2)"""
)
def register_quality(spark, sf):
    """DQ-03 / JN-12."""
    return quality.row_findings(_parsed_time_off(spark, sf), "warning").select("issue_code", "severity", "source_row")


@query(
    f"""SELECT client_id, source_row, CASE WHEN pto THEN 'PTO' ELSE 'AWAY' END AS source_kind, {day('start_date')} AS start_date, coalesce({day('end_date')}, '') AS end_date,
    day_coverage, coalesce(CASE WHEN day_coverage = 'PARTIAL_DAY' THEN s0 END, -1)::INT AS start_sec, coalesce(CASE WHEN day_coverage = 'PARTIAL_DAY' THEN e0 END, -1)::INT AS end_sec,
    eligible::INT AS overlay_eligible FROM time_off WHERE valid"""
)
def canonical_time_off(spark, sf):
    """PR-01 / FL-02 / FL-15 on the registers."""
    rows = roster.canonical_time_off(_parsed_time_off(spark, sf))
    return rows.select(
        "client_id", "source_row", "source_kind", "start_date",
        F.coalesce(F.date_format("end_date", "yyyy-MM-dd"), F.lit("")).alias("end_date"),
        "day_coverage",
        F.coalesce("start_sec", F.lit(-1)).alias("start_sec"), F.coalesce("end_sec", F.lit(-1)).alias("end_sec"),
        "overlay_eligible",
    )


# --- schedule ----------------------------------------------------------------


@query(
    f"""SELECT source_key, source_row, source_column::INT AS source_column, {day('business_date')} AS business_date FROM cells1"""
)
def schedule_unpivot(spark, sf):
    """SET-03."""
    wide, dates = shape.schedule_raw(spark, sf)
    return roster.unpivot_schedule(wide, dates).select("source_key", "source_row", "source_column", "business_date")


@query(
    f"""SELECT source_key, source_row, {day('business_date')} AS business_date, schedule_state, assignment, assignment_type,
    coalesce({iso('scheduled_start')}, '') AS scheduled_start, coalesce({iso('scheduled_end')}, '') AS scheduled_end,
    CASE kind WHEN 'tbc' THEN '["MALFORMED_SHIFT_INTERVAL"]' WHEN 'inverted' THEN '["SHIFT_END_NOT_AFTER_START"]' ELSE '[]' END AS validation_codes,
    coalesce(schedule_state = 'SHIFT' AND scheduled_end::DATE > scheduled_start::DATE, false)::INT AS is_overnight, scope_match
    FROM cells"""
)
def schedule_validity(spark, sf):
    """FN-15 / FN-16 / FL-07."""
    text = lambda c: F.coalesce(tm.iso(F.col(c)), F.lit("")).alias(c)
    return _parsed_cells(spark, sf).select(
        "source_key", "source_row", "business_date", "schedule_state", "assignment", "assignment_type",
        text("scheduled_start"), text("scheduled_end"), "validation_codes", "is_overnight", "scope_match",
    )


@query(
    """SELECT issue_code, CASE issue_code WHEN 'SCHEDULE_OUTSIDE_EFFECTIVE_ROSTER' THEN 'info' WHEN 'SCHEDULE_ID_NAME_FALLBACK' THEN 'warning' ELSE 'error' END AS severity, count(*)::BIGINT AS finding_count FROM (
      SELECT unnest(list_filter([CASE WHEN scope_match = 'none' THEN 'SCHEDULE_OUTSIDE_EFFECTIVE_ROSTER' END, CASE WHEN scope_match = 'name' THEN 'SCHEDULE_ID_NAME_FALLBACK' END,
        CASE WHEN kind = 'tbc' THEN 'MALFORMED_SHIFT_INTERVAL' END, CASE WHEN kind = 'inverted' THEN 'SHIFT_END_NOT_AFTER_START' END], lambda x: x IS NOT NULL)) AS issue_code FROM cells) GROUP BY ALL"""
)
def schedule_findings(spark, sf):
    """DQ-04 / DQ-05 / DQ-06."""
    found = roster.schedule_findings(_cells(spark, sf))
    return found.groupBy("issue_code", "severity").agg(F.count("*").alias("finding_count"))


@query(
    f"""SELECT roster_client_id, {day('business_date')} AS business_date, assignment, schedule_state, source_key FROM schedule"""
)
def schedule_precedence(spark, sf):
    """WN-02."""
    return roster.canonical_schedule(_cells(spark, sf)).select("roster_client_id", "business_date", "assignment", "schedule_state", "source_key")


# --- status and LILO ---------------------------------------------------------


@query(
    f"""SELECT source_key, source_row, roster_client_id, category AS actual_category, label_mapped::INT AS label_mapped, {iso('status_start')} AS status_start,
    {iso('status_end')} AS status_end, scope_match FROM status"""
)
def status_classify(spark, sf):
    """PR-02 / FN-13 / FN-29."""
    return actuals.accepted(_status_lanes(spark, sf)).select(
        "source_key", "source_row", "roster_client_id", "actual_category", "label_mapped", "status_start", "status_end", "scope_match"
    )


@query(
    f"""SELECT source_key, count(*) FILTER (WHERE lane = 'accepted')::BIGINT AS accepted_rows, count(*) FILTER (WHERE lane = 'outside')::BIGINT AS outside_rows,
    count(*) FILTER (WHERE lane = 'invalid')::BIGINT AS rejected_rows, count(*) FILTER (WHERE lane = 'accepted' AND NOT label_mapped)::BIGINT AS unmapped_rows,
    {day("min(extract_date) FILTER (WHERE lane = 'accepted')")} AS date_from, {day("max(extract_date) FILTER (WHERE lane = 'accepted')")} AS date_to
    FROM status_lanes GROUP BY 1"""
)
def status_counters(spark, sf):
    """AG-08 / FL-05."""
    return actuals.status_counters(_status_lanes(spark, sf))


@query(
    """SELECT issue_code, severity, sum(n)::BIGINT AS row_count, count(*)::BIGINT AS sources FROM (
      SELECT 'AGENT_STATUS_REJECTED_ROWS' AS issue_code, 'warning' AS severity, source_key, count(*) AS n FROM status_lanes WHERE lane = 'invalid' GROUP BY ALL UNION ALL
      SELECT 'AGENT_STATUS_OUTSIDE_ROSTER_ROWS', 'info', source_key, count(*) FROM status_lanes WHERE lane = 'outside' GROUP BY ALL UNION ALL
      SELECT 'AGENT_STATUS_UNMAPPED_LABELS', 'warning', source_key, count(*) FROM status WHERE NOT label_mapped GROUP BY ALL UNION ALL
      SELECT 'LILO_OUTSIDE_ROSTER_ROWS', 'info', source_key, count(*) FROM lilo_lanes WHERE lane = 'outside' GROUP BY ALL) GROUP BY ALL"""
)
def actual_findings(spark, sf):
    """DQ-07."""
    found = actuals.status_findings(_status_lanes(spark, sf)).unionByName(
        actuals.lilo_findings(_lilo_lanes(spark, sf))
    )
    return found.groupBy("issue_code", "severity").agg(
        F.sum("row_count").alias("row_count"), F.count("*").alias("sources")
    )


@query(
    f"""SELECT roster_client_id, {day('extract_date')} AS extract_date, coalesce({iso('first_login')}, '') AS first_login, coalesce({iso('last_logout')}, '') AS last_logout,
    adjusted::INT AS overnight_adjusted, scope_match FROM lilo"""
)
def lilo_rows(spark, sf):
    """PR-02 / FL-06 / FN-28."""
    text = lambda c: F.coalesce(tm.iso(F.col(c)), F.lit("")).alias(c)
    return actuals.accepted(_lilo_lanes(spark, sf)).select(
        "roster_client_id", "extract_date", text("first_login"), text("last_logout"), "overnight_adjusted", "scope_match"
    )


# --- interval algebra --------------------------------------------------------


@query(
    f"SELECT c AS roster_client_id, {day('bd')} AS business_date, {iso('l')} AS seg_start, {iso('r')} AS seg_end, category, source_key FROM segments"
)
def status_flatten(spark, sf):
    """IV-05 inside each shift's evidence window."""
    flat = attendance.status_segments(_shifts(spark, sf), _status(spark, sf))
    return flat.select("roster_client_id", "business_date", F.explode("segments").alias("g")).select(
        "roster_client_id", "business_date", F.col("g.start").alias("seg_start"), F.col("g.end").alias("seg_end"),
        F.col("g.actual_category").alias("category"), F.col("g.source_key").alias("source_key"),
    )


_MERGE = """SELECT roster_client_id AS c, min(status_start) AS s, max(status_end) AS e FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY roster_client_id ORDER BY status_start, status_end ROWS UNBOUNDED PRECEDING) AS island FROM (
      SELECT *, CASE WHEN status_start > max(status_end) OVER (PARTITION BY roster_client_id ORDER BY status_start, status_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        THEN 1 ELSE 0 END AS fresh FROM status)) GROUP BY roster_client_id, island"""


def _presence(spark, sf):
    return _status(spark, sf).select(
        "roster_client_id", F.col("status_start").alias("start"), F.col("status_end").alias("end")
    )


@query(f"SELECT c AS roster_client_id, {iso('s')} AS start, {iso('e')} AS end FROM ({_MERGE})")
def interval_merge(spark, sf):
    """IV-02 over each agent's whole history."""
    return iv.merge_intervals(_presence(spark, sf), ["roster_client_id"])


@query(
    f"""SELECT c AS roster_client_id, {day('bd')} AS business_date, {iso('ws')} AS start, {iso('we')} AS end FROM (
      SELECT c, bd, lag(pe) OVER (PARTITION BY c, bd ORDER BY ps, pe, o) AS ws, ps AS we FROM (
        SELECT c, bd, s AS ps, s AS pe, 0 AS o FROM shifts UNION ALL
        SELECT h.c, h.bd, greatest(h.s, m.s), least(h.e, m.e), 1 FROM shifts h JOIN ({_MERGE}) m ON m.c = h.c AND m.s < h.e AND m.e > h.s UNION ALL
        SELECT c, bd, e, e, 2 FROM shifts)) WHERE ws IS NOT NULL AND we > ws"""
)
def interval_subtract(spark, sf):
    """IV-03: shift time without any status evidence."""
    spans = _shifts(spark, sf).select(
        "roster_client_id", "business_date", F.col("scheduled_start").alias("start"), F.col("scheduled_end").alias("end")
    )
    met = iv.overlap_join(
        spans.withColumnsRenamed({"start": "_s", "end": "_e"}), _presence(spark, sf), ["roster_client_id"],
        left_span=("_s", "_e"), right_span=("start", "end"),
    ).select("roster_client_id", "business_date", "start", "end")
    return iv.subtract_intervals(spans, met, ["roster_client_id", "business_date"])


@query(
    f"""SELECT h.c AS roster_client_id, {day('h.bd')} AS business_date, {iso('greatest(h.s, m.s)')} AS start, {iso('least(h.e, m.e)')} AS end
    FROM shifts h JOIN ({_MERGE}) m ON m.c = h.c AND m.s < h.e AND m.e > h.s"""
)
def interval_intersect(spark, sf):
    """IV-04 / JN-10: shifts cut with merged presence."""
    spans = _shifts(spark, sf).select(
        "roster_client_id", "business_date", F.col("scheduled_start").alias("start"), F.col("scheduled_end").alias("end")
    )
    merged = iv.merge_intervals(_presence(spark, sf), ["roster_client_id"])
    return iv.intersect_intervals(spans, merged, ["roster_client_id"]).select(
        "roster_client_id", "business_date", "start", "end"
    )


@query(
    f"""SELECT c AS roster_client_id, {day('bd')} AS business_date, {iso('ps')} AS start, {iso('pe')} AS end FROM (
      SELECT c, bd, min(ps) AS ps, max(pe) AS pe FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY c, bd ORDER BY ps, pe ROWS UNBOUNDED PRECEDING) AS island FROM (
          SELECT *, CASE WHEN ps > max(pe) OVER (PARTITION BY c, bd ORDER BY ps, pe ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh
          FROM (SELECT c, bd, greatest(ps, s) AS ps, least(pe, e) AS pe FROM off_hits WHERE ps IS NOT NULL AND greatest(ps, s) < least(pe, e))))
      GROUP BY c, bd, island)"""
)
def time_off_overlay(spark, sf):
    """IV-07 / JN-07."""
    overlay = attendance.time_off_overlay(
        _shifts(spark, sf), roster.canonical_time_off(_time_off(spark, sf))
    )
    return overlay.select("roster_client_id", "business_date", F.explode("overlay").alias("p")).select(
        "roster_client_id", "business_date", F.col("p.start").alias("start"), F.col("p.end").alias("end")
    )


@query(
    f"""SELECT c AS roster_client_id, {day('bd')} AS business_date, coalesce({iso('lf')}, '') AS lilo_first, coalesce({iso('ll')}, '') AS lilo_last,
    (n > 0)::INT AS lilo_row_present, status_loaded::INT AS status_source_loaded, lilo_loaded::INT AS lilo_source_loaded FROM lilo_sums"""
)
def lilo_bounds(spark, sf):
    """JN-08 / JN-16 / AG-13 / AG-17."""
    bounds = attendance.lilo_bounds(_shifts(spark, sf), _lilo(spark, sf), _status(spark, sf))
    text = lambda c: F.coalesce(tm.iso(F.col(c)), F.lit("")).alias(c)
    return bounds.select(
        "roster_client_id", "business_date", text("lilo_first"), text("lilo_last"),
        (F.col("lilo_rows") > 0).alias("lilo_row_present"), "status_source_loaded", "lilo_source_loaded",
    )


# --- attendance --------------------------------------------------------------

_DAY_TIMES = ("scheduled_start", "scheduled_end", "actual_first_seen", "actual_last_seen")


@query(
    f"""SELECT * REPLACE ({day('business_date')} AS business_date, {', '.join(f"coalesce({iso(c)}, '') AS {c}" for c in _DAY_TIMES)}) FROM agent_day"""
)
def attendance_day(spark, sf):
    """PR-05: all rule outcomes per agent-day."""
    days = attendance.agent_days(_built_model(spark, sf)).drop("evaluation_as_of", "policy_fingerprint")
    return days.withColumns({c: F.coalesce(tm.iso(F.col(c)), F.lit("")) for c in _DAY_TIMES})


@query(
    f"""SELECT * REPLACE ({day('business_date')} AS business_date, {iso('gap_start')} AS gap_start, {iso('gap_end')} AS gap_end),
    sha256(agent_day_key || '|' || gap_type || '|' || {iso('gap_start')} || '|' || {iso('gap_end')} || '|' || evidence_basis) AS gap_key FROM gaps"""
)
def attendance_gaps(spark, sf):
    """PR-06."""
    return attendance.attendance_gaps(_built_model(spark, sf)).drop("policy_fingerprint")


@query(
    f"SELECT {day('business_date')} AS business_date, service_scope, comparison_scope, {iso('interval_start')} AS interval_start, {iso('interval_end')} AS interval_end, {sums()} FROM intervals GROUP BY ALL"
)
def operate_intervals(spark, sf):
    """AG-02 for every date and scope."""
    return evidence.scope_intervals(_intervals(spark, sf))


@query(
    f"SELECT {day('business_date')} AS business_date, service_scope, comparison_scope FROM intervals GROUP BY ALL"
)
def operate_scopes(spark, sf):
    """AG-07 for every date."""
    return _intervals(spark, sf).select("business_date", "service_scope", "comparison_scope").distinct()


@query(f"SELECT {day('business_date')} AS business_date, evidence_state, count(*)::BIGINT AS agent_days FROM agent_day GROUP BY ALL")
def operate_states(spark, sf):
    """AG-05."""
    return evidence.evidence_states(attendance.agent_days(_model(spark, sf)))


@query(
    f"SELECT {day('business_date')} AS business_date, gap_type, count(*)::BIGINT AS fragments, sum(gap_minutes)::BIGINT AS minutes FROM gaps GROUP BY ALL"
)
def operate_gaps(spark, sf):
    """AG-06."""
    return evidence.gap_types(attendance.attendance_gaps(_model(spark, sf)))


_PROFILE_QUEUES = "upper(queue) IN ('Q CLICK', 'Q-CLICK', 'Q PURCHASE', 'Q-PURCHASE')"


@query(
    f"SELECT {day('business_date')} AS business_date, {iso(chr(39).join(['date_trunc(', 'hour', ', interval_start)']))} AS hour_start, {sums()} FROM intervals WHERE {_PROFILE_QUEUES} GROUP BY ALL"
)
def flash_hours(spark, sf):
    """PR-08 / AG-04, hours of every date."""
    return evidence.flash_hours(_intervals(spark, sf), shape.PROFILES[0])


@query(f"SELECT {sums()} FROM intervals WHERE business_date = DATE '2024-01-10' AND {_PROFILE_QUEUES}")
def flash_totals(spark, sf):
    """AG-04, totals of one date."""
    profile = evidence.choose_profile(shape.PROFILES, date(2024, 1, 10))
    return evidence.flash_totals(_intervals(spark, sf), profile, date(2024, 1, 10))


@query(
    f"""SELECT coalesce(CASE WHEN upper(queue) IN ('Q-CLICK', 'Q CLICK') THEN 'Clicks' WHEN contains(upper(queue), 'PURCHASE') THEN 'Buys' END, 'Other') AS profile_group, {sums()} FROM intervals GROUP BY 1"""
)
def flash_groups(spark, sf):
    """DX-16."""
    grouped = evidence.profile_groups(_intervals(spark, sf), shape.GROUPS)
    return grouped.groupBy(F.coalesce("profile_group", F.lit("Other")).alias("profile_group")).agg(
        *[F.sum(m).alias(m) for m in SERVICE_MEASURES]
    )


@query(
    f"""SELECT service_scope, {day('business_date')} AS business_date, {sums()}, round(sum(answered) / nullif(sum(offered), 0)::DOUBLE, 6) AS answer_rate, round(sum(abandoned) / nullif(sum(offered), 0)::DOUBLE, 6) AS abandon_rate,
    round(sum(answered_within_target) / nullif(sum(offered), 0)::DOUBLE, 6) AS service_level, round(sum(handled_seconds) / nullif(sum(answered), 0)::DOUBLE, 6) AS average_handle_seconds FROM intervals GROUP BY ALL"""
)
def service_ratios(spark, sf):
    """DX-15."""
    return calls.service_ratios(_intervals(spark, sf), "service_scope", "business_date")


@query(
    f"""SELECT {day("greatest((SELECT max(business_date) FROM legs), (SELECT max(extract_date) FROM status), (SELECT max(extract_date) FROM lilo), (SELECT max(business_date) FROM agent_day))")} AS latest_actual_date"""
)
def latest_actual_date(spark, sf):
    """AG-18."""
    days = attendance.agent_days(_model(spark, sf))
    return evidence.latest_actual_date(_legs(spark, sf), _status(spark, sf), _lilo(spark, sf), days)


@query(
    """SELECT 'offered_splits' AS check_name, count(*) FILTER (WHERE offered <> answered + abandoned)::BIGINT AS broken_rows FROM intervals
    UNION ALL SELECT 'handled_adds_up', count(*) FILTER (WHERE handled_seconds <> talk_seconds + hold_seconds + wrap_seconds)::BIGINT FROM intervals
    UNION ALL SELECT 'interval_is_quarter', count(*) FILTER (WHERE interval_end <> interval_start + INTERVAL 15 MINUTE)::BIGINT FROM intervals"""
    + "".join(f" UNION ALL SELECT '{m}_not_negative', count(*) FILTER (WHERE {m} < 0)::BIGINT FROM intervals" for m in SERVICE_MEASURES)
)
def interval_constraints(spark, sf):
    """DQ-11 / DQ-12 on the service intervals."""
    return quality.violations(_intervals(spark, sf), constraints("service_interval"))


@query(
    """SELECT x.severity, coalesce(n, 0)::BIGINT AS finding_count FROM (VALUES ('info'), ('warning'), ('error')) x(severity) LEFT JOIN (
      SELECT severity, count(*) AS n FROM (
        SELECT CASE WHEN scope_match = 'none' THEN 'info' ELSE 'warning' END AS severity FROM cells WHERE scope_match <> 'id'
        UNION ALL SELECT 'error' FROM cells WHERE kind IN ('tbc', 'inverted')) GROUP BY 1) y USING (severity)"""
)
def quality_by_severity(spark, sf):
    """AG-11."""
    return quality.by_severity(roster.schedule_findings(_cells(spark, sf)))


@query("SELECT client_id, count(*)::BIGINT AS row_count FROM roster WHERE client_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    """AG-14."""
    return latest.duplicate_keys(_parsed_roster(spark, sf).filter("client_id IS NOT NULL"), ["client_id"])
