"""Attendance agent-days and exact gap fragments (PR-05, PR-06).

Large evidence (status segments, LILO rows, time-off rows) is joined by agent
and time bucket, reduced to one row per agent-day, and only then meets the
schedule. The rules themselves are expressions over that one row: its
`working` pieces and flattened `segments` are small arrays, at most one
element per second of a shift.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotaspark.functions.keys import agent_day_key, gap_key
from rotaspark.functions.temporal import NTZ, add_seconds, touched_dates, whole_minutes
from rotaspark.operators import intervals as iv
from rotaspark.policy import AttendancePolicy

DAY = ["roster_client_id", "business_date"]
_PAIRS = "array<struct<start:timestamp_ntz,end:timestamp_ntz>>"
_SEGMENTS = "array<struct<start:timestamp_ntz,end:timestamp_ntz,actual_category:string,source_key:string>>"


def shift_frame(schedule: DataFrame, as_of: datetime) -> DataFrame:
    """Shifts that need evidence, with the end of the evidence window (rule 3)."""
    start, end = F.col("scheduled_start"), F.col("scheduled_end")
    moment = F.lit(as_of.replace(microsecond=0)).cast(NTZ)
    sound = F.coalesce(end > start, F.lit(False))
    return (
        schedule.filter(~is_off())
        .withColumn(
            "scheduled_start",
            F.when(sound, start).otherwise(
                F.raise_error(F.concat(F.lit("canonical shift has invalid bounds: "),
                                       F.coalesce("roster_client_id", F.lit("?")))).cast(NTZ)
            ),
        )
        .withColumn("evidence_end", F.when(moment > start, F.least(end, moment)).otherwise(start))
    )


def is_off() -> Column:
    return (F.col("schedule_state") == "OFF") | (F.col("assignment_type") == "Off")


def time_off_overlay(shifts: DataFrame, time_off: DataFrame) -> DataFrame:
    """IV-07 / JN-07: merged overlay pieces and their sources per agent-day.

    A full-day row that holds the shift's start date covers the whole shift,
    also past midnight; a partial row uses its clock times on its start date.
    """
    rows = time_off.filter("overlay_eligible AND start_date IS NOT NULL").select(
        F.col("client_id").alias("roster_client_id"),
        F.col("start_date").alias("_from"),
        F.coalesce("end_date", "start_date").alias("_to"),
        "day_coverage", "start_sec", "end_sec",
        F.col("source_key").alias("_off_source"),
    )
    # Whole days as spans; the shift side spans all dates from start to end, inclusive.
    rows = rows.withColumn("_rs", F.col("_from").cast(NTZ)).withColumn(
        "_re", F.date_add("_to", 1).cast(NTZ)
    )
    days = shifts.select(
        *DAY, "scheduled_start", "scheduled_end",
        F.to_date("scheduled_start").cast(NTZ).alias("_ls"),
        F.date_add(F.to_date("scheduled_end"), 1).cast(NTZ).alias("_le"),
    )
    hits = iv.overlap_join(
        days, rows, ["roster_client_id"], left_span=("_ls", "_le"), right_span=("_rs", "_re"), unit="MONTH"
    )
    midnight = F.col("_from").cast(NTZ)
    partial = F.col("day_coverage") == "PARTIAL_DAY"
    clocks = partial & (F.col("end_sec") > F.col("start_sec"))
    full = ~F.coalesce(partial, F.lit(False)) & F.to_date("scheduled_start").between(F.col("_from"), F.col("_to"))
    hits = hits.withColumns(
        {
            "start": F.when(clocks, F.greatest(add_seconds(midnight, F.col("start_sec")), "scheduled_start"))
            .when(full, F.col("scheduled_start")),
            "end": F.when(clocks, F.least(add_seconds(midnight, F.col("end_sec")), "scheduled_end"))
            .when(full, F.col("scheduled_end")),
        }
    )
    # Longest piece per start; identical register copies fold before the shuffle.
    folded = hits.groupBy(*DAY, "start").agg(
        F.max("end").alias("end"), F.collect_set("_off_source").alias("_sources")
    )
    # The running reach makes sorted pieces mergeable in one pass over the array.
    reach = F.max("end").over(
        Window.partitionBy(*DAY).orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    )
    piece = F.when(F.col("end") > F.col("start"), F.struct("start", F.col("_reach").alias("end")))
    return (
        folded.withColumn("_reach", reach)
        .groupBy(*DAY)
        .agg(
            F.array_sort(F.collect_list(piece)).alias("_pieces"),
            F.array_distinct(F.flatten(F.collect_list("_sources"))).alias("off_sources"),
        )
        .select(*DAY, iv.array_runs(F.col("_pieces")).alias("overlay"), "off_sources")
    )


def status_segments(shifts: DataFrame, status: DataFrame) -> DataFrame:
    """IV-05 / JN-06: exclusive status segments per agent-day, inside the evidence window.

    `status_sources` lists every source with a row in the window, also where
    another row won. Status rows are first cut to the span of all shifts, so a
    wrong duration costs the days of the schedule at most; shifts and rows meet
    per agent and day, and only what they share is cut to hours, so an agent who
    holds a large share of all rows is spread over the calendar.
    """
    days = shifts.filter(F.col("evidence_end") > F.col("scheduled_start")).select(
        *DAY, "scheduled_start", "evidence_end"
    )
    span = days.agg(F.min("scheduled_start").alias("_from"), F.max("evidence_end").alias("_to"))
    rows = status.select(
        "roster_client_id", "status_start", "status_end", "actual_category", "source_key", "source_row", F.lit(1).alias("_one")
    ).join(F.broadcast(span.withColumn("_one", F.lit(1))), "_one").drop("_one")
    rows = iv.clip(rows, F.col("_from"), F.col("_to"), "status_start", "status_end").drop("_from", "_to")
    met = iv.overlap_join(
        days, rows, ["roster_client_id"], left_span=("scheduled_start", "evidence_end"), right_span=("status_start", "status_end")
    ).select(
        *DAY,
        F.greatest("scheduled_start", "status_start").alias("start"),
        F.least("evidence_end", "status_end").alias("end"),
        "actual_category", "source_key", "source_row",
    )
    flat = iv.flatten_latest(
        met, DAY, rank=["source_key", "source_row"], payload=["actual_category", "source_key"], contributor="source_key"
    )
    return flat.withColumnRenamed("contributors", "status_sources")


def loaded_dates(evidence: DataFrame) -> DataFrame:
    """AG-13: the calendar dates an evidence table holds."""
    return evidence.select("extract_date").distinct()


def lilo_bounds(shifts: DataFrame, lilo: DataFrame, status: DataFrame) -> DataFrame:
    """JN-08 / JN-16: LILO candidates and whether all dates of a shift are loaded."""
    start, end = F.col("scheduled_start"), F.col("scheduled_end")
    days = shifts.select(*DAY, "scheduled_start", "scheduled_end").withColumn(
        "extract_date", F.explode(touched_dates(start, end))
    )
    # One row per calendar date: tiny, and broadcast by its size.
    status_dates = loaded_dates(status).withColumn("_status_loaded", F.lit(True))
    lilo_dates = loaded_dates(lilo).withColumn("_lilo_loaded", F.lit(True))
    rows = lilo.select(
        "roster_client_id", "extract_date", "first_login", "last_logout",
        F.col("source_key").alias("_lilo_source"), F.lit(1).alias("_row"),
    )
    met = (
        days.join(status_dates, "extract_date", "left")
        .join(lilo_dates, "extract_date", "left")
        .join(rows, ["roster_client_id", "extract_date"], "left")
    )
    margin = F.expr("INTERVAL 4 HOURS")
    first, last = F.col("first_login"), F.col("last_logout")
    loaded = lambda name: F.min(F.coalesce(F.col(name), F.lit(False)))
    return met.groupBy(*DAY).agg(
        F.min(F.when((first >= start - margin) & (first <= end), first)).alias("lilo_first"),
        F.max(F.when((last >= start) & (last <= end + margin), last)).alias("lilo_last"),
        F.coalesce(F.max("_row"), F.lit(0)).alias("lilo_rows"),
        F.collect_set("_lilo_source").alias("lilo_sources"),
        loaded("_status_loaded").alias("status_source_loaded"),
        loaded("_lilo_loaded").alias("lilo_source_loaded"),
    )


def attendance_model(
    schedule: DataFrame,
    status: DataFrame,
    lilo: DataFrame,
    time_off: DataFrame,
    policy: AttendancePolicy,
    as_of: datetime,
) -> DataFrame:
    """One row per published shift or day off: measures, verdict and a `gaps` array.

    `agent_days` and `attendance_gaps` are projections of it; write the model
    once and read both from the written table when both are needed.
    """
    shifts = shift_frame(schedule, as_of)
    evidence = (
        shifts.join(time_off_overlay(shifts, time_off), DAY, "left")
        .join(lilo_bounds(shifts, lilo, status), DAY, "left")
        .join(status_segments(shifts, status), DAY, "left")
    )
    worked = _judge(evidence, policy, as_of)
    days_off = _days_off(schedule, as_of)
    return worked.unionByName(days_off.select(_cast_like(worked))).withColumn(
        "policy_fingerprint", F.lit(policy.fingerprint)
    )


def _cast_like(df: DataFrame) -> list[Column]:
    return [F.col(f.name).cast(f.dataType) for f in df.schema.fields]


def _days_off(schedule: DataFrame, as_of: datetime) -> DataFrame:
    """Rule 1."""
    zero, none = F.lit(0), F.lit(None)
    return schedule.filter(is_off()).select(
        agent_day_key(F.col("business_date"), F.col("roster_client_id")).alias("agent_day_key"),
        *DAY, "assignment", "assignment_type", "scheduled_start", "scheduled_end",
        F.coalesce(whole_minutes(F.col("scheduled_start"), F.col("scheduled_end")), F.lit(0)).alias("scheduled_minutes"),
        zero.alias("planned_work_minutes"), zero.alias("planned_time_off_minutes"),
        none.alias("actual_first_seen"), none.alias("actual_last_seen"),
        F.lit("NONE").alias("actual_evidence"), zero.alias("status_covered_minutes"),
        F.lit(0.0).alias("status_coverage_ratio"), F.lit(False).alias("status_is_primary"),
        zero.alias("raw_late_minutes"), zero.alias("late_minutes"), zero.alias("early_leave_minutes"),
        zero.alias("no_show_minutes"), F.lit("Off").alias("attendance_result"),
        F.lit("NOT_REQUIRED").alias("evidence_state"), F.lit(False).alias("status_source_loaded"),
        F.lit(False).alias("lilo_source_loaded"), F.lit(False).alias("lilo_row_present"),
        F.lit(as_of.replace(microsecond=0)).cast(NTZ).alias("evaluation_as_of"),
        F.col("source_key").alias("schedule_source_key"), F.lit("[]").alias("source_keys_json"),
        none.alias("gaps"),
    )


_NONE = f"cast(array() AS {_PAIRS})"


def _minutes_sql(pairs: str) -> str:
    """FN-18 over an array: minutes are floored per piece, then summed."""
    return (
        f"aggregate({pairs}, 0L, (total, x) -> "
        "total + greatest(0L, timestampdiff(MINUTE, x.start, x.end)))"
    )


def _within_working_sql(low: str, high: str) -> str:
    """Pieces of working time inside `[low, high)`."""
    return (
        f"filter(transform(working, w -> struct(greatest(w.start, {low}) AS start, "
        f"least(w.end, {high}) AS end)), x -> x.end > x.start)"
    )


def _category_steps(category: str, own: str) -> list[dict[str, str]]:
    """IV-08: runs of one status category between first and last seen, cut to working time."""
    return [
        {own: f"filter(segments, s -> s.actual_category = '{category}')"},
        {
            f"{own}_runs": (
                f"zip_with(filter({own}, (s, i) -> NOT coalesce(get({own}, i - 1).end >= s.start, false)), "
                f"filter({own}, (s, i) -> NOT coalesce(s.end >= get({own}, i + 1).start, false)), "
                "(h, t) -> struct(greatest(h.start, actual_first_seen) AS start, "
                "least(t.end, actual_last_seen) AS end))"
            )
        },
        {
            f"{own}_parts": (
                f"filter(flatten(transform({own}_runs, r -> transform(working, w -> "
                "struct(greatest(r.start, w.start) AS start, least(r.end, w.end) AS end)))), "
                "x -> actual_last_seen > actual_first_seen AND x.end > x.start "
                "AND timestampdiff(MINUTE, x.start, x.end) > {gap_tolerance})"
            )
        },
    ]


def _gap_sql(pairs: str, kind: str, basis: str, sources: str, provisional: str) -> str:
    return (
        f"transform({pairs}, x -> struct('{kind}' AS gap_type, x.start AS start, x.end AS end, "
        f"{basis} AS basis, {sources} AS sources, {provisional} AS provisional))"
    )


def _category_gap_sql(own: str, kind: str) -> str:
    sources = (
        f"array_sort(array_distinct(transform(filter({own}, s -> s.start < x.end AND s.end > x.start), "
        "s -> s.source_key)))"
    )
    return _gap_sql(f"{own}_parts", kind, "'AGENT_STATUS'", sources, "in_progress")


# Rule 9: the verdict, first match wins.
_LADDER = [
    ("excused", "Planned absence", "NOT_REQUIRED"),
    ("{now} < scheduled_start", "Not started", "NOT_STARTED"),
    ("in_progress AND late_minutes > 0", "Late - shift in progress", "PROVISIONAL"),
    ("in_progress AND unseen", "Not seen - shift in progress", "PROVISIONAL"),
    ("in_progress", "Shift in progress", "PROVISIONAL"),
    ("NOT status_source_loaded AND NOT lilo_source_loaded", "Data not loaded", "UNKNOWN"),
    ("no_show_minutes > 0 AND planned_time_off_minutes > 0", "No show - partial time off", "COMPLETE"),
    ("no_show_minutes > 0", "No show", "COMPLETE"),
    ("actual_first_seen IS NULL AND actual_last_seen IS NULL", "Missing actual evidence", "UNKNOWN"),
    ("actual_first_seen IS NULL OR actual_last_seen IS NULL", "Incomplete actual evidence", "UNKNOWN"),
    ("NOT usable", "No schedule overlap", "UNKNOWN"),
    ("late_minutes > 0 AND early_leave_minutes > 0", "Late + early leave", "COMPLETE"),
    ("late_minutes > 0", "Late", "COMPLETE"),
    ("early_leave_minutes > 0", "Early leave", "COMPLETE"),
    ("planned_time_off_minutes > 0", "Present - partial time off", "COMPLETE"),
    ("true", "Present", "COMPLETE"),
]


def _verdict_sql() -> str:
    arms = [
        f"WHEN {cond} THEN named_struct('result', '{result}', 'state', '{state}')"
        for cond, result, state in _LADDER
    ]
    return "CASE " + " ".join(arms) + " END"


# Rules 2 and 4-10 of one agent-day. Each step may use the columns of the steps
# before it; `{now}`, `{late_tolerance}`, `{gap_tolerance}` and `{coverage}` are
# the evaluation time and the policy.
_STEPS: list[dict[str, str]] = [
    {
        "planned_absence": "assignment_type = 'Planned absence'",
        "scheduled_minutes": "greatest(0L, timestampdiff(MINUTE, scheduled_start, scheduled_end))",
        "segments": f"coalesce(segments, cast(array() AS {_SEGMENTS}))",
        "status_sources": "coalesce(status_sources, cast(array() AS array<string>))",
        "lilo_sources": "coalesce(lilo_sources, cast(array() AS array<string>))",
        "off_sources": "coalesce(off_sources, cast(array() AS array<string>))",
        "has_status": "coalesce(size(segments), 0) > 0",
        "lilo_row_present": "lilo_rows > 0",
        "complete": "{now} >= scheduled_end",
        "in_progress": "{now} >= scheduled_start AND {now} < scheduled_end",
    },
    {
        "overlay": "CASE WHEN planned_absence "
        "THEN array(struct(scheduled_start AS start, scheduled_end AS end)) "
        f"ELSE coalesce(overlay, {_NONE}) END",
        "basis_sources": "array_sort(array_distinct(concat(status_sources, lilo_sources)))",
        "actual_evidence": "CASE WHEN lilo_row_present AND has_status THEN 'LILO+AGENT_STATUS' "
        "WHEN lilo_row_present THEN 'LILO' WHEN has_status THEN 'AGENT_STATUS' ELSE 'NONE' END",
        "bounded_first": "CASE WHEN lilo_first <= {now} THEN lilo_first END",
        "bounded_last": "CASE WHEN lilo_last IS NOT NULL THEN least(lilo_last, {now}) END",
        # Rule 7: a blank LILO row wins even over presence in status.
        "blank_lilo": "lilo_source_loaded AND lilo_row_present AND lilo_first IS NULL AND lilo_last IS NULL",
    },
    # Rule 2: working time is the shift without its overlay (IV-03).
    {
        "working": "filter(zip_with(concat(array(scheduled_start), transform(overlay, b -> b.end)), "
        "concat(transform(overlay, b -> b.start), array(scheduled_end)), "
        "(s, e) -> struct(s AS start, e AS end)), x -> x.end > x.start)"
    },
    # Rule 4: flattened status cut to working time, and the time that has elapsed.
    {
        "pieces": "filter(flatten(transform(segments, s -> transform(working, w -> "
        "struct(greatest(s.start, w.start) AS start, least(s.end, w.end) AS end, s.actual_category)))), "
        "x -> x.end > x.start)",
        "elapsed": "filter(transform(working, w -> struct(w.start AS start, least(w.end, {now}) AS end)), "
        "x -> x.end > x.start)",
        "planned_time_off_minutes": _minutes_sql("overlay"),
        "planned_work_minutes": _minutes_sql("working"),
    },
    {
        "presence": "filter(pieces, p -> p.actual_category <> 'Logged Off')",
        "status_covered_minutes": _minutes_sql("pieces"),
        "elapsed_minutes": _minutes_sql("elapsed"),
    },
    {
        "status_coverage_ratio": "CASE WHEN elapsed_minutes > 0 "
        "THEN status_covered_minutes / nullif(elapsed_minutes, 0L) ELSE 0D END",
        "status_first": "array_min(transform(presence, p -> p.start))",
        "status_last": "array_max(transform(presence, p -> p.end))",
    },
    {
        "status_is_primary": "has_status AND status_coverage_ratio >= {coverage}",
        "disconnected": "size(pieces) > 0 AND size(presence) = 0 AND status_coverage_ratio >= {coverage}",
    },
    # Rule 5: status decides when it is primary, otherwise the wider of both.
    {
        "actual_first_seen": "CASE WHEN status_is_primary AND status_first IS NOT NULL THEN status_first "
        "ELSE least(bounded_first, status_first) END",
        "actual_last_seen": "CASE WHEN status_is_primary AND status_last IS NOT NULL THEN status_last "
        "ELSE greatest(bounded_last, status_last) END",
    },
    {
        "usable": "coalesce(actual_last_seen >= actual_first_seen AND actual_last_seen > scheduled_start "
        "AND actual_first_seen < scheduled_end, false)",
        "raw_late_minutes": "coalesce(greatest(0L, timestampdiff(MINUTE, scheduled_start, actual_first_seen)), 0L)",
    },
    # Rules 6 and 7: late, early and no-show pieces of working time.
    {
        "late_pieces": "CASE WHEN usable AND actual_first_seen > scheduled_start THEN "
        + _within_working_sql("scheduled_start", "least(actual_first_seen, scheduled_end)")
        + f" ELSE {_NONE} END",
        "early_pieces": "CASE WHEN usable AND complete AND actual_last_seen < scheduled_end THEN "
        + _within_working_sql("greatest(actual_last_seen, scheduled_start)", "scheduled_end")
        + f" ELSE {_NONE} END",
        "no_show_pieces": "CASE WHEN (blank_lilo OR disconnected) AND NOT planned_absence AND complete "
        f"THEN working ELSE {_NONE} END",
    },
    {
        "late_minutes": _minutes_sql("late_pieces"),
        "early_leave_minutes": _minutes_sql("early_pieces"),
        "no_show_minutes": _minutes_sql("no_show_pieces"),
    },
    {
        "late_pieces": f"CASE WHEN late_minutes > {{late_tolerance}} THEN late_pieces ELSE {_NONE} END",
        "early_pieces": f"CASE WHEN early_leave_minutes > {{late_tolerance}} THEN early_pieces ELSE {_NONE} END",
        "late_minutes": "CASE WHEN late_minutes > {late_tolerance} THEN late_minutes ELSE 0L END",
        "early_leave_minutes": "CASE WHEN early_leave_minutes > {late_tolerance} THEN early_leave_minutes ELSE 0L END",
    },
    # Rule 8: gaps; both status categories are worked out side by side.
    *[
        {**off, **away}
        for off, away in zip(
            _category_steps("Logged Off", "logged_off"), _category_steps("Unavailable", "unavailable"), strict=True
        )
    ],
    {
        "gaps": "concat("
        + ", ".join(
            [
                _gap_sql("no_show_pieces", "NO_SHOW", "actual_evidence", "basis_sources", "false"),
                _gap_sql("late_pieces", "LATE", "actual_evidence", "basis_sources", "in_progress"),
                _gap_sql("early_pieces", "EARLY_LEAVE", "actual_evidence", "basis_sources", "false"),
                _category_gap_sql("logged_off", "LOGGED_OFF"),
                _category_gap_sql("unavailable", "UNAVAILABLE"),
            ]
        )
        + ")",
        "excused": "planned_absence OR (scheduled_minutes > 0 AND planned_time_off_minutes >= scheduled_minutes)",
        "unseen": "actual_first_seen IS NULL AND elapsed_minutes > {late_tolerance} AND (blank_lilo OR disconnected)",
    },
    {"verdict": _verdict_sql()},
]

_DAY_COLUMNS = [
    "concat(date_format(business_date, 'yyyyMMdd'), '-', roster_client_id) AS agent_day_key",
    *DAY, "assignment", "assignment_type", "scheduled_start", "scheduled_end", "scheduled_minutes",
    "planned_work_minutes", "planned_time_off_minutes", "actual_first_seen", "actual_last_seen",
    "actual_evidence", "status_covered_minutes", "status_coverage_ratio", "status_is_primary",
    "raw_late_minutes",
    *[
        f"CASE WHEN excused THEN 0L ELSE {name} END AS {name}"
        for name in ("late_minutes", "early_leave_minutes", "no_show_minutes")
    ],
    "verdict.result AS attendance_result",
    "verdict.state AS evidence_state",
    "status_source_loaded", "lilo_source_loaded", "lilo_row_present",
    "{now} AS evaluation_as_of",
    "source_key AS schedule_source_key",
    # Rule 10: every source that took part.
    "to_json(array_sort(array_distinct(array_compact(concat("
    "array(source_key), status_sources, lilo_sources, off_sources))))) AS source_keys_json",
    "CASE WHEN NOT excused THEN gaps END AS gaps",
]


def _judge(evidence: DataFrame, policy: AttendancePolicy, as_of: datetime) -> DataFrame:
    """Apply the rules to joined evidence, one row per agent-day."""
    values = {
        "{now}": f"TIMESTAMP_NTZ '{as_of:%Y-%m-%d %H:%M:%S}'",
        "{late_tolerance}": str(policy.late_tolerance_minutes),
        "{gap_tolerance}": str(policy.status_gap_tolerance_minutes),
        "{coverage}": repr(float(policy.minimum_status_coverage)) + "D",
    }

    def fill(text: str) -> str:
        for name, value in values.items():
            text = text.replace(name, value)
        return text

    df = evidence
    for step in _STEPS:
        df = df.withColumns({name: F.expr(fill(text)) for name, text in step.items()})
    return df.selectExpr(*[fill(text) for text in _DAY_COLUMNS])


def agent_days(model: DataFrame) -> DataFrame:
    """PR-05."""
    return model.drop("gaps")


def attendance_gaps(model: DataFrame) -> DataFrame:
    """PR-06."""
    # `explode` would add a size filter that is pushed below and evaluates all rules twice.
    rows = model.select(
        "agent_day_key", *DAY, "policy_fingerprint", F.explode_outer("gaps").alias("g")
    ).filter("g IS NOT NULL")
    return rows.select(
        gap_key(
            F.col("agent_day_key"), F.col("g.gap_type"), F.col("g.start"), F.col("g.end"), F.col("g.basis")
        ).alias("gap_key"),
        "agent_day_key",
        *DAY,
        F.col("g.gap_type").alias("gap_type"),
        F.col("g.start").alias("gap_start"),
        F.col("g.end").alias("gap_end"),
        whole_minutes(F.col("g.start"), F.col("g.end")).alias("gap_minutes"),
        F.col("g.basis").alias("evidence_basis"),
        F.to_json("g.sources").alias("source_keys_json"),
        F.col("g.provisional").alias("is_provisional"),
        "policy_fingerprint",
    )
