"""Canonical roster, time off and published schedule (PR-01)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotaspark.functions import rules
from rotaspark.functions.temporal import parse_date, parse_header_date, time_of_day_seconds
from rotaspark.functions.text import clean, clean_cell, id_text, keyword, normalize_id, number, with_clean
from rotaspark.operators.identity import match_agents, on_day, spread_nulls, valid_ids
from rotaspark.operators.latest import keep_first, schedule_precedence
from rotaspark.operators.quality import row_findings

# Register states and coverage words.
PTO_STATES = ("APPROVED", "PENDING", "CANCELLED")
AWAY_STATES = ("ACTIVE", "PLANNED", "CLOSED", "CANCELLED")
AWAY_OVERLAY_STATES = ("ACTIVE", "PLANNED", "CLOSED")
SCHEDULE_SEVERITY = {
    "SCHEDULE_OUTSIDE_EFFECTIVE_ROSTER": "info",
    "SCHEDULE_ID_NAME_FALLBACK": "warning",
    "MALFORMED_SHIFT_INTERVAL": "error",
    "SHIFT_START_DATE_MISMATCH": "error",
    "SHIFT_END_NOT_AFTER_START": "error",
    "SHIFT_END_DATE_OUT_OF_RANGE": "error",
    "SHIFT_EXCEEDS_24_HOURS": "error",
}


def _has_text(c: Column) -> Column:
    return clean(c).isNotNull()


def parse_roster(raw: DataFrame, id_is_text: bool = True) -> DataFrame:
    """DQ-01 and DQ-02 on roster rows with logical column names.

    `id_is_text` says whether the source delivered ids as text; a numeric
    column earns the advisory CLIENT_ID_NOT_TEXT on every row.
    """
    present = F.coalesce(*[clean(F.col(c).cast("string")) for c in raw.columns if c not in ("source_key", "source_row")])
    status_key = keyword(F.col("employment_status"))
    parsed = (
        raw.filter(present.isNotNull())
        .withColumn("_raw_status", clean(F.col("employment_status")))
        .withColumn("_status", F.when(status_key == "ACTIVE", "Active").when(status_key == "LEAVER", "Leaver"))
        .withColumn("_raw_end", F.col("end_date"))
        .withColumn("_raw_fte", F.col("fte"))
        .withColumn("client_id", normalize_id(F.col("client_id")))
        .withColumn("agent_name", clean(F.col("agent_name")))
        .withColumn("end_date", parse_date(F.col("end_date")))
        .withColumn("fte", number(F.col("fte")))
    )
    status, end, fte = F.col("_status"), F.col("end_date"), F.col("fte")
    advisory = rules.codes(
        (F.col("client_id").isNull(), "BLANK_CLIENT_ID"),
        (F.col("client_id").isNotNull() & F.lit(not id_is_text), "CLIENT_ID_NOT_TEXT"),
    )
    invalid = rules.codes(
        (F.col("agent_name").isNull(), "MISSING_AGENT_NAME"),
        (status.isNull(), "UNKNOWN_EMPLOYMENT_STATUS"),
        ((status == "Leaver") & end.isNull(), "LEAVER_END_DATE_REQUIRED"),
        ((status == "Active") & end.isNotNull(), "ACTIVE_END_DATE_NOT_ALLOWED"),
        (_has_text(F.col("_raw_end")) & end.isNull(), "INVALID_END_DATE"),
        (_has_text(F.col("_raw_fte")) & fte.isNull(), "INVALID_FTE"),
        (fte < 0, "NEGATIVE_FTE"),
    )
    optional = ("team_leader", "ops_manager", "lob", "market", "language", "location", "city")
    for name in optional:
        source = F.col(name) if name in raw.columns else F.lit(None).cast("string")
        parsed = parsed.withColumn(name, clean(source))
    rows = (
        parsed.withColumn("_invalid", invalid)
        .withColumn("validation_codes", F.concat(advisory, F.col("_invalid")))
        .withColumn("valid", F.size("_invalid") == 0)
        .withColumn("missing_fte", ~_has_text(F.col("_raw_fte")))
        .withColumn("employment_status", F.coalesce("_status", "_raw_status"))
    ).select(
        "source_key", "source_row", "client_id", "employment_status", "agent_name", *optional,
        "fte", "end_date", "valid", "validation_codes", "missing_fte",
    )
    return mark_duplicates(rows)


def mark_duplicates(rows: DataFrame) -> DataFrame:
    """WN-03 / DQ-02: Active first, then later end date, then later row wins.

    The winner comes from a partial aggregate, not a window, so one id that
    fills a third of the roster is folded before it is shuffled.
    """
    order = F.struct(
        (F.col("employment_status") == "Active").alias("active"),
        F.coalesce("end_date", F.to_date(F.lit("0001-01-01"))).alias("end_date"),
        "source_row",
        "source_key",
    )
    repeated = (
        rows.filter("client_id IS NOT NULL")
        .groupBy(F.col("client_id").alias("_dup_id"))
        .agg(F.count("*").alias("_copies"), F.max(F.when(F.col("valid"), order)).alias("_winner"))
        .filter("_copies > 1")
    )
    spread = rows.withColumn("_spread", spread_nulls(F.col("client_id"), "source_row"))
    joined = spread.join(repeated, F.col("_spread") == F.col("_dup_id"), "left").drop("_spread")
    duplicate = F.col("_copies").isNotNull()
    wins = (F.col("_winner.source_row") == F.col("source_row")) & (
        F.col("_winner.source_key") == F.col("source_key")
    )
    return (
        joined.withColumn("valid", F.col("valid") & (~duplicate | F.coalesce(wins, F.lit(False))))
        .withColumn(
            "validation_codes",
            F.when(duplicate, F.concat("validation_codes", F.array(F.lit("DUPLICATE_CLIENT_ID"))))
            .otherwise(F.col("validation_codes")),
        )
        .drop("_dup_id", "_copies", "_winner")
    )


def roster_findings(roster: DataFrame) -> DataFrame:
    """DQ-01 / DQ-02 findings; a missing FTE is a finding without making a code."""
    all_codes = F.concat(
        F.col("validation_codes"),
        F.when(F.col("missing_fte"), F.array(F.lit("MISSING_FTE"))).otherwise(F.array().cast("array<string>")),
    )
    return row_findings(roster.withColumn("_codes", all_codes), "warning", "_codes")


def _register_frame(raw: DataFrame, roster: DataFrame, kind: str, id_is_text: bool) -> DataFrame:
    known = valid_ids(roster).select(F.col("client_id").alias("_known")).distinct()
    texts = {
        c: c
        for c in ("client_id", "start_date", "end_date", "agent_name", "comment", "absence_type", "record_status", "day_coverage", "start_time", "end_time")
        if c in raw.columns
    }
    base = with_clean(raw, texts).withColumn("_has_end", F.col("end_date").isNotNull())
    base = base.withColumn("client_id", normalize_id(F.col("client_id"), is_clean=True))
    base = base.withColumn("_spread", spread_nulls(F.col("client_id"), "source_row"))
    base = base.join(known, F.col("_spread") == F.col("_known"), "left").drop("_spread")
    base = (
        base.withColumn("start_date", parse_date(F.col("start_date"), is_clean=True))
        .withColumn("end_date", parse_date(F.col("end_date"), is_clean=True))
        .withColumn("agent_name", F.col("agent_name") if "agent_name" in raw.columns else F.lit(None).cast("string"))
        .withColumn("comment", F.col("comment") if "comment" in raw.columns else F.lit(None).cast("string"))
        .withColumn("record_status", F.upper("record_status"))
        .withColumn("source_kind", F.lit(kind))
    )
    start, end = F.col("start_date"), F.col("end_date")
    blank = F.col("client_id").isNull()
    advisory = rules.codes((~blank & F.lit(not id_is_text), "CLIENT_ID_NOT_TEXT"))
    bad_end = F.col("_has_end") & end.isNull()
    common = [
        (blank, "BLANK_CLIENT_ID"),
        (~blank & F.col("_known").isNull(), "TIME_OFF_CLIENT_NOT_IN_ROSTER"),
        (start.isNull(), "INVALID_START_DATE"),
        (end < start, "END_DATE_BEFORE_START"),
    ]
    status = F.col("record_status")
    if kind == "PTO":
        coverage = keyword(F.col("day_coverage"))
        base = (
            base.withColumn(
                "day_coverage",
                F.when(coverage == "FULL DAY", "FULL_DAY").when(coverage == "PARTIAL DAY", "PARTIAL_DAY"),
            )
            .withColumn("start_sec", time_of_day_seconds(F.col("start_time"), is_clean=True))
            .withColumn("end_sec", time_of_day_seconds(F.col("end_time"), is_clean=True))
        )
        partial = F.col("day_coverage") == "PARTIAL_DAY"
        bad_times = ~F.coalesce(F.col("end_sec") > F.col("start_sec"), F.lit(False))
        errors = rules.codes(
            *common,
            (end.isNull(), "INVALID_END_DATE"),
            (F.col("day_coverage").isNull(), "INVALID_DAY_COVERAGE"),
            (partial & (start != end), "PARTIAL_PTO_MULTIPLE_DATES"),
            (partial & bad_times, "INVALID_PARTIAL_PTO_TIME"),
            (F.col("absence_type").isNull(), "MISSING_PTO_TYPE"),
            (~F.coalesce(status.isin(*PTO_STATES), F.lit(False)), "INVALID_PTO_STATUS"),
        )
    else:
        base = (
            base.withColumn("day_coverage", F.lit("FULL_DAY"))
            .withColumn("start_sec", F.lit(None).cast("int"))
            .withColumn("end_sec", F.lit(None).cast("int"))
        )
        partial = F.lit(False)
        errors = rules.codes(
            *common,
            (bad_end, "INVALID_END_DATE"),
            (F.col("absence_type").isNull(), "MISSING_AWAY_TYPE"),
            (~F.coalesce(status.isin(*AWAY_STATES), F.lit(False)), "INVALID_AWAY_STATUS"),
            (end.isNull() & ~F.coalesce(status == "ACTIVE", F.lit(False)), "OPEN_END_ONLY_FOR_ACTIVE_AWAY"),
        )
    keep_times = lambda name: F.when(partial, F.col(name)).cast("int")
    return (
        base.withColumn("_errors", errors)
        .withColumn("validation_codes", F.concat(advisory, F.col("_errors")))
        .withColumn("valid", F.size("_errors") == 0)
        .withColumn("start_sec", keep_times("start_sec"))
        .withColumn("end_sec", keep_times("end_sec"))
        .withColumn("overlay_eligible", overlay_eligible())
        .select(
            "source_key", "source_row", "source_kind", "client_id", "agent_name", "start_date",
            "end_date", "day_coverage", "start_sec", "end_sec", "absence_type", "record_status",
            "comment", "valid", "validation_codes", "overlay_eligible",
        )
    )


def overlay_eligible() -> Column:
    """FL-02."""
    status = F.col("record_status")
    open_state = F.when(F.col("source_kind") == "PTO", status == "APPROVED").otherwise(
        status.isin(*AWAY_OVERLAY_STATES)
    )
    return F.col("valid") & F.coalesce(open_state, F.lit(False))


def parse_time_off(
    roster: DataFrame, pto: DataFrame | None = None, away: DataFrame | None = None, id_is_text: bool = True
) -> DataFrame:
    """DQ-03 / JN-12 on the PTO and AWAY registers (each may be absent)."""
    parts = [
        _register_frame(raw, roster, kind, id_is_text)
        for kind, raw in (("PTO", pto), ("AWAY", away))
        if raw is not None
    ]
    if not parts:
        raise ValueError("no register was given")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def canonical_time_off(time_off: DataFrame) -> DataFrame:
    """FL-15 on register rows."""
    return time_off.filter("valid AND client_id IS NOT NULL").drop("valid", "validation_codes")


def unpivot_schedule(wide: DataFrame, date_columns: Sequence[str], also: Sequence[str] = ()) -> DataFrame:
    """SET-03: one row per filled cell of the wide schedule, with its column position.

    The position is that of the cell's own file: `header_cells` where files of
    several headers are united, else the order of the columns. `also` names
    columns of the agent's row that every cell keeps.
    """
    ids = [c for c in ("source_key", "source_row", "source_mtime", "Name", "Data Source IDs", *also) if c in wide.columns]
    table_columns = [c for c in wide.columns if c not in ("source_key", "source_row", "source_mtime", *also)]
    if "header_cells" not in wide.columns:
        wide = wide.withColumn("header_cells", F.array(*map(F.lit, table_columns)))
    identified = clean(F.col("Name")).isNotNull() | id_text(F.col("Data Source IDs")).isNotNull()
    long = wide.filter(identified).unpivot([*ids, "header_cells"], list(date_columns), "date_text", "raw_assignment")
    return (
        long.withColumn("raw_assignment", clean_cell(F.col("raw_assignment")))
        .filter(F.col("raw_assignment").isNotNull())
        .withColumn("source_column", F.array_position("header_cells", F.col("date_text")).cast("int"))
        .drop("header_cells")
        .withColumn("_day", clean_cell(F.col("date_text")))
        .withColumn("business_date", parse_header_date(F.col("_day"), is_clean=True))
        .drop("_day")
    )


def parse_schedule(wide: DataFrame, date_columns: Sequence[str], roster: DataFrame) -> DataFrame:
    """FL-07 / DQ-04..06: schedule cells with bounds, state, scope and codes."""
    # An agent is looked up once per row of the file, before its cells become rows.
    known = (
        wide.withColumn("agent_name", clean(F.col("Name")))
        .withColumn("_match_id", normalize_id(F.col("Data Source IDs")))
        .withColumn("source_agent_id", id_text(F.col("Data Source IDs")))
    )
    matched = match_agents(known, roster, agent_id="_match_id")
    also = ("agent_name", "_match_id", "source_agent_id", "_match")
    cells = unpivot_schedule(matched, date_columns, also).drop("Name", "Data Source IDs", "date_text")
    cells = on_day(cells, "_match_id")
    raw, day = F.col("raw_assignment"), F.col("business_date")
    off = F.upper(raw) == "OFF"
    span = F.col("_span")
    cells = (
        cells.withColumn("_span", rules.shift_span(raw))
        .withColumn("assignment", F.when(off, "Off").otherwise(rules.shift_assignment(raw, span)))
        .withColumn("scheduled_start", F.when(~off, rules.shift_bound(raw, 1, span)))
        .withColumn("scheduled_end", F.when(~off, rules.shift_bound(raw, 2, span)))
        .drop("_span")
    )
    start, end = F.col("scheduled_start"), F.col("scheduled_end")
    has_both = start.isNotNull() & end.isNotNull()
    errors = rules.codes(
        (~off & ~has_both, "MALFORMED_SHIFT_INTERVAL"),
        (has_both & (F.to_date(start) != day), "SHIFT_START_DATE_MISMATCH"),
        (has_both & (end <= start), "SHIFT_END_NOT_AFTER_START"),
        (has_both & ~F.to_date(end).between(day, F.date_add(day, 1)), "SHIFT_END_DATE_OUT_OF_RANGE"),
        (has_both & (end > start + F.expr("INTERVAL 24 HOURS")), "SHIFT_EXCEEDS_24_HOURS"),
    )
    cells = (
        cells.withColumn("validation_codes", errors)
        .withColumn("valid", F.size("validation_codes") == 0)
        .withColumn("schedule_state", F.when(off, "OFF").when(F.col("valid"), "SHIFT").otherwise("INVALID"))
        .withColumn("assignment_type", rules.assignment_type(raw, F.col("assignment")))
        .withColumn(
            "is_overnight",
            F.coalesce((F.col("schedule_state") == "SHIFT") & (F.to_date(end) > F.to_date(start)), F.lit(False)),
        )
        .withColumn("in_roster_scope", F.col("scope_match") != "none")
        .withColumn("name_fallback", (F.col("scope_match") == "name") & F.col("_match_id").isNotNull())
    )
    return cells.drop("_match_id")


def schedule_findings(cells: DataFrame) -> DataFrame:
    """DQ-04, DQ-05, DQ-06."""
    scope = rules.codes(
        (~F.col("in_roster_scope"), "SCHEDULE_OUTSIDE_EFFECTIVE_ROSTER"),
        (F.col("name_fallback"), "SCHEDULE_ID_NAME_FALLBACK"),
    )
    coded = cells.withColumn("_codes", F.concat(scope, F.col("validation_codes")))
    return row_findings(coded, SCHEDULE_SEVERITY, "_codes")


def canonical_schedule(cells: DataFrame) -> DataFrame:
    """FL-15 + WN-02: the winning valid cell per agent and date."""
    usable = cells.filter("valid AND in_roster_scope AND roster_client_id IS NOT NULL")
    return schedule_precedence(usable).select(
        "business_date", "roster_client_id", "source_agent_id", "agent_name", "assignment",
        "assignment_type", "scheduled_start", "scheduled_end", "schedule_state", "is_overnight",
        "scope_match", "source_key", "source_row", "source_column",
    )


def canonical_roster(roster: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """PR-01 / JN-11: valid agents, plus schedule ids that matched by name only."""
    columns = [
        "client_id", "employment_status", "agent_name", "team_leader", "ops_manager", "lob", "market",
        "language", "location", "city", "fte", "end_date", "source_key", "source_row",
    ]
    agents = valid_ids(roster).select(columns)
    if cells is not None:
        named = cells.filter("valid AND in_roster_scope AND scope_match = 'name'").select(
            "roster_client_id", F.struct("roster_key", "roster_row").alias("_agent"),
            F.struct("source_key", "source_row", "source_column").alias("_seen"),
        )
        first = named.groupBy("roster_client_id").agg(F.min_by("_agent", "_seen").alias("_agent"))
        extra = (
            first.join(agents.select("client_id"), F.col("roster_client_id") == F.col("client_id"), "left_anti")
            .join(
                roster.filter("valid").drop("client_id"),
                (F.col("_agent.roster_row") == F.col("source_row")) & (F.col("_agent.roster_key") == F.col("source_key")),
            )
            .withColumn("client_id", F.col("roster_client_id"))
            .select(columns)
        )
        agents = agents.unionByName(extra)
    return agents.withColumnRenamed("end_date", "eligible_through")


__all__ = [
    "canonical_roster", "canonical_schedule", "canonical_time_off", "keep_first", "mark_duplicates",
    "overlay_eligible", "parse_roster", "parse_schedule", "parse_time_off", "roster_findings",
    "schedule_findings", "unpivot_schedule",
]
