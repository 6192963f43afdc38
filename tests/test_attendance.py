"""Agent-day verdicts on small hand-made evidence."""

from datetime import date, datetime

import pytest

from rotaspark import schemas
from rotaspark.plans import attendance as att
from rotaspark.policy import AttendancePolicy, PolicyError

DAY = date(2026, 8, 1)


def at(text):
    return datetime.fromisoformat(text) if text else None


def shift(agent, start="2026-08-01T08:00", end="2026-08-01T16:00", kind="Work", state="SHIFT", day=DAY):
    return (day, agent, agent, f"Agent {agent}", kind, kind, at(start), at(end), state, False, "id", "s.txt", 2, 3)


def status(agent, category, start, end, row=2, key="status.csv"):
    start, end = at(start), at(end)
    seconds = int((end - start).total_seconds())
    return (key, row, str(row), start.date(), agent, agent, agent, category, category, start, end, seconds, "Q", "id")


def lilo(agent, first, last, row=2, day=DAY):
    return ("lilo.csv", row, day, agent, agent, agent, at(first), at(last), at(last), False, "id")


def off(agent, kind="AWAY", coverage="FULL_DAY", start=DAY, end=DAY, secs=(None, None), row=2):
    return ("fte", row, kind, agent, agent, start, end, coverage, *secs, "Vacation", "APPROVED", None, True, [], True)


def build(spark, shifts, statuses=(), lilos=(), offs=(), as_of="2026-08-02T12:00", policy=None):
    model = att.attendance_model(
        spark.createDataFrame(list(shifts), schemas.SCHEDULE_SHIFT),
        spark.createDataFrame(list(statuses), schemas.RAW_AGENT_STATUS),
        spark.createDataFrame(list(lilos), schemas.RAW_LILO),
        spark.createDataFrame(list(offs), schemas.RAW_FTE_TIME_OFF),
        policy or AttendancePolicy(),
        at(as_of),
    )
    days = {r.roster_client_id: r for r in att.agent_days(model).collect()}
    gaps = att.attendance_gaps(model).collect()
    return days, gaps


def test_one_day_of_a_team(spark):
    """One agent per rule: late with a pause off line, early, absent, unknown, partly off, away, both ends short."""
    day, late_shift = lambda t: f"2026-08-01T{t}", ("2026-08-01T21:00", "2026-08-02T05:30")
    team = ["ines", "marc", "olga", "pavel", "rosa", "uwe"]
    shifts = [shift(a, day("09:30"), day("18:00")) for a in team] + [shift("tom", *late_shift)]
    statuses = [
        status("ines", "Productive", day("09:37"), day("13:05"), 11),
        status("ines", "Logged Off", day("13:05"), day("13:30"), 12),
        status("ines", "Productive", day("13:30"), day("18:00"), 13),
        status("uwe", "Productive", day("10:10"), day("17:00"), 14),
        status("marc", "Productive", day("11:00"), day("11:45"), 15),
    ]
    lilos = [
        lilo("marc", day("09:28"), day("17:39"), 21),
        lilo("olga", None, None, 22),
        lilo("rosa", day("12:30"), day("18:00"), 23),
        lilo("uwe", day("09:30"), day("18:00"), 24),
    ]
    offs = [off("tom"), off("rosa", "PTO", "PARTIAL_DAY", secs=(9 * 3600 + 1800, 12 * 3600 + 1800))]
    days, gaps = build(spark, shifts, statuses, lilos, offs)
    short = {a: (r.late_minutes, r.early_leave_minutes, r.no_show_minutes) for a, r in days.items()}
    assert short == {
        "ines": (7, 0, 0), "marc": (0, 21, 0), "olga": (0, 0, 510), "pavel": (0, 0, 0), "rosa": (0, 0, 0),
        "tom": (0, 0, 0), "uwe": (40, 60, 0),
    }
    named = {a: r.attendance_result for a, r in days.items()}
    assert (named["ines"], named["marc"], named["olga"]) == ("Late", "Early leave", "No show")
    assert (named["pavel"], named["rosa"]) == ("Missing actual evidence", "Present - partial time off")
    assert (named["tom"], named["uwe"]) == ("Planned absence", "Late + early leave")
    assert {a for a, r in days.items() if r.status_is_primary} == {"ines", "uwe"}
    assert days["uwe"].status_coverage_ratio == pytest.approx(410 / 510)
    work = {a: (days[a].planned_work_minutes, days[a].planned_time_off_minutes) for a in ("rosa", "tom")}
    assert work == {"rosa": (330, 180), "tom": (0, 510)}
    assert days["pavel"].evidence_state == "UNKNOWN" and days["marc"].actual_evidence == "LILO+AGENT_STATUS"
    found = sorted((g.roster_client_id, g.gap_type, g.gap_minutes) for g in gaps)
    assert found == [
        ("ines", "LATE", 7), ("ines", "LOGGED_OFF", 25), ("marc", "EARLY_LEAVE", 21), ("olga", "NO_SHOW", 510),
        ("uwe", "EARLY_LEAVE", 60), ("uwe", "LATE", 40),
    ]
    pause = next(g for g in gaps if g.gap_type == "LOGGED_OFF")
    assert (pause.gap_start, pause.gap_end) == (at(day("13:05")), at(day("13:30")))


def test_blank_lilo_row_wins_over_presence_in_status(spark):
    days, gaps = build(
        spark,
        [shift("A")],
        [status("A", "Productive", "2026-08-01T08:00", "2026-08-01T16:00")],
        [lilo("A", None, None)],
    )
    assert days["A"].attendance_result == "No show"
    assert days["A"].no_show_minutes == 480
    assert [g.gap_type for g in gaps] == ["NO_SHOW"]


def test_running_shift_is_provisional(spark):
    statuses = [status("A", "Productive", "2026-08-01T08:30", "2026-08-01T12:00")]
    days, gaps = build(spark, [shift("A"), shift("B")], statuses, as_of="2026-08-01T12:00")
    assert days["A"].attendance_result == "Late - shift in progress"
    assert days["A"].evidence_state == "PROVISIONAL"
    assert [(g.gap_type, g.is_provisional) for g in gaps] == [("LATE", True)]
    assert days["B"].attendance_result == "Shift in progress"
    early, none = build(spark, [shift("A")], statuses, as_of="2026-08-01T07:00")
    assert early["A"].attendance_result == "Not started" and none == []


def test_only_logged_off_status_proves_no_show(spark):
    statuses = [status("A", "Logged Off", "2026-08-01T07:00", "2026-08-01T17:00")]
    days, gaps = build(spark, [shift("A")], statuses)
    assert days["A"].attendance_result == "No show"
    assert {g.gap_type for g in gaps} == {"NO_SHOW"}


def test_off_day_and_missing_sources(spark):
    days, gaps = build(spark, [shift("A", None, None, "Off", "OFF"), shift("B")])
    assert days["A"].attendance_result == "Off" and days["A"].source_keys_json == "[]"
    assert days["B"].attendance_result == "Data not loaded"
    assert gaps == []


def test_bad_bounds_fail(spark):
    with pytest.raises(Exception, match="invalid bounds"):
        build(spark, [shift("A", "2026-08-01T16:00", "2026-08-01T08:00")])


def test_policy_limits():
    for bad in ({"late_tolerance_minutes": -1}, {"minimum_status_coverage": 0.0}, {"status_gap_tolerance_minutes": True}):
        with pytest.raises(PolicyError):
            AttendancePolicy(**bad)
