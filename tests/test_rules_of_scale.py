"""Results that must not depend on depth, header sets, one bad cell, or the order of two writers."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from rotaspark.functions.temporal import add_seconds, duration_seconds
from rotaspark.operators.bounded import BoundExceededError
from rotaspark.plans import evidence, forecasting, refresh, roster, staffing
from rotaspark.schemas import SERVICE_MEASURES
from rotaspark.sources import readers


def test_lineage_has_no_depth_limit(spark):
    n = 1000
    gens = spark.range(1, n + 1).selectExpr("id AS generation_id", "CASE WHEN id > 1 THEN id - 1 END AS base_generation_id")
    chain = {r.generation_id: r.depth for r in refresh.lineage(gens, n - 10).collect()}
    assert chain == {n - 10 - d: d for d in range(n - 10)}
    assert {r.generation_id for r in refresh.lineage(gens, 1).collect()} == {1}


def test_absurd_durations_end_in_null(spark):
    df = spark.createDataFrame([("1e13",), ("9999999:00:00",), ("90061",), ("0:00:-5",), (None,)], "d string")
    start = F.lit("2026-03-04 10:00:00").cast("timestamp_ntz")
    rows = [r[0] for r in df.select(add_seconds(start, duration_seconds(F.col("d")))).collect()]
    assert rows[0] is None and rows[2] == datetime(2026, 3, 5, 11, 1, 1) and rows[4] is None
    assert rows[1].year == 3166


def test_columns_count_within_their_own_file(spark, tmp_path):
    for name, days in (("a.txt", ("03/01/2026", "03/02/2026")), ("b.txt", ("03/03/2026", "03/04/2026"))):
        (tmp_path / name).write_text("Name\tData Source IDs\t" + "\t".join(days) + "\nMia Orr\t00555\tOff\tOff\n")
    wide, dates = readers.read_schedule(spark, str(tmp_path), [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")])
    got = sorted((r.source_key, r.business_date.day, r.source_column) for r in roster.unpivot_schedule(wide, dates).collect())
    assert got == [("a.txt", 1, 3), ("a.txt", 2, 4), ("b.txt", 3, 3), ("b.txt", 4, 4)]


def test_headers_of_all_files_in_one_pass(spark, tmp_path):
    paths = []
    for i in range(6):
        (tmp_path / f"f{i}.csv").write_text(f"k,v{i % 2}\n1,2\n3,4\n" if i != 5 else 'k,v1\n1,"two\nlines"\n')
        paths.append(str(tmp_path / f"f{i}.csv"))
    found = readers.headers_of(spark, paths)
    assert [found[p] for p in paths] == [(["k", f"v{i % 2}"], i != 5) for i in range(6)]
    rows = readers.read_delimited(spark, str(tmp_path), paths).collect()
    assert len(rows) == 11 and {r.v1 for r in rows if r.source_key == "f5.csv"} == {"two\nlines"}


def test_affected_dates_take_old_and_new_ranges(spark):
    ddl = "source_type string, source_key string, date_from date, date_to date"
    active = spark.createDataFrame([("c", "old", date(2026, 3, 2), date(2026, 3, 2)), ("c", "gone", date(2026, 3, 10), date(2026, 3, 10))], ddl)
    now = spark.createDataFrame([("c", "old", date(2026, 3, 20), date(2026, 3, 20)), ("c", "new", date(2026, 4, 2), date(2026, 4, 2))], ddl)
    diff = spark.createDataFrame([("c", "old", "changed"), ("c", "gone", "removed"), ("c", "new", "added")], "source_type string, source_key string, change string")
    days = {r[0] for r in refresh.affected_dates(active, now, diff).collect()}
    assert days == {date(2026, 3, d) for d in (1, 2, 3, 9, 10, 11, 19, 20, 21)} | {date(2026, 4, d) for d in (1, 2, 3)}


def test_decision_without_intervals_stays(spark):
    decisions = spark.createDataFrame([(1, "North", datetime(2026, 3, 4, 10), 60), (2, "Nowhere", datetime(2026, 3, 4, 10), 60)],
                                      "decision_id long, service_scope string, decided_at timestamp_ntz, outcome_window_minutes int")
    intervals = spark.createDataFrame([("North", datetime(2026, 3, 4, 10, 15), datetime(2026, 3, 4, 10, 30), 10, 8)],
                                      "service_scope string, interval_start timestamp_ntz, interval_end timestamp_ntz, offered long, answered_within_target long")
    got = {r.decision_id: (r.outcome_offered, r.outcome_service_level) for r in staffing.decision_outcomes(decisions, intervals).collect()}
    assert got == {1: (10, 0.8), 2: (None, None)}


def test_risk_at_the_threshold_is_exact(spark):
    """Three agents short for a whole quarter, in pieces whose minutes have no exact binary form."""
    start = datetime(2026, 3, 4, 10)
    rows = spark.createDataFrame([("L", start, datetime(2026, 3, 4, 10, 15))], "service_scope string, start timestamp_ntz, end timestamp_ntz")
    cuts = [(0, 61), (61, 122), (122, 487), (487, 900)] * 4
    idle = spark.createDataFrame([("L", datetime(2026, 3, 4, 10, a // 60, a % 60), datetime(2026, 3, 4, 10, b // 60, b % 60)) for a, b in cuts],
                                 rows.schema)
    ladder = staffing.staffing_ladder(rows, rows.limit(0), rows.limit(0), idle)
    need = ladder.select("service_scope", "interval_start", F.lit(0.0).alias("required_productive_fte"))
    rated = staffing.risk_table(staffing.staffing_gap(ladder, need, ["service_scope", "interval_start"])).first()
    assert (rated.staffing_gap, rated.severity) == (-3.0, "critical")


def test_rolling_origin_season_is_not_the_horizon(spark):
    days = [(date(2026, 3, d), datetime(2026, 3, d, 10), float(d)) for d in range(1, 29)]
    history = spark.createDataFrame(days, "business_date date, interval_start timestamp_ntz, actual_volume double").withColumn("s", F.lit("x"))
    for horizon in (3, 7, 10):
        errors = forecasting.rolling_origin(history, ["s"], [date(2026, 3, 15)], horizon_days=horizon)
        naive = {r.business_date.day: r.forecast_volume for r in errors.where("model_id = 'seasonal_naive'").collect()}
        assert naive == {d: float(d - 7 if d < 22 else d - 14) for d in range(15, 15 + horizon)}
        mean = {r.forecast_volume for r in errors.where("model_id = 'recent_mean'").collect()}
        assert mean == {11.0}


def test_scenario_fte_reaches_supply_and_gap(spark):
    base = spark.createDataFrame([(100.0, 90.0, 8.0)], "offered double, aht_seconds double, effective_fte double")
    row = staffing.apply_scenarios(base, [{"name": "s", "volume_multiplier": 1, "aht_delta_seconds": 0, "additional_fte": 3, "shrinkage": 0.2}]).first()
    assert (row.scenario_effective_fte, row.scenario_staffing_gap) == (11.0, 1.0)


def test_two_writers_leave_one_pointer(spark, tmp_path):
    one, two = (refresh.GenerationStore(spark, str(tmp_path)) for _ in range(2))
    a, b = one.start("cat", "m1"), two.start("cat", "m1")
    assert a != b
    raced = []

    def publish(generation):
        raced.append(generation)
        if generation == a:
            two.activate(b)

    with pytest.raises(refresh.RefreshError, match="moved by another"):
        one.activate(a, publish)
    assert one.active_id() == b
    assert {r.generation_id for r in one.generations().where("status = 'succeeded'").collect()} == {b}
    assert two.roll_back(b) is None and one.active_id() is None


@pytest.mark.parametrize("text", ["2026-3-04", "2026-02-30", "20260304", "", None])
def test_business_day_refuses(text):
    with pytest.raises(evidence.QueryError):
        evidence.business_day(text)


def test_scope_pair():
    assert evidence.scope_pair(None, None) is None and evidence.scope_pair("a", "b") == ("a", "b")
    for bad in (("a", None), (None, "b"), ("", "b"), ("a\n", "b"), ("x" * 1000, "b")):
        with pytest.raises(evidence.QueryError):
            evidence.scope_pair(*bad)


def test_evidence_page_and_profile(spark):
    """PR-07 and PR-08 on a day of two scopes, without evidence of another day."""
    at = lambda m: datetime(2026, 3, 4, 10, m)
    rows = [(date(2026, 3, 4), at(m), at(m + 15), s, s, "Q-1") for m in (0, 15) for s in ("South", "North")]
    ddl = "business_date date, interval_start timestamp_ntz, interval_end timestamp_ntz, service_scope string, comparison_scope string, queue string"
    intervals = spark.createDataFrame(rows, ddl).withColumns({m: F.lit(2).cast("long") for m in SERVICE_MEASURES})
    days = spark.createDataFrame([(date(2026, 3, 4), "COMPLETE")] * 3, "business_date date, evidence_state string")
    gaps = spark.createDataFrame([(date(2026, 3, 4), "LATE", 7), (date(2026, 3, 5), "LATE", 9)], "business_date date, gap_type string, gap_minutes long")
    page = evidence.operate_evidence(intervals, days, gaps, "2026-03-04")
    assert [r.service_scope for r in page["scopes"].collect()] == ["North", "South"]
    assert [(r.interval_start.minute, r.service_scope, r.offered) for r in page["intervals"].collect()] == [(0, "North", 2), (15, "North", 2)]
    assert [tuple(r) for r in page["states"].collect()] == [(date(2026, 3, 4), "COMPLETE", 3)]
    assert [tuple(r)[1:] for r in page["gaps"].collect()] == [("LATE", 1, 7)]
    assert evidence.operate_evidence(intervals, days, gaps, "2026-03-06")["intervals"].count() == 0
    assert evidence.default_scope(intervals, date(2026, 3, 4)) == ("North", "North")
    with pytest.raises(evidence.QueryError):
        evidence.operate_evidence(intervals, days, gaps, "2026-03-04", "East", "East")
    many = intervals.crossJoin(spark.range(200).selectExpr("cast(id as string) AS n")).withColumn("service_scope", F.col("n"))
    with pytest.raises(BoundExceededError):
        evidence.operate_evidence(many.drop("n"), days, gaps, "2026-03-04")
    profile = evidence.FlashProfile("p", "P", date(2026, 1, 1), ("q-1",))
    parity = evidence.flash_parity(intervals, [profile], "2026-03-04")
    assert [r.offered for r in parity["hours"].collect()] == [8] and parity["totals"].first().offered == 8
    assert evidence.flash_parity(intervals, [profile], "2026-03-07")["totals"].first().offered is None
