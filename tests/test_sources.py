"""Files in, canonical rows out."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from rotaspark.plans import actuals, calls, evidence, roster
from rotaspark.policy import ServiceRules, StatusPolicy
from rotaspark.sources import adapters, inventory, readers, writers

ROSTER = [
    # key, row, id, status, name, fte, end
    ("r", 2, "00417", "Active", "Ann Lee", "1", ""),
    ("r", 3, "00652", "Leaver", "Ida Moss", "0.35", "2026/08/01"),
    ("r", 4, "", "Active", "Zoë Fox", "", ""),
    ("r", 5, "00739", "Active", "Cat Ox", "1", ""),
    ("r", 6, "00739", "Leaver", "Cat Ox", "1", "2026-09-01"),
    ("r", 7, "00400", "Gone", "Dan", "x", ""),
]
ROSTER_DDL = "source_key string, source_row bigint, client_id string, employment_status string, agent_name string, fte string, end_date string"
MAPPING = [("queue", "STORM", "Q-1", "North FR", "main"), ("scope_rollup", "ANY", "north fr", "North", "")]
MAPPING_DDL = "mapping_type string, source_system string, source_value string, service_scope string, designation string"
CALL_HEADER = (
    "[Call Date/Time],[Call End Date/Time],[Call ID],[Call Reference Number],[Agent ID],[Agent],[Talk Time],[Hold Time],"
    "[Total Wrap Time],[Call Direction],[Total Queue Wait Time],[Ringing Duration],[Queue],[Transferred?]"
)


@pytest.fixture(scope="module")
def people(spark):
    return roster.parse_roster(spark.createDataFrame(ROSTER, ROSTER_DDL)).cache()


def test_roster_rules(spark, people):
    rows = {r.source_row: r for r in people.collect()}
    assert rows[2].valid and rows[2].client_id == "00417"
    assert rows[4].valid and rows[4].validation_codes == ["BLANK_CLIENT_ID"]
    assert rows[5].valid and not rows[6].valid
    assert rows[6].validation_codes == ["DUPLICATE_CLIENT_ID"]
    assert rows[7].validation_codes == ["UNKNOWN_EMPLOYMENT_STATUS", "INVALID_FTE"]
    found = {(f.issue_code, f.source_row) for f in roster.roster_findings(people).collect()}
    assert ("MISSING_FTE", 4) in found and ("DUPLICATE_CLIENT_ID", 5) in found


def test_calls_from_files(spark, people, tmp_path):
    mapping = readers.validate_mapping(spark.createDataFrame(MAPPING, MAPPING_DDL))
    lines = [
        CALL_HEADER,
        "08/01/2026 6:12:30 PM,08/01/2026 6:12:33 PM,ripe,1,,,,,,I,0:00:02,1,Q 1,No",  # gives up at once
        "08/01/2026 6:13:00 PM,,plum,2,,,,,,I,0:00:21,4,q-1,No",  # gives up inside the target
        '08/01/2026 6:14:10 PM,08/01/2026 6:15:40 PM,fig,3,8086,"Ann\nLee",0:01:05,12,13,I,6,,Q-1,Yes',  # unknown id, two-line name
        "08/01/2026 11:48:00 PM,08/01/2026 12:07:00 AM,pear,4,00417,Ann Lee,75,,,O,,,Else,",  # agent lane, past midnight
        "08/01/2026 7:30:00 PM,,lime,5,7777,Unseen,2,,,I,3,,Else,",  # outside
        "soon,,kiwi,6,00417,Ann Lee,2,,,I,3,,Q-1,",  # invalid start
        "08/01/2026 8:45:00 PM,,date,7,00417,Ann Lee,long,,,,3,,Q-1,",  # degraded
    ]
    folder = tmp_path / "calls"
    folder.mkdir()
    (folder / "one.CSV").write_text("﻿" + "\n".join(lines) + "\n", encoding="utf-8")
    (folder / "~$one.csv").write_text("x")
    files = inventory.inventory(spark, str(tmp_path), "calls", ".csv", "call_by_call")
    assert [(r.source_key, r.file_size > 0) for r in files.collect()] == [("calls/one.CSV", True)]
    raw = readers.read_calls(spark, str(tmp_path), [r.path for r in files.collect()])
    assert sorted(r.source_row for r in raw.collect()) == list(range(2, 9))
    lanes = calls.parse_calls(raw, people, mapping)
    by_id = {r.call_id: r for r in lanes.collect()}
    assert {k: r.lane for k, r in by_id.items()} == {
        "ripe": "accepted", "plum": "accepted", "fig": "accepted", "pear": "accepted", "lime": "outside", "kiwi": "invalid",
        "date": "accepted",
    }
    assert by_id["pear"].call_end == datetime(2026, 8, 2, 0, 7) and by_id["pear"].mapping_status == "UNMAPPED"
    assert by_id["date"].validation_codes == ["INVALID_DURATION", "MISSING_CALL_DIRECTION"]
    assert by_id["fig"].comparison_scope == "North"
    assert (by_id["fig"].scope_match, by_id["fig"].roster_client_id) == ("name", "8086")  # keeps the source's own id
    assert by_id["ripe"].scope_match == "queue"
    counts = calls.call_counters(lanes).first()
    assert (counts.accepted_rows, counts.outside_rows, counts.rejected_rows, counts.unmapped_rows) == (5, 1, 1, 1)
    out = calls.service_intervals(calls.canonical_calls(calls.accepted(lanes)), ServiceRules(30, 5))
    total = out.agg(*[F.sum(m).alias(m) for m in ("offered", "answered", "abandoned", "short_abandoned",
                                                  "abandoned_within_target", "answered_within_target", "handled_seconds")]).first()
    assert tuple(total) == (3, 1, 2, 1, 1, 1, 90)
    assert {r.language for r in out.collect()} == {"FR"}
    hours = evidence.flash_hours(out, evidence.FlashProfile("p", "P", date(2026, 1, 1), ("Q-1",)), date(2026, 8, 1))
    assert [r.offered for r in hours.collect()] == [2]
    nothing = evidence.flash_totals(out, evidence.FlashProfile("p", "P", date(2026, 1, 1), ("none",)), date(2026, 8, 1))
    assert nothing.first().offered is None


def test_newest_export_wins(spark):
    rows = [("k", datetime(2026, 8, 1), "a", 9, "old"), ("k", datetime(2026, 8, 2), "a", 2, "new"), ("k", datetime(2026, 8, 2), "B", 3, "tie")]
    df = spark.createDataFrame(rows, "call_key string, source_mtime timestamp, source_key string, source_row bigint, v string")
    assert [r.v for r in calls.canonical_calls(df).collect()] == ["new"]
    plan = calls.canonical_calls(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_schedule_and_precedence(spark, people, tmp_path):
    text = (
        "Name\tData Source IDs\t08/01/2026\t08/02/2026\t\n"
        "Ann Lee\t00417\t.ORG | Work 08/01/2026 10:00 PM-08/02/2026 6:00 AM\tOff\t\n"
        "Zoé Fox\t77\tWork 08/01/2026 8:00 AM-08/01/2026 4:00 PM\t\t\n"
        "Ida Moss\t00652\tOff\tOff\t\n"
    )
    (tmp_path / "s.txt").write_bytes(text.encode("cp1252"))
    wide, dates = readers.read_schedule(spark, str(tmp_path), [str(tmp_path / "s.txt")])
    assert dates == ["08/01/2026", "08/02/2026"]
    cells = roster.parse_schedule(wide, dates, people)
    got = {(r.agent_name, r.business_date.day): (r.scope_match, r.schedule_state, r.roster_client_id) for r in cells.collect()}
    assert got == {
        ("Ann Lee", 1): ("id", "SHIFT", "00417"), ("Ann Lee", 2): ("id", "OFF", "00417"), ("Zoé Fox", 1): ("name", "SHIFT", "77"),
        ("Ida Moss", 1): ("id", "OFF", "00652"), ("Ida Moss", 2): ("none", "OFF", None),
    }
    codes = sorted(f.issue_code for f in roster.schedule_findings(cells).collect())
    assert codes == ["SCHEDULE_ID_NAME_FALLBACK", "SCHEDULE_OUTSIDE_EFFECTIVE_ROSTER"]
    ids = {r.client_id for r in roster.canonical_roster(people, cells).collect()}
    assert ids == {"00417", "00652", "00739", "77"}
    (tmp_path / "d.txt").write_text("Name\tData Source IDs\t08/01/2026\t2026-08-01\n")
    with pytest.raises(readers.SourceError, match="repeats"):
        readers.read_schedule(spark, str(tmp_path), [str(tmp_path / "d.txt")])
    assert readers.sniff_schedule(["Name", "Data Source IDs", "08/01/2026"])
    assert not readers.sniff_schedule(["Name", "Data Source IDs", "Scheduling Period", "Shift Assignment", "Shift Events"])


def test_status_and_lilo(spark, people, tmp_path):
    (tmp_path / "status.csv").write_text(
        "[Serial Number],[Status],[Status Start Date and Time],[Agent],[Agent ID],[Status Duration],[Queue]\n"
        "1,Available,08/01/2026 08:00:00 AM,Ann Lee,00417,41:07:33,Q\n,Odd label,2026-08-01 09:00:00,Ann Lee,00417,60,Q\n"
        "3,Lunch,08/01/2026 10:00 AM,Ann Lee,00417,0:00:00,Q\n4,Lunch,08/01/2026 10:00 AM,Ghost,5,1:00,Q\n"
    )
    lanes = actuals.parse_status(readers.read_status(spark, str(tmp_path), [str(tmp_path / "status.csv")]), people, StatusPolicy())
    rows = {r.source_row: r for r in lanes.collect()}
    assert {k: r.lane for k, r in rows.items()} == {2: "accepted", 3: "accepted", 4: "invalid", 5: "outside"}
    assert rows[2].duration_seconds == 148053 and rows[2].actual_category == "Productive"
    assert rows[3].actual_category == "Auxiliary" and len(rows[3].serial_number) == 64
    codes = {(f.issue_code, f.row_count) for f in actuals.status_findings(lanes).collect()}
    assert codes == {("AGENT_STATUS_REJECTED_ROWS", 1), ("AGENT_STATUS_OUTSIDE_ROSTER_ROWS", 1), ("AGENT_STATUS_UNMAPPED_LABELS", 1)}
    (tmp_path / "lilo 2026-08-01.csv").write_text(
        "[Agent],[Agent ID],[First Log-on Time],[Last Log-off Time]\nAnn Lee,00417,,\nCat Ox,00739,8/1/2026 10:00 PM,8/1/2026 6:00 AM\n"
    )
    raw = readers.read_lilo(spark, str(tmp_path), [str(tmp_path / "lilo 2026-08-01.csv")])
    got = {r.roster_client_id: (r.extract_date, r.last_logout, r.overnight_adjusted) for r in actuals.accepted(actuals.parse_lilo(raw, people)).collect()}
    assert got == {
        "00417": (date(2026, 8, 1), None, False), "00739": (date(2026, 8, 1), datetime(2026, 8, 2, 6), True),
    }


def test_registers(spark, people):
    pto = spark.createDataFrame(
        [("r", 2, "00417", "2026-08-01", "2026-08-01", "Partial day", "08:00", "10:00", "Vacation", "Approved"),
         ("r", 3, "00417", "2026-08-01", "", "Full day", "", "", "", "Approved")],
        "source_key string, source_row bigint, client_id string, start_date string, end_date string, day_coverage string, "
        "start_time string, end_time string, absence_type string, record_status string",
    )
    away = spark.createDataFrame(
        [("r", 4, "00739", "2026-08-01", "", "Sick", "Active"), ("r", 5, "9", "2026-08-02", "", "Sick", "Planned")],
        "source_key string, source_row bigint, client_id string, start_date string, end_date string, absence_type string, record_status string",
    )
    rows = {r.source_row: r for r in roster.parse_time_off(people, pto, away).collect()}
    assert (rows[2].overlay_eligible, rows[2].start_sec, rows[2].end_sec) == (True, 28800, 36000)
    assert rows[3].validation_codes == ["INVALID_END_DATE", "MISSING_PTO_TYPE"]
    assert rows[4].overlay_eligible and rows[5].validation_codes == ["TIME_OFF_CLIENT_NOT_IN_ROSTER", "OPEN_END_ONLY_FOR_ACTIVE_AWAY"]


def test_roster_choice(spark):
    table = lambda *cols: spark.createDataFrame([], ", ".join(f"`{c}` string" for c in cols))
    full = table("Client ID", "Status", "Name", "TL", "LOB", "Market")
    assert [readers.roster_tier(t, full.columns) for t in ("FTE Count", "My roster 2", "Sheet1")] == [3, 2, 1]
    chosen = readers.choose_roster({"Agents": full, "Sheet1": full})
    assert "employment_status" in chosen.columns
    with pytest.raises(readers.SourceError, match="several"):
        readers.choose_roster({"Agents": full, "Roster": full})
    with pytest.raises(readers.SourceError, match="ambiguous"):
        readers.choose_roster({"Agents": table("Client ID", "Agent ID", "Status", "Name")})


def test_mapping_rules(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, MAPPING_DDL)
    with pytest.raises(ValueError, match="repeats"):
        readers.validate_mapping(frame([*MAPPING, ("queue", "storm", "q 1", "X", "")]))
    with pytest.raises(readers.SourceError, match="invalid"):
        readers.validate_mapping(frame([("other", "A", "B", "C", "")]))
    path = tmp_path / "m.csv"
    path.write_text("mapping_type,source_system,source_value,service_scope,designation\nqueue,STORM, Q-1 ,North FR,main\n")
    rows, digest = readers.read_queue_mapping(spark, str(path))
    assert rows.first().source_value == "Q-1" and len(digest) == 64


def test_writers_and_adapters(spark, tmp_path):
    df = spark.createDataFrame([(date(2026, 8, 1), 1), (date(2026, 8, 2), 2)], "business_date date, n int")
    path = writers.write_mart(df, str(tmp_path), "gold", "m", 1)
    writers.overwrite_dates(df.filter("n = 2").withColumn("n", F.lit(9)), path)
    assert {(r.business_date.day, r.n) for r in writers.read_mart(spark, str(tmp_path), "gold", "m", 1).collect()} == {(1, 1), (2, 9)}
    writers.export_csv(df.withColumn("a", F.array("n")), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    bounds = adapters.batch_bounds(df, "x").first()
    assert (bounds.min_business_date.day, bounds.max_business_date.day, bounds.source_type) == (1, 2, "x")
    registry = adapters.AdapterRegistry()
    registry.register(adapters.Adapter("x", "1", lambda k: k.endswith(".csv"), lambda d: d))
    assert registry.for_key("a.csv").source_type == "x" and registry.for_key("a.txt") is None
