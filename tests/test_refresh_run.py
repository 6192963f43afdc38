"""The whole refresh over a folder of extracts: first load, nothing new, corrections, a way back, failures."""

import os
from datetime import date, datetime

import pytest

from rotaspark.operators.quality import QualityGateError
from rotaspark.plans import refresh
from rotaspark.plans import refresh_run as rr
from rotaspark.policy import ServiceRules
from rotaspark.sources import readers

CALLS = "[Call Date/Time],[Call End Date/Time],[Call ID],[Call Reference Number],[Agent ID],[Agent],[Talk Time],[Hold Time],[Total Wrap Time],[Call Direction],[Total Queue Wait Time],[Ringing Duration],[Queue],[Transferred?]"
_CLOCK = iter(range(1_700_000_000, 1_800_000_000, 60))


def put(root, name, text, encoding="utf-8"):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    stamp = next(_CLOCK)
    os.utime(path, (stamp, stamp))


def call(day, number, agent="00417", queue="Q-1"):
    return f"03/{day:02d}/2026 10:0{number}:00 AM,03/{day:02d}/2026 10:0{number}:40 AM,c{day}-{number},r{day}-{number},{agent},Ann Lee,0:00:20,0:00:05,0:00:05,I,0:00:03,1,{queue},No"


def calls_of(day, n, **kw):
    return "\n".join([CALLS, *[call(day, i, **kw) for i in range(n)]]) + "\n"


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    put(root, "roster/Agents.csv", "Client ID,Name,Status,FTE,End Date,LOB\n00417,Ann Lee,Active,1,,Care\n00652,Bob Ray,Active,1,,Care\n")
    put(root, "roster/PTO.csv", "Client ID,Start Date,End Date,Day Coverage,Start Time,End Time,PTO Type,Approval Status\n00652,2026-03-05,2026-03-05,FULL_DAY,,,Leave,APPROVED\n")
    put(
        root, "plan/week.txt",
        "Name\tData Source IDs\t03/04/2026\t03/05/2026\nAnn Lee\t00417\tWork 03/04/2026 9:30 AM-03/04/2026 6:00 PM\tOff\n"
        "Bob Ray\t00652\tWork 03/04/2026 9:30 AM-03/04/2026 6:00 PM\tWork 03/05/2026 9:30 AM-03/05/2026 6:00 PM\n",
        "cp1252",
    )
    put(
        root, "actuals/lilo.csv",
        "[Agent ID],[Agent],[First Log-on Time],[Last Log-off Time]\n00417,Ann Lee,03/04/2026 9:45:00 AM,03/04/2026 6:00:00 PM\n",
    )
    for day in (4, 9, 20):
        put(root, f"calls/d{day:02d}.csv", calls_of(day, 2))
    put(root, "calls/readme.csv", "just,some\nother,file\n")
    (tmp_path / "mapping.csv").write_text("mapping_type,source_system,source_value,service_scope,designation\nqueue,STORM,Q-1,North,main\n")
    return tmp_path


def policies(folder, **kw):
    return rr.RefreshPolicies(str(folder / "mapping.csv"), datetime(2026, 3, 30), **kw)


def offered(store):
    rows = store.read_active("mart", "service_interval").groupBy("business_date", "service_scope").sum("offered").collect()
    return {(r[0].day, r[1]): r[2] for r in rows}


def test_refresh_from_folder_to_pointer(spark, folder, monkeypatch):
    root, store = str(folder / "in"), refresh.GenerationStore(spark, str(folder / "store"))
    run = lambda **kw: rr.run_refresh(spark, root, store, policies(folder, **kw))

    first = run()
    assert (first.generation_id, first.read_sources, first.reused_sources, first.rebuilt_dates) == (1, 7, 0, None)
    assert offered(store) == {(4, "North"): 2, (9, "North"): 2, (20, "North"): 2}
    days = {(r.roster_client_id, r.business_date.day): r.attendance_result for r in store.read_active("mart", "attendance_agent_day").collect()}
    assert days["00417", 4] == "Late" and days["00652", 5] == "Planned absence" and days["00417", 5] == "Off"
    sources = {r.source_key: (r.source_type, r.row_count, r.date_from) for r in store.manifest().collect()}
    assert sources["calls/d09.csv"] == ("call_by_call", 2, date(2026, 3, 9)) and "calls/readme.csv" not in sources
    assert {t for t, _, _ in sources.values()} == {"fte_roster", "pto_register", "published_schedule", "lilo", "call_by_call"}

    again = run()
    assert (again.generation_id, again.changed) == (1, False)

    original = (folder / "in/calls/d09.csv").read_text()
    put(folder / "in", "calls/d09.csv", calls_of(9, 5))
    second = run()
    assert (second.read_sources, second.reused_sources, second.rebuilt_dates) == (1, 6, 1)
    assert offered(store) == {(4, "North"): 2, (9, "North"): 5, (20, "North"): 2}

    put(folder / "in", "calls/d09.csv", original)  # A -> B -> A: the first generation's rows serve again
    with monkeypatch.context() as m:
        m.setattr(readers, "read_delimited", lambda *a, **k: pytest.fail("a raw file was read"))
        third = run()
        assert (third.read_sources, third.rebuilt_dates) == (0, 1) and offered(store)[9, "North"] == 2
        owner = store.manifest().where(f"generation_id = {third.generation_id} AND source_key = 'calls/d09.csv'").first()
        assert owner.bronze_generation_id == 1

        (folder / "mapping.csv").write_text("mapping_type,source_system,source_value,service_scope,designation\nqueue,STORM,Q-1,South,main\n")
        mapped = run(service=ServiceRules(20, 2))
        assert (mapped.read_sources, mapped.rebuilt_dates) == (0, None)
        assert set(offered(store)) == {(4, "South"), (9, "South"), (20, "South")}

    (folder / "in/calls/d20.csv").unlink()
    gone = run(service=ServiceRules(20, 2))
    assert gone.rebuilt_dates == 1 and set(offered(store)) == {(4, "South"), (9, "South")}
    assert {r.source_key for r in store.active_sources().collect()} >= {"calls/d04.csv"}
    assert "calls/d20.csv" not in {r.source_key for r in store.active_sources().collect()}

    active = store.active_id()
    put(folder / "in", "plan/week.txt", "Name\tData Source IDs\t03/04/2026\nAnn Lee\t00417\tWork 03/04/2026 6:00 PM-03/04/2026 9:30 AM\n", "cp1252")
    with pytest.raises(QualityGateError):
        run(service=ServiceRules(20, 2))
    assert store.active_id() == active and store.latest().first().status == "failed"


def test_short_bronze_is_read_again(spark, folder):
    root, store = str(folder / "in"), refresh.GenerationStore(spark, str(folder / "store"))
    rr.run_refresh(spark, root, store, policies(folder))
    bronze = folder / "store/bronze/lilo/generation_id=1"
    spark.read.parquet(str(bronze)).limit(0).write.mode("overwrite").parquet(str(folder / "cut"))
    for part in bronze.glob("*/*.parquet"):
        part.write_bytes(next((folder / "cut").glob("*.parquet")).read_bytes())
    for crc in bronze.glob("*/.*.crc"):
        crc.unlink()
    put(folder / "in", "calls/d21.csv", calls_of(21, 1))
    result = rr.run_refresh(spark, root, store, policies(folder))
    assert result.read_sources == 2  # the new file, and the one whose rows are gone
    assert store.read_active("mart", "lilo").count() == 1


def test_a_source_that_moves_fails_the_refresh(spark, folder, monkeypatch):
    root, store = str(folder / "in"), refresh.GenerationStore(spark, str(folder / "store"))
    write = rr.bronze.write

    def moving(*args):
        put(folder / "in", "calls/d04.csv", calls_of(4, 3))
        return write(*args)

    monkeypatch.setattr(rr.bronze, "write", moving)
    with pytest.raises(refresh.RefreshError, match="while it was read"):
        rr.run_refresh(spark, root, store, policies(folder))
    assert store.active_id() is None and store.latest().first().status == "failed"


STATUS = "[Agent ID],[Agent],[Status],[Status Start Date and Time],[Status Duration],[Queue],[Serial Number]"


def rows_of(store, mart):
    found = store.read_active("mart", mart)
    return [] if found is None else sorted(repr(sorted(r.asDict().items())) for r in found.collect())


def test_work_follows_the_change(spark, folder, monkeypatch):
    """One corrected file of many: only its dates are opened and written, and all rows are those of a full rebuild."""
    root, store = str(folder / "in"), refresh.GenerationStore(spark, str(folder / "store"))
    put(folder / "in", "actuals/s4.csv", "\n".join([
        STATUS, "00417,Ann Lee,Available,03/04/2026 9:45:00 AM,7:00:00,,1", "00652,Bob Ray,Available,03/04/2026 9:30:00 AM,30:00:00,,2", "",
    ]))
    put(folder / "in", "actuals/s9.csv", "\n".join([STATUS, "00417,Ann Lee,Available,03/09/2026 9:45:00 AM,7:00:00,,1", ""]))
    for day in range(10, 19):
        put(folder / "in", f"calls/d{day:02d}.csv", calls_of(day, 2))
    opened, written = [], []
    read, write = rr.bronze.read, rr.writers.write_mart
    monkeypatch.setattr(rr.bronze, "read", lambda s, r, kind, c, places: opened.extend((kind, p) for p in places) or read(s, r, kind, c, places))
    monkeypatch.setattr(rr.writers, "write_mart", lambda rows, r, layer, name, number, by: written.append(name) or write(rows, r, layer, name, number, by))

    def run(**kw):
        opened.clear(), written.clear()
        return rr.run_refresh(spark, root, store, policies(folder, **kw))

    def same_as_full(name, **kw):
        full = refresh.GenerationStore(spark, str(folder / name))
        rr.run_refresh(spark, root, full, policies(folder, **kw))
        for mart in rr.BY_NAME:
            assert rows_of(store, mart) == rows_of(full, mart), mart
        assert {r.source_key: (r.date_from, r.date_to) for r in store.active_sources().join(store.manifest(), ["source_key", "generation_id"]).collect()}
        numbers = lambda s: dict(s.control("generation_summary", refresh.GENERATION_SUMMARY).where(f"generation_id = {s.active_id()}").select("measure", "value").collect())
        assert numbers(store) == numbers(full) and len(numbers(full)) == 17
        issues = lambda s: sorted(str((r.issue_code, r.source_key, r.source_row)) for r in s.issues().where(f"generation_id = {s.active_id()}").collect())
        assert issues(store) == issues(full)

    run()
    put(folder / "in", "calls/d12.csv", calls_of(12, 4))
    put(folder / "in", "actuals/s4.csv", "\n".join([
        STATUS, "00417,Ann Lee,Available,03/04/2026 10:45:00 AM,6:00:00,,1", "00652,Bob Ray,Available,03/04/2026 9:30:00 AM,31:00:00,,2", "bad,row,x,y,z,,3", "",
    ]))
    second = run()
    days = lambda *n: frozenset(date(2026, 3, d) for d in n)
    assert second.scopes["call_leg"] == second.scopes["service_interval"] == days(12)
    assert second.scopes["agent_status"] == days(4) and second.scopes["attendance_gap"] == days(3, 4, 5, 6)
    assert second.scopes["schedule_shift"] == second.scopes["lilo"] == second.scopes["time_off"] == frozenset()
    facts = {p for p in opened if p[0] in ("call_by_call", "agent_status", "lilo", "published_schedule")}
    assert facts == {("call_by_call", (2, date(2026, 3, 12))), ("agent_status", (2, date(2026, 3, 4))), ("agent_status", (2, None))}
    parts = {(r.mart, r.part_date, r.owner_generation_id) for r in store.parts(2).collect()}
    assert {(m, d) for m, d, owner in parts if owner == 2} <= {("call_leg", *days(12)), ("service_interval", *days(12)), ("agent_status", *days(4))} | {
        (m, d) for m in ("attendance_agent_day", "attendance_gap") for d in days(3, 4, 5, 6)
    }
    assert ("call_leg", date(2026, 3, 11), 1) in parts
    same_as_full("full-2")
    legs = store.read_active("mart", "call_leg").where("business_date = date'2026-03-12'")
    assert len(legs.inputFiles()) and all("generation_id=2/business_date=2026-03-12" in f or "generation_id=1" in f for f in legs.inputFiles())

    rules = {"service": ServiceRules(30, 1)}
    third = run(**rules)
    assert {m for m, s in third.scopes.items() if s} == {"service_interval"} == set(written)
    assert not [p for p in opened if p[0] in ("call_by_call", "agent_status", "lilo", "published_schedule")]
    health = {r.source: (r.ready, r.file_count, r.row_count) for r in rr.published_health(store, store.latest().first().catalog_sha256).collect()}
    assert health["callByCall"] == (True, 12, 26) and health["attendance"][0] and health["roster"] == (True, 1, 2)
    assert {r.overall_status for r in rr.published_health(store, "other").collect()} == {"source_changed"}
    same_as_full("full-3", **rules)
    assert store.roll_back(3) == 2 and len(rows_of(store, "call_leg")) == 26


def test_causes_and_dates():
    from rotaspark.plans.causes import ALL, scopes

    of = lambda changed, **types: {m: s for m, s in scopes(set(changed), types).items() if s}
    day = date(2026, 3, 9)
    assert of([]) == {}
    assert of(["service_rules"]) == {"service_interval": ALL}
    assert set(of(["mapping"])) == {"call_leg", "service_interval"}
    assert set(of(["registers"])) == {"time_off", "attendance_agent_day", "attendance_gap"}
    assert set(of(["status_policy"])) == {"agent_status", "attendance_agent_day", "attendance_gap"}
    assert set(of(["attendance_policy"])) == {"attendance_agent_day", "attendance_gap"}
    assert set(of(["roster"]).values()) == {ALL} and set(of(["roster"])) == set(rr.BY_NAME)
    late = of([], agent_status={day: 2})
    assert late["agent_status"] == {day} and sorted(d.day for d in late["attendance_gap"]) == [8, 9, 10, 11, 12]
    plan = of([], published_schedule={day: 0})
    assert plan["attendance_agent_day"] == {day} and plan["agent_roster"] == {day}
    assert scopes(set(), {}, frozenset({day}))["attendance_gap"] == {day}
    mixed = of(["service_rules"], call_by_call={day: 0})
    assert mixed == {"call_leg": {day}, "service_interval": ALL}
