"""Generations on Parquet, and streams against their batch results."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from rotaspark.operators.bounded import BoundExceededError, at_most
from rotaspark.operators.quality import QualityGateError
from rotaspark.plans import refresh
from rotaspark.plans.calls import service_intervals
from rotaspark.policy import ServiceRules
from rotaspark.sources import writers
from rotaspark.streaming import calls as sc

T = datetime(2026, 8, 1)


def version(spark, key="a.csv", sha="s1", rows=2, owner=None, kind="call_by_call", state="present", mtime=T):
    ddl = ("source_type string, source_key string, state string, file_size bigint, mtime timestamp, content_sha256 string, "
           "adapter_version string, policy_fingerprint string, row_count bigint, bronze_generation_id bigint, date_from date, date_to date")
    return spark.createDataFrame([(kind, key, state, 10, mtime, sha, "v1", "p1", rows, owner, date(2026, 8, 1), date(2026, 8, 2))], ddl)


def finding(spark, severity):
    ddl = "issue_code string, severity string, source_key string, source_row bigint, source_column bigint, details string"
    return spark.createDataFrame([("X", severity, "a.csv", None, None, "d")], ddl)


def test_generations_publish_fail_and_roll_back(spark, tmp_path):
    store = refresh.GenerationStore(spark, str(tmp_path))
    assert store.active_id() is None and store.read_active("gold", "m") is None
    mart = spark.createDataFrame([(date(2026, 8, 1), 1)], "business_date date, n int")
    publish = lambda n: lambda g: writers.write_mart(mart.withColumn("n", F.lit(n)), str(tmp_path), "gold", "m", g)
    first = store.start("cat", "m1")
    store.record_sources(first, version(spark, owner=first))
    store.record_issues(first, finding(spark, "warning"))
    store.activate(first, publish(1))
    second = store.start("cat", "m1")
    store.record_sources(second, version(spark, "b.csv", "s2", owner=second).unionByName(version(spark, state="removed")))
    store.activate(second, publish(2))
    assert store.active_id() == second and store.read_active("gold", "m").first().n == 2
    assert [r.source_key for r in store.active_sources().collect()] == ["b.csv"]
    blocked = store.start("cat", "m1")
    store.record_issues(blocked, finding(spark, "error"))
    with pytest.raises(QualityGateError):
        store.activate(blocked, publish(3))
    store.fail(blocked, "blocked")
    broken = store.start("cat", "m1")
    with pytest.raises(ZeroDivisionError):
        store.activate(broken, lambda g: 1 // 0)
    assert store.active_id() == second
    assert store.roll_back(second) == first and store.read_active("gold", "m").first().n == 1
    with pytest.raises(refresh.RefreshError, match="changed since"):
        store.activate(broken, publish(4))
    assert {r.severity: r.finding_count for r in store.severity_counts(first).collect()} == {"info": 0, "warning": 1, "error": 0}
    assert store.latest().first().generation_id == broken


def test_reuse_and_unchanged(spark):
    gens = spark.createDataFrame(
        [(1, "succeeded"), (2, "succeeded"), (3, "failed")], "generation_id bigint, status string"
    ).selectExpr("*", "'cat' AS catalog_sha256", "'m' AS model_version", "cast(null AS bigint) AS base_generation_id")
    of = lambda g, df: df.withColumn("generation_id", F.lit(g).cast("bigint"))
    roster = version(spark, "r", "roster", 1, 1, "fte_roster")
    manifest = of(1, version(spark, sha="A", owner=1)).unionByName(of(1, roster))
    for g, sha in ((2, "B"), (3, "C")):
        manifest = manifest.unionByName(of(g, version(spark, sha=sha, owner=g, mtime=datetime(2026, 8, g)))).unionByName(of(g, roster))
    want = lambda sha, mtime=T: version(spark, sha=sha, mtime=mtime).drop("row_count", "bronze_generation_id", "state").selectExpr(
        "*", "'cat' AS catalog_sha256", "'m' AS model_version")
    owner = lambda sha, ros=roster, mtime=T: [
        r.bronze_generation_id for r in refresh.reusable_bronze(want(sha, mtime), manifest, gens, ros, 2).collect()
    ]
    assert owner("A") == [1]  # A -> B -> A
    assert owner("not hashed", mtime=datetime(2026, 8, 2)) == [2]  # metadata match in the active generation
    assert owner("C") == []  # only a failed generation has it
    assert owner("A", version(spark, "r", "other roster", 1, 1, "fte_roster")) == []
    contracts = spark.createDataFrame([("call_by_call", "v1", "p1")], "source_type string, adapter_version string, policy_fingerprint string")
    active = version(spark)
    now = active.select("source_type", "source_key", "file_size", "mtime")
    assert refresh.unchanged(active, now, contracts).first()[0] is True
    assert refresh.unchanged(active, now.withColumn("file_size", F.lit(11).cast("bigint")), contracts).first()[0] is False
    assert refresh.unchanged(active, now, contracts.withColumn("policy_fingerprint", F.lit("p2"))).first()[0] is False
    bronze = spark.createDataFrame([(1, "a.csv")], "generation_id bigint, source_key string")
    short = refresh.staged_counts(of(1, version(spark, owner=1)), bronze).collect()
    assert [(r.row_count, r.bronze_rows) for r in short] == [(2, 1)]
    days = refresh.affected_dates(active, active.limit(0), spark.createDataFrame([("call_by_call", "a.csv", "changed")], "source_type string, source_key string, change string"))
    assert sorted(r[0].day for r in days.collect()) == [1, 2, 3, 31]


def test_bound_fails_closed(spark):
    assert at_most(spark.range(3), 3, "x").count() == 3
    with pytest.raises(BoundExceededError):
        at_most(spark.range(4), 3, "x")


LEGS = ("call_key string, call_start timestamp_ntz, business_date date, service_eligible boolean, service_scope string, comparison_scope string, "
        "queue string, language string, source_agent_id string, talk_seconds bigint, hold_seconds bigint, wrap_seconds bigint, "
        "queue_wait_seconds bigint, ringing_seconds bigint, transferred boolean, source_mtime timestamp, source_key string, source_row bigint, designation string")


def legs(spark, numbers, key="a", mtime=T):
    rows = [
        (f"k{n}", datetime(2026, 8, 1 + n % 2, 10, n % 60), date(2026, 8, 1 + n % 2), n % 3 != 0, "North", "North", "Q", "fr",
         None if n % 4 == 0 else "7", n, 0, 0, n % 40, 1, False, mtime, key, n, "D" if n % 5 else None)
        for n in numbers
    ]
    return spark.createDataFrame(rows, LEGS)


def test_streams_equal_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    legs(spark, range(40)).write.mode("append").parquet(src)
    legs(spark, range(20, 60), "b", datetime(2026, 8, 3)).write.mode("append").parquet(src)
    stream = spark.readStream.schema(LEGS).parquet(src)
    query = sc.start_ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    got = {(r.call_key, r.source_key) for r in sc.current_legs(spark, str(tmp_path / "out")).collect()}
    assert got == {(f"k{n}", "a" if n < 20 else "b") for n in range(60)}
    # Late files: only their dates are rewritten.
    legs(spark, [0, 100], "c", datetime(2026, 8, 5)).write.mode("append").parquet(src)
    sc.start_ingest(spark.readStream.schema(LEGS).parquet(src), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    after = {r.call_key: r.source_key for r in sc.current_legs(spark, str(tmp_path / "out")).collect()}
    assert len(after) == 61 and after["k0"] == "c" and after["k1"] == "a"

    deduped = sc.dedup_stream(spark.readStream.schema(LEGS).parquet(src))
    sums = sc.interval_stream(deduped, ServiceRules(), timed=True)
    q = sums.writeStream.format("memory").queryName("sums").outputMode("update").option(
        "checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    measures = ("business_date", "interval_start", "queue", "designation", "language", "offered", "answered")
    last = {}
    for r in spark.table("sums").collect():  # update mode: a later row of a key replaces the earlier one
        key = tuple(r[m] for m in measures[:5])
        last[key] = max(last.get(key, ()), (r.offered, r.answered))
    batch = service_intervals(legs(spark, [*range(60), 100]), ServiceRules()).collect()
    assert last == {tuple(r[m] for m in measures[:5]): (r.offered, r.answered) for r in batch}


def test_overlong_days_are_split_off(spark):
    df = spark.range(0, 210).selectExpr(
        "CASE WHEN id < 105 THEN DATE'2026-08-01' ELSE DATE'2026-08-02' END AS business_date", "id % 105 AS interval_start"
    ).unionByName(spark.range(104).selectExpr("DATE'2026-08-03' AS business_date", "id AS interval_start"))
    kept, over = sc.split_overlong_days(df)
    assert {r.business_date.day for r in kept.collect()} == {3}
    beyond = over.collect()
    assert {r.business_date.day: r.interval_count for r in beyond} == {1: 105, 2: 105} and len(beyond) == 210
