"""Interval operators against a brute-force second grid."""

import random
import time
from datetime import datetime, timedelta

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rotaspark.operators import intervals as iv

BASE = datetime(2026, 8, 1, 7, 50)
spans = st.lists(st.tuples(st.integers(0, 9000), st.integers(-60, 4000)), min_size=1, max_size=14)


def at(seconds):
    return BASE + timedelta(seconds=seconds)


def frame(spark, sets, name="k"):
    rows = [(k, at(s), at(s + n), i) for k, pieces in enumerate(sets) for i, (s, n) in enumerate(pieces)]
    return spark.createDataFrame(rows, f"{name} int, start timestamp_ntz, end timestamp_ntz, n int")


def grid(pieces):
    return {x for s, n in pieces for x in range(s, s + n)}


def covered(rows, k):
    out = []
    for r in rows:
        if r["k"] == k:
            lo, hi = (int((r[c] - BASE).total_seconds()) for c in ("start", "end"))
            assert hi > lo
            out.append((lo, hi))
    out.sort()
    return out


def runs(points):
    out = []
    for x in sorted(points):
        if out and out[-1][1] == x:
            out[-1][1] = x + 1
        else:
            out.append([x, x + 1])
    return [tuple(r) for r in out]


slow = settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))


@slow
@given(st.lists(spans, min_size=4, max_size=8))
def test_merge_subtract_intersect(spark, sets):
    df = frame(spark, sets).drop("n")
    whole, plain = iv.merge_intervals(df, ["k"]).collect(), iv.merge_intervals(df, ["k"], unit=None).collect()
    span = spark.createDataFrame([(k, at(100), at(8000)) for k in range(len(sets))], "k int, start timestamp_ntz, end timestamp_ntz")
    left = iv.subtract_intervals(span, df, ["k"]).collect()
    both = iv.intersect_intervals(span, iv.merge_intervals(df, ["k"]), ["k"]).collect()
    window = set(range(100, 8000))
    for k, pieces in enumerate(sets):
        points = grid(pieces)
        assert covered(whole, k) == covered(plain, k) == runs(points)
        assert covered(left, k) == runs(window - points)
        assert covered(both, k) == runs(window & points)


def brute_flatten(pieces):
    rows = [(s, s + n, i) for i, (s, n) in enumerate(pieces) if n > 0]
    edges = sorted({x for s, e, _ in rows for x in (s, e)})
    out = []
    for lo, hi in zip(edges, edges[1:]):
        active = [(s, i) for s, e, i in rows if s < hi and e > lo]
        if active:
            out.append((lo, hi, max(active)[1]))
    return out


def test_islands_over_months_and_null_keys(spark):
    rng = random.Random(3)
    sets = [[(rng.randrange(400) * 43200, rng.choice([60, 43200, 90000, 4_000_000])) for _ in range(rng.randrange(1, 60))] for _ in range(12)]
    df = frame(spark, sets).drop("n").withColumn("k", F.when(F.col("k") > 0, F.col("k")))
    got = iv.merge_intervals(df, ["k"]).collect()
    for k, pieces in enumerate(sets):
        want, reach = [], None
        for s, n in sorted(pieces):
            if reach is None or s > reach:
                want.append([s, s + n])
            else:
                want[-1][1] = max(want[-1][1], s + n)
            reach = want[-1][1]
        assert covered(got, k or None) == [tuple(x) for x in want]
    plan = iv.merge_intervals(df, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    frames = [x for x in plan.split("\n") if "Window" in x]
    assert frames and all("_bucket" in x or "_span" in x for x in frames)


def test_the_sweep_is_near_linear(spark):
    """Sub-second rows of one key in one hour, nested and chained, four times as many in less than three times the time."""
    def rows(n):
        half = n // 2
        nested = [(0, i, 2_000_000_000 - i) for i in range(half)]
        chain = [(0, i * 1_700_000_000 // half, i * 1_700_000_000 // half + 900_000) for i in range(half)]
        table = pd.DataFrame(nested + chain, columns=["k", "a", "b"])
        table["n"] = range(len(table))
        stamp = lambda c: F.expr(f"timestampadd(MICROSECOND, {c}, TIMESTAMP_NTZ'2026-08-01 08:00:00')")
        return spark.createDataFrame(table).select("k", stamp("a").alias("start"), stamp("b").alias("end"), "n")

    took = {}
    for n in (500, 5000, 20000):
        df, began = rows(n), time.time()
        got = iv.flatten_latest(df, ["k"], rank=["n"], payload=["n"]).select(F.size("segments"), F.element_at("segments", 1)["n"]).first()
        took[n] = time.time() - began
        assert got[0] > n
    assert took[20000] < 3 * took[5000]


def test_flatten_keeps_every_elementary_piece(spark):
    rng = random.Random(7)
    sets = [[(rng.randrange(9000), rng.randrange(-60, 5000)) for _ in range(rng.randrange(1, 15))] for _ in range(25)]
    sets.append([(0, 7200)])  # one piece over several hours stays one piece
    flat = iv.flatten_latest(frame(spark, sets), ["k"], rank=["n"], payload=["n"], contributor="n").collect()
    found = {r.k: r for r in flat}
    for k, pieces in enumerate(sets):
        want = brute_flatten(pieces)
        got = [
            (int((s.start - BASE).total_seconds()), int((s.end - BASE).total_seconds()), s.n)
            for s in (found[k].segments if k in found else [])
        ]
        assert got == want
        if want:
            assert sorted(found[k].contributors) == [i for i, (_, n) in enumerate(pieces) if n > 0]


def test_overlap_join_has_each_pair_once(spark):
    a = spark.createDataFrame([("x", at(0), at(200000))], "k string, s timestamp_ntz, e timestamp_ntz")
    b = spark.createDataFrame([("x", at(-90000), at(150000), 1), ("x", at(200000), at(200001), 2)], "k string, rs timestamp_ntz, re timestamp_ntz, n int")
    for unit in ("HOUR", "DAY", "MONTH"):
        got = iv.overlap_join(a, b, ["k"], left_span=("s", "e"), right_span=("rs", "re"), unit=unit)
        assert [r.n for r in got.collect()] == [1]


def test_repeated_rows_are_not_broadcast(spark, tmp_path):
    """Spark's size check sees files before their rows are repeated per bucket, so it must not choose a broadcast."""
    for name, cols in (("a", ("s", "e")), ("b", ("rs", "re"))):
        df = spark.createDataFrame([("x", at(0), at(200000))], f"k string, {cols[0]} timestamp_ntz, {cols[1]} timestamp_ntz")
        df.write.parquet(str(tmp_path / name))
    read = lambda name: spark.read.parquet(str(tmp_path / name))
    met = iv.overlap_join(read("a"), read("b"), ["k"], left_span=("s", "e"), right_span=("rs", "re"), unit="HOUR")
    assert met.count() == 1
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_hot_key_is_split_by_a_skew_join(spark):
    """A third of all status rows on one agent: same result when AQE splits the partition."""
    from rotaspark.plans.attendance import status_segments

    n = 3000
    rows = spark.range(n).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE cast(id % 50 AS string) END AS roster_client_id",
        "TIMESTAMP_NTZ'2026-08-01 08:00:00' + make_dt_interval(0, 0, 0, cast(id * 7 % 25000 AS decimal(18,6))) AS status_start",
        "CASE WHEN id % 2 = 0 THEN 'Productive' ELSE 'Logged Off' END AS actual_category", "'s' AS source_key", "id AS source_row",
    ).withColumn("status_end", F.col("status_start") + F.expr("INTERVAL 400 SECONDS"))
    days = rows.select("roster_client_id").distinct().selectExpr(
        "roster_client_id", "DATE'2026-08-01' AS business_date", "TIMESTAMP_NTZ'2026-08-01 08:00:00' AS scheduled_start",
        "TIMESTAMP_NTZ'2026-08-01 16:00:00' AS evidence_end",
    )
    plain = {r[0]: r.segments for r in status_segments(days, rows).collect()}
    tuned = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
    }
    before = {k: spark.conf.get(k, None) for k in tuned}
    for k, v in tuned.items():
        spark.conf.set(k, v)
    try:
        split = {r[0]: r.segments for r in status_segments(days, rows).collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert split == plain and len(plain["hot"]) > 100
