"""The versioned sink: restarts, repeated batches, two writers, bytes read, compaction."""

import json
from datetime import date

from pyspark.sql import functions as F

from rotaspark.operators.latest import keep_first
from rotaspark.streaming import calls as sc
from rotaspark.streaming import versions
from rotaspark.streaming.versions import Commit, VersionedTable

from .test_refresh_streaming import LEGS, legs

ROWS = "k string, business_date date, n int"


def newest(rows):
    return keep_first(rows, ["k"], [F.desc("n")])


def batch(spark, *rows):
    return spark.createDataFrame([(k, d and date(2026, 8, d), n) for k, d, n in rows], ROWS)


def held(table):
    return {(r.k, r.business_date and r.business_date.day, r.n) for r in table.read().collect()}


def test_a_fresh_checkpoint_loses_nothing(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k, numbers in enumerate((range(10), range(5, 20))):
        legs(spark, numbers, f"f{k}").write.mode("append").parquet(src)
        sc.start_ingest(spark.readStream.schema(LEGS).parquet(src), out, str(tmp_path / "cp")).awaitTermination(120)
    late = str(tmp_path / "late")
    legs(spark, [0, 200], "late").write.parquet(late)
    sc.start_ingest(spark.readStream.schema(LEGS).parquet(late), out, str(tmp_path / "cp-2")).awaitTermination(120)
    got = {r.call_key: r.source_key for r in sc.current_legs(spark, out).collect()}
    assert len(got) == 21 and got["k200"] == "late" and got["k0"] == "late" and got["k1"] == "f0"
    state = VersionedTable(spark, out).state()
    assert state.number == 3 and sorted(state.batches.values()) == [0, 1]
    # The same files again from the start, under a third checkpoint: nothing doubles.
    sc.start_ingest(spark.readStream.schema(LEGS).parquet(src), out, str(tmp_path / "cp-3")).awaitTermination(120)
    assert {r.call_key: r.source_key for r in sc.current_legs(spark, out).collect()} == got


def test_batches_count_once_and_open_their_dates_only(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    assert table.read() is None and table.state() == Commit()
    assert table.apply(batch(spark, ("a", 1, 1), ("b", 2, 1), ("c", None, 1)), 0, "w", newest)
    assert table.apply(batch(spark, ("a", 1, 2), ("d", 1, 1)), 1, "w", newest)
    assert not table.apply(batch(spark, ("a", 1, 9)), 1, "w", newest)
    assert held(table) == {("a", 1, 2), ("b", 2, 1), ("c", None, 1), ("d", 1, 1)}
    state = table.state()
    assert len({state.dates["2026-08-01"], state.dates["2026-08-02"]}) == 2
    opened = table.read(state, ["2026-08-02"]).inputFiles()
    assert opened and all("business_date=2026-08-02" in f for f in opened)
    assert table.apply(batch(spark, ("c", None, 5)), 0, "other", newest) and ("c", None, 5) in held(table)


def test_two_writers_and_a_commit_cut_short(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.apply(batch(spark, ("a", 1, 1)), 0, "one", newest)
    merged = []

    def slow(rows):
        if not merged:  # while this batch is merged, another query commits
            merged.append(1)
            table.apply(batch(spark, ("x", 1, 1)), 0, "two", newest)
        return newest(rows)

    assert table.apply(batch(spark, ("b", 1, 1)), 1, "one", slow)
    assert held(table) == {("a", 1, 1), ("b", 1, 1), ("x", 1, 1)} and table.state().number == 3
    (tmp_path / "t/commits/commit-000000000004").write_bytes(b"")
    monkeypatch.setattr(versions, "STALE_SECONDS", 0)
    assert table.apply(batch(spark, ("y", 2, 1)), 2, "one", newest)
    assert table.state().number == 5 and ("y", 2, 1) in held(table)


def test_compaction_keeps_what_commits_name(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    for n in range(4):
        table.apply(batch(spark, ("a", 1, n), (f"k{n}", 2 + n, n)), n, "w", newest)
    before = held(table)
    assert len(list((tmp_path / "t/data").iterdir())) == 4
    assert table.compact(keep=1) == 0  # each folder still holds a date of its own
    table.apply(batch(spark, *[(f"k{n}", 2 + n, 9) for n in range(4)]), 4, "w", newest)
    assert table.compact(keep=1) == 3 and len(list((tmp_path / "t/commits").glob("commit-*"))) == 1
    assert held(table) == {(k, d, 9 if k != "a" else n) for k, d, n in before}
    assert json.loads((tmp_path / "t/commits/commit-000000000005").read_text())["batches"] == {"w": 4}
