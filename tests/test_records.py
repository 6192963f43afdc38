"""Files whose records span lines: read in splits, as Spark's whole-file parser reads them."""

import random

import pytest
from pyspark.sql import functions as F

from rotaspark.sources import readers, records


def reference(line, inside, sep=","):
    """Character by character."""
    i, fresh = 0, not inside
    while i < len(line):
        c = line[i]
        if inside:
            if c == '"':
                if line[i + 1 : i + 2] == '"':
                    i += 1
                else:
                    inside = False
        elif c == '"' and fresh:
            inside, fresh = True, False
            i += 1
            continue
        fresh = not inside and c == sep
        i += 1
    return inside


def test_states_of_lines():
    rng = random.Random(1)
    for _ in range(4000):
        line = "".join(rng.choice('ab,"",\r') for _ in range(rng.randint(0, 12)))
        for inside in (False, True):
            assert records.state_after(line.encode(), inside) == reference(line, inside), (line, inside)


def cell(rng):
    plain = rng.choice(["", "a", "7", "é ü", "it's", '5" pipe'])
    quoted = "".join(rng.choice(["x", ",", '""', "\n", "\r\n", " ", "日"]) for _ in range(rng.randint(0, 9)))
    return plain if rng.random() < 0.6 else f'"{quoted}"'


def text_of(rng, n, end):
    lines = ["A,B,C"]
    for i in range(n):
        lines.append(f"r{i},{cell(rng)},{cell(rng)}")
        if rng.random() < 0.05:
            lines.append("")
    return end.join(lines) + rng.choice(["", end])


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
              if spark.conf.get(k, None) is not None}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(k, before[k]) if k in before else spark.conf.unset(k)


def test_splits_give_the_rows_of_the_whole_file(spark, tmp_path, small_splits):
    rng, paths = random.Random(2), []
    for k, end in enumerate(["\n", "\r\n", "\n"]):
        path = tmp_path / f"f {k}+.csv"
        path.write_bytes(text_of(rng, 300, end).encode())
        paths.append(str(path))
    long = tmp_path / "long.csv"  # one cell over many splits, and a quote that is never closed
    long.write_text('A,B,C\nr0,"' + "word, \n" * 800 + '",z\nr1,x,"y\n' + "tail\n" * 300 + "tail")
    paths.append(str(long))
    assert not any(lines for _, lines in readers.headers_of(spark, paths).values())
    got = readers.read_delimited(spark, str(tmp_path), paths)
    rows = {(r.source_key, r.source_row): (r.A, r.B, r.C) for r in got.collect()}
    assert got.count() == len(rows)
    whole = spark.read.schema("A string, B string, C string").option("header", True).option("multiLine", True).option("escape", '"').csv(paths)
    want = {}
    for r in whole.select("*", F.col("_metadata.file_name").alias("f"), F.monotonically_increasing_id().alias("i")).orderBy("i").collect():
        key = r.f.replace("%20", " ")
        want[key, 2 + sum(k[0] == key for k in want)] = (r.A, r.B, r.C)
    # Spark's parser turns line ends inside cells into plain ones where the file's own are CR LF; here cells stay as they are.
    bare = lambda cells: tuple(c and c.replace("\r\n", "\n") for c in cells)
    assert {k: bare(v) for k, v in rows.items()} == {k: bare(v) for k, v in want.items()} and len(rows) == 902
    assert any("\r\n" in (c or "") for v in rows.values() for c in v)
    states = records.split_states(spark, paths).collect()
    assert len(states) > 20 and any(inside for inside, _ in records.split_starts(records.split_states(spark, paths)).values())
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1  # the fragments; whole records stay where they are read


def test_other_charsets_and_separators(spark, tmp_path, small_splits):
    path = tmp_path / "week.txt"
    text = "Name\tData Source IDs\t03/04/2026\n" + "".join(f'"René {i}\nM"\t0{i}\tOff\n' for i in range(90))
    path.write_bytes(text.encode("cp1252"))
    wide, days = readers.read_schedule(spark, str(tmp_path), [str(path)])
    rows = wide.orderBy("source_row").collect()
    assert days == ["03/04/2026"] and [r.source_row for r in rows] == list(range(2, 92))
    assert rows[7]["Name"] == "René 7\nM" and rows[7]["Data Source IDs"] == "07"


def test_no_raw_row_is_shuffled_for_its_number(spark, tmp_path):
    path = tmp_path / "plain.csv"
    path.write_text("A,B\n" + "".join(f"{i},x\n" for i in range(2000)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = readers.read_delimited(spark, str(tmp_path), [str(path)])
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert {int(r.A) + 2 == r.source_row for r in rows.collect()} == {True}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_mapping_rows_have_five_cells(spark, tmp_path):
    head = "mapping_type,source_system,source_value,service_scope,designation\n"
    good = "queue,STORM,Q-1,North,main\nqueue,STORM,Q-2,South,\n"
    for extra, ok in (("", True), ("queue,STORM,Q-3,North\n", False), ("queue,STORM,Q-3,North,main,more\n", False)):
        path = tmp_path / f"m{len(extra)}.csv"
        path.write_text(head + good + extra)
        if ok:
            assert readers.read_queue_mapping(spark, str(path))[0].count() == 2
        else:
            with pytest.raises(readers.SourceError, match="five cells: queue,STORM,Q-3"):
                readers.read_queue_mapping(spark, str(path))
