"""Driver tables are shared out by rows: a task's work does not grow with the table."""

from datetime import datetime

from pyspark.sql import functions as F

from testbed import shape


def test_tasks_follow_rows(spark, tmp_path, monkeypatch):
    n, limit = 3000, 100
    stamp = F.lit(datetime(2024, 1, 3, 10))
    events = spark.range(n).select(
        F.col("id").alias("event_id"), stamp.alias("ts"), (F.col("id") % 500).alias("user_id"), F.lit("click").alias("event_type"),
        F.lit(20.0).alias("value"), F.lit("{}").alias("props"),
    )
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(shape, "TASK_ROWS", limit, raising=False)
    read = shape.table(spark, str(tmp_path), "events")
    assert read.rdd.getNumPartitions() == n // limit
    calls = shape.calls_raw(spark, str(tmp_path))
    most = calls.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert calls.count() == 2 * n and most <= 2 * limit + 60
    wide, _ = shape.schedule_raw(spark, str(tmp_path))
    assert wide.count() == 2 * 500
    users = wide.where("source_key = 'schedule/base.txt'").groupBy(F.spark_partition_id()).count()
    assert users.count() > 8 and users.agg(F.max("count")).first()[0] < 100


def test_staffing_ladder_is_worked_out_once(spark, monkeypatch):
    from testbed import queries_more

    made, build = [], queries_more._ladder
    monkeypatch.setattr(queries_more, "_ladder", lambda s, d: made.append(d) or build(s, d))
    plan = queries_more._gapped(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len(made) == 1 and "sequence(" not in plan and plan.count("staffing_gap") >= 1


def test_source_health_holds_few_plans(spark, tmp_path):
    """Totals and table summaries are written down before they are joined: the last plan reads small files, not every table twice."""
    from testbed import queries_more

    place = lambda name: str(tmp_path / f"{name}.parquet")
    stamp = F.expr("timestamp'2024-01-01 08:00:00' + make_dt_interval(cast(id % 30 AS int), cast(id % 9 AS int), 0, 0)")
    spark.range(300).select(
        F.col("id").alias("event_id"), stamp.alias("ts"), (F.col("id") % 20).alias("user_id"),
        F.element_at(F.array(*map(F.lit, ("click", "view", "purchase"))), (F.col("id") % 3 + 1).cast("int")).alias("event_type"),
        F.lit(20.0).alias("value"), F.lit("{}").alias("props"),
    ).coalesce(1).write.parquet(place("events"))
    spark.range(20).selectExpr(
        "id AS c_custkey", "concat('Customer#', lpad(cast(id AS string), 9, '0')) AS c_name", "1 AS c_nationkey",
        "10D AS c_acctbal", "'AUTO' AS c_mktsegment",
    ).coalesce(1).write.parquet(place("customer"))
    spark.range(1, 30).selectExpr(
        "id AS o_orderkey", "id % 20 AS o_custkey", "'F' AS o_orderstatus", "1D AS o_totalprice",
        "timestamp'2024-01-05 00:00:00' AS o_orderdate", "CASE WHEN id % 2 = 0 THEN '1-URGENT' ELSE '5-LOW' END AS o_orderpriority",
    ).coalesce(1).write.parquet(place("orders"))
    health = queries_more.source_health(spark, str(tmp_path))
    rows = {r.source: r for r in health.collect()}
    assert set(rows) == {"roster", "schedule", "agentStatus", "lilo", "callByCall", "attendance"}
    assert rows["agentStatus"].row_count == queries_more._status(spark, str(tmp_path)).count() > 0
    assert rows["schedule"].row_count == queries_more._schedule(spark, str(tmp_path)).count() > 0
    assert {r.overall_status for r in rows.values()} == {"source_changed"}
    assert health._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= 6


def test_plan_texts_are_bounded(spark):
    """The driver keeps the text of many plans: a long one is cut in print, its rows are whole."""
    long = "x" * 200_000
    df = spark.range(1).select(F.concat(F.lit(long), F.col("id").cast("string")).alias("t"))
    assert len(df._jdf.queryExecution().executedPlan().toString()) < 100_000
    assert df.first()[0] == long + "0"
