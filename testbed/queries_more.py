"""Registered queries: refresh control tables, forecasting and staffing."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from rotaspark.functions.keys import call_key
from rotaspark.functions.text import fold_name
from rotaspark.functions.temporal import NTZ
from rotaspark.operators import identity as ident
from rotaspark.plans import attendance, evidence, forecasting, refresh, roster, staffing
from rotaspark.sources.stage import staged
from testbed import shape
from testbed.oracle import day, iso
from testbed.queries import (
    _cells, _intervals, _legs, _lilo, _model, _roster, _schedule, _shifts, _silver, _status, _time_off, query,
)

SCOPE = ["service_scope", "comparison_scope"]


# --- refresh -----------------------------------------------------------------


def _call_files(spark, sf, low, high):
    """Inventory of the call exports as they stood when events of [low, high) were exported."""
    raw = shape.calls_raw(spark, sf)
    e = shape.table(spark, sf, "events").select((F.col("event_id") + 2).alias("source_row"), F.to_date("ts").alias("d"))
    kept = e.filter((F.col("d") >= F.lit(low)) & (F.col("d") < F.lit(high)))
    return (
        raw.join(kept, "source_row")
        .groupBy("source_key")
        .agg((F.count("*") * 100).alias("file_size"), F.max("source_mtime").alias("mtime"),
             F.min("d").alias("date_from"), F.max("d").alias("date_to"))
        .withColumn("source_type", F.lit("call_by_call"))
    )


def _files_sql(low: str, high: str) -> str:
    return f"""(SELECT source_key, count(*) * 100 AS file_size, max(mtime) AS mtime, min(t0::DATE) AS date_from, max(t0::DATE) AS date_to
      FROM calls0 WHERE t0::DATE >= DATE '{low}' AND t0::DATE < DATE '{high}' GROUP BY 1)"""


_A, _C = _files_sql("2024-01-01", "2024-01-25"), _files_sql("2024-01-03", "2024-01-31")
_DIFF = f"""SELECT coalesce(a.source_key, c.source_key) AS source_key, CASE WHEN a.source_key IS NULL THEN 'added' WHEN c.source_key IS NULL THEN 'removed'
    WHEN a.file_size = c.file_size AND a.mtime = c.mtime THEN 'same' ELSE 'changed' END AS change FROM {_A} a FULL JOIN {_C} c ON a.source_key = c.source_key"""


def _diff(spark, sf):
    active = _call_files(spark, sf, date(2024, 1, 1), date(2024, 1, 25))
    return active, refresh.manifest_diff(active, _call_files(spark, sf, date(2024, 1, 3), date(2024, 1, 31)))


@query(f"SELECT 'call_by_call' AS source_type, source_key, change FROM ({_DIFF})")
def manifest_diff(spark, sf):
    """JN-15 / GN-01."""
    return _diff(spark, sf)[1]


@query(
    f"""SELECT DISTINCT strftime(unnest(generate_series(m.date_from - 1, m.date_to + 1, INTERVAL 1 DAY)), '%Y-%m-%d') AS business_date
    FROM (SELECT * FROM {_A} UNION ALL SELECT * FROM {_C}) m JOIN ({_DIFF}) d USING (source_key) WHERE d.change <> 'same'"""
)
def affected_dates(spark, sf):
    """GN-08: the old and the new date range of every source that changed."""
    active, diff = _diff(spark, sf)
    return refresh.affected_dates(active, _call_files(spark, sf, date(2024, 1, 3), date(2024, 1, 31)), diff)


def _history(spark, sf):
    """One generation per day of events; each carries a version per event type."""
    e = shape.table(spark, sf, "events").select("event_type", F.dayofmonth("ts").cast("bigint").alias("generation_id"))
    counts = e.groupBy("generation_id", "event_type").agg(F.count("*").alias("row_count"))
    manifest = counts.selectExpr(
        "generation_id", "'call_by_call' AS source_type", "event_type AS source_key",
        "CASE WHEN row_count % 7 = 0 THEN 'removed' ELSE 'present' END AS state", "row_count * 100 AS file_size",
        "TIMESTAMP'2024-01-01 00:00:00' AS mtime", "sha2(cast(row_count % 5 AS string), 256) AS content_sha256",
        "'v1' AS adapter_version", "CASE WHEN generation_id < 10 THEN 'p0' ELSE 'p1' END AS policy_fingerprint", "row_count",
        "generation_id AS bronze_generation_id",
    )
    ids = e.select("generation_id").distinct()
    generations = ids.selectExpr(
        "generation_id", "CASE WHEN generation_id % 5 = 0 THEN generation_id - 2 WHEN generation_id > 1 THEN generation_id - 1 END AS base_generation_id",
        "CASE WHEN generation_id % 6 = 0 THEN 'failed' ELSE 'succeeded' END AS status", "'cat' AS catalog_sha256", "'m1' AS model_version",
    )
    rosters = ids.selectExpr(
        "generation_id", "'fte_roster' AS source_type", "'fte/roster.xlsx' AS source_key", "'present' AS state", "1L AS file_size",
        "TIMESTAMP'2024-01-01 00:00:00' AS mtime", "sha2(cast(generation_id div 10 AS string), 256) AS content_sha256", "'r1' AS adapter_version",
        "'rp' AS policy_fingerprint", "1L AS row_count", "generation_id AS bronze_generation_id",
    )
    return manifest, generations, rosters


def _last(manifest):
    """The greatest generation, as a table of one row."""
    return manifest.agg(F.max("generation_id").alias("generation_id"))


_HISTORY = """(SELECT day(ts)::BIGINT AS g, event_type AS k, count(*)::BIGINT AS n FROM events GROUP BY 1, 2)"""


@query(
    f"""SELECT 'call_by_call' AS source_type, k AS source_key, g AS generation_id, n AS row_count FROM (
      SELECT *, row_number() OVER (PARTITION BY k ORDER BY g DESC) AS r FROM {_HISTORY} WHERE g IN (
        WITH RECURSIVE chain(g) AS (SELECT max(g) FROM {_HISTORY} UNION ALL SELECT CASE WHEN g % 5 = 0 THEN g - 2 ELSE g - 1 END FROM chain WHERE g > 1) SELECT g FROM chain))
    WHERE r = 1 AND n % 7 <> 0"""
)
def lineage_latest(spark, sf):
    """GN-05 / WN-07 / SET-04."""
    manifest, generations, _ = _history(spark, sf)
    chain = refresh.lineage(generations, generations.agg(F.max("generation_id")).first()[0])
    return refresh.lineage_sources(manifest, chain).select("source_type", "source_key", "generation_id", "row_count")


@query(
    f"""SELECT 'call_by_call' AS source_type, w.k AS source_key, arg_max(h.g, h.g) AS bronze_generation_id, arg_max(h.n, h.g) AS row_count, max(h.g) AS from_generation_id
    FROM {_HISTORY} w JOIN {_HISTORY} h ON h.k = w.k AND h.n % 5 = w.n % 5 JOIN (SELECT max(day(ts))::BIGINT AS g FROM events) l ON w.g = l.g
    WHERE (h.g < 10) = (w.g < 10) AND h.n % 7 <> 0 AND h.g % 6 <> 0 AND h.g // 10 = (w.g - 5) // 10 GROUP BY w.k"""
)
def bronze_reuse(spark, sf):
    """GN-04 / JN-14 / WN-08."""
    manifest, generations, rosters = _history(spark, sf)
    last = _last(manifest).first()[0]
    wanted = manifest.filter(F.col("generation_id") == last).select(
        "source_type", "source_key", "file_size", "mtime", "content_sha256", F.lit("cat").alias("catalog_sha256"),
        F.lit("m1").alias("model_version"), "adapter_version", "policy_fingerprint",
    )
    current_roster = rosters.filter(F.col("generation_id") == last - 5)
    return refresh.reusable_bronze(wanted, manifest.unionByName(rosters), generations, current_roster, last)


@query(
    f"""SELECT 'call_by_call' AS source_type, count(*)::BIGINT AS file_count, coalesce(sum(n), 0)::BIGINT AS row_count FROM {_HISTORY} WHERE g = (SELECT max(day(ts)) FROM events) AND n % 7 <> 0 HAVING count(*) > 0"""
)
def source_totals(spark, sf):
    """AG-12."""
    manifest = _history(spark, sf)[0]
    return refresh.source_totals(manifest.join(_last(manifest), "generation_id", "left_semi"))


def _tables(spark, sf):
    model = _model(spark, sf)
    return {
        "agent_roster": (roster.canonical_roster(_roster(spark, sf), _cells(spark, sf)), None),
        "time_off": (roster.canonical_time_off(_time_off(spark, sf)), None),
        "schedule_shift": (_schedule(spark, sf), "business_date"),
        "agent_status": (_status(spark, sf), "extract_date"),
        "lilo": (_lilo(spark, sf), "extract_date"),
        "call_leg": (_legs(spark, sf), "business_date"),
        "service_interval": (_intervals(spark, sf), "business_date"),
        "attendance_agent_day": (attendance.agent_days(model), "business_date"),
        "attendance_gap": (attendance.attendance_gaps(model), "business_date"),
        "status_primary_days": (attendance.agent_days(model).filter("status_is_primary"), "business_date"),
        "attendance_unknown_days": (attendance.agent_days(model).filter("evidence_state = 'UNKNOWN'"), "business_date"),
    }


def _summary_sql() -> str:
    parts = [
        ("time_off", "time_off WHERE valid", None), ("schedule_shift", "schedule", "business_date"), ("agent_status", "status", "extract_date"),
        ("lilo", "lilo", "extract_date"), ("call_leg", "legs", "business_date"), ("service_interval", "intervals", "business_date"),
        ("attendance_agent_day", "agent_day", "business_date"), ("attendance_gap", "gaps", "business_date"),
        ("status_primary_days", "agent_day WHERE status_is_primary = 1", "business_date"),
        ("attendance_unknown_days", "agent_day WHERE evidence_state = 'UNKNOWN'", "business_date"),
    ]
    rows = [
        f"SELECT '{name}' AS table_name, count(*)::BIGINT AS row_count, "
        + (f"{day(f'min({d})')} AS date_from, {day(f'max({d})')} AS date_to" if d else "NULL AS date_from, NULL AS date_to")
        + f" FROM {source}"
        for name, source, d in parts
    ]
    extra = """SELECT 'agent_roster', (SELECT count(*) FROM by_id)::BIGINT + (SELECT count(DISTINCT roster_client_id) FROM cells WHERE schedule_state <> 'INVALID'
      AND scope_match = 'name' AND roster_client_id IS NOT NULL AND roster_client_id NOT IN (SELECT client_id FROM by_id))::BIGINT, NULL, NULL"""
    return " UNION ALL ".join([*rows, extra])


@query(_summary_sql())
def generation_summary(spark, sf):
    """AG-09 / AG-10."""
    return refresh.table_summary(_tables(spark, sf))


@query(
    """SELECT source, (overall_status = 'ready' AND CASE WHEN source IN ('roster', 'schedule') THEN true ELSE coalesce(n, 0) > 0 END)::INT AS ready,
      overall_status, coalesce(n, 0)::BIGINT AS row_count
    FROM (SELECT CASE WHEN count(*) = 0 THEN 'not_ready' WHEN max(day(ts)) % 4 = 1 THEN 'ready' ELSE 'source_changed' END AS overall_status FROM events), (
      SELECT 'agentStatus' AS source, (SELECT count(*) FROM status) AS n UNION ALL SELECT 'lilo', (SELECT count(*) FROM lilo) UNION ALL
      SELECT 'callByCall', (SELECT count(*) FROM legs) UNION ALL SELECT 'schedule', (SELECT count(*) FROM schedule) UNION ALL
      SELECT 'attendance', (SELECT count(*) FROM agent_day) UNION ALL SELECT 'roster', (SELECT count(*) FROM by_id) + (SELECT count(DISTINCT roster_client_id) FROM cells
        WHERE schedule_state <> 'INVALID' AND scope_match = 'name' AND roster_client_id IS NOT NULL AND roster_client_id NOT IN (SELECT client_id FROM by_id)))"""
)
def source_health(spark, sf):
    """GN-09 / PR-09."""
    files = [
        df.groupBy("source_key").agg(F.count("*").alias("row_count")).select(
            F.lit(kind).alias("source_type"), "source_key", "row_count", F.lit("present").alias("state")
        )
        for kind, df in (
            ("fte_roster", _roster(spark, sf)), ("published_schedule", _cells(spark, sf)), ("agent_status", _status(spark, sf)),
            ("lilo", _lilo(spark, sf)), ("call_by_call", _legs(spark, sf)),
        )
    ]
    manifest = files[0]
    for part in files[1:]:
        manifest = manifest.unionByName(part)
    tables = {k: v for k, v in _tables(spark, sf).items() if k not in ("status_primary_days", "attendance_unknown_days")}
    _, generations, _ = _history(spark, sf)
    generations = generations.withColumn("catalog_sha256", F.concat(F.lit("cat"), F.col("generation_id") % 4))
    # Written down: totals are read twice, and the driver would hold the plans of all tables at once.
    totals = staged(refresh.source_totals(manifest), "source_totals")
    summary = staged(refresh.table_summary(tables), "table_summary")
    health = refresh.source_health(totals, summary, generations, _last(generations).first()[0], "cat1")
    return health.select("source", "ready", "overall_status", "row_count")


# --- forecasting -------------------------------------------------------------


def _volume(spark, sf):
    return _intervals(spark, sf).groupBy(*SCOPE, "business_date", "interval_start").agg(
        F.sum("offered").cast("double").alias("actual_volume")
    )


def _naive(spark, sf):
    return forecasting.seasonal_naive(_volume(spark, sf), SCOPE)


def _naive_errors(spark, sf):
    return forecasting.interval_errors(
        _naive(spark, sf), _volume(spark, sf), [*SCOPE, "business_date", "interval_start"]
    )


_TARGET = f"service_scope, comparison_scope, {day('business_date')} AS business_date, {iso('interval_start')} AS interval_start"
_METRICS = """count(*)::BIGINT AS interval_count, round(sum(signed_error) / nullif(sum(actual_volume), 0), 6) AS bias, round(sum(absolute_error) / nullif(sum(actual_volume), 0), 6) AS wape,
    round(avg(absolute_error), 6) AS mae, round(sqrt(avg(signed_error * signed_error)), 6) AS rmse, round(avg(absolute_error / nullif(actual_volume, 0)), 6) AS mape"""


@query(
    f"""SELECT service_scope, comparison_scope, {day('business_date + 7')} AS business_date, {iso('interval_start + INTERVAL 7 DAY')} AS interval_start, actual_volume AS forecast_volume, 'seasonal_naive' AS model_id FROM volume"""
)
def seasonal_naive(spark, sf):
    """DX-03."""
    return _naive(spark, sf)


@query(
    f"""SELECT service_scope, comparison_scope, {day('t::DATE')} AS business_date, {iso('t')} AS interval_start, round(avg(actual_volume), 6) AS forecast_volume, 'recent_mean' AS model_id
    FROM (SELECT *, interval_start + to_days(k::INT) AS t FROM volume CROSS JOIN (SELECT unnest(range(1, 8)) AS k)) GROUP BY service_scope, comparison_scope, t"""
)
def recent_mean(spark, sf):
    """DX-03."""
    return forecasting.recent_mean(_volume(spark, sf), SCOPE)


@query(
    f"""SELECT service_scope, comparison_scope, arg_max(actual_volume, interval_start) AS forecast_volume, {iso('max(interval_start)')} AS last_observed, 'last_value' AS model_id FROM volume GROUP BY 1, 2"""
)
def last_value(spark, sf):
    """DX-08."""
    return forecasting.last_value(_volume(spark, sf), SCOPE)


@query(f"SELECT {_TARGET}, forecast_volume, 'seasonal_naive' AS model_id, actual_volume, signed_error, absolute_error FROM naive")
def forecast_errors(spark, sf):
    """DX-01."""
    return _naive_errors(spark, sf)


@query(f"SELECT service_scope, {day('business_date')} AS business_date, {_METRICS} FROM naive GROUP BY ALL")
def forecast_accuracy(spark, sf):
    """DX-02."""
    return forecasting.accuracy(_naive_errors(spark, sf), ["service_scope", "business_date"])


@query(
    """SELECT service_scope, dayofweek(business_date)::INT + 1 AS weekday, strftime(interval_start, '%H:%M') AS interval_of_day, count(*)::BIGINT AS interval_count,
    round(avg(signed_error), 6) AS mean_signed_error, round(avg(absolute_error), 6) AS mean_absolute_error FROM naive GROUP BY ALL"""
)
def error_pattern(spark, sf):
    """DX-19."""
    return forecasting.error_pattern(_naive_errors(spark, sf))


_VINTAGES = """(SELECT service_scope, comparison_scope, interval_start + INTERVAL 7 DAY AS t, actual_volume AS f, 'seasonal_naive' AS m, (business_date + 7)::TIMESTAMP - INTERVAL 7 DAY AS created FROM volume
    UNION ALL SELECT service_scope, comparison_scope, t, avg(actual_volume), 'recent_mean', t::DATE::TIMESTAMP - INTERVAL 1 DAY FROM (
      SELECT *, interval_start + to_days(k::INT) AS t FROM volume CROSS JOIN (SELECT unnest(range(1, 8)) AS k)) GROUP BY service_scope, comparison_scope, t)"""


@query(
    f"""SELECT service_scope, comparison_scope, {iso('t')} AS interval_start, {iso('max(created)')} AS forecast_created_at, round(arg_max(f, (created, m)), 6) AS forecast_volume, arg_max(m, (created, m)) AS model_id
    FROM {_VINTAGES} WHERE created <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY service_scope, comparison_scope, t"""
)
def vintage_asof(spark, sf):
    """DX-05."""
    volume = _volume(spark, sf)
    made = lambda df, days: df.withColumn("forecast_created_at", F.date_sub("business_date", days).cast(NTZ))
    both = made(forecasting.seasonal_naive(volume, SCOPE), 7).unionByName(made(forecasting.recent_mean(volume, SCOPE), 1))
    return forecasting.vintage_asof(both, [*SCOPE, "interval_start"], datetime(2024, 1, 20))


# Every origin with seven days before it and seven from it on.
_ORIGINS = """(SELECT unnest(generate_series(min(business_date) + 7, max(business_date) - 6, INTERVAL 1 DAY))::DATE AS origin FROM volume)"""
_ROLL = f"""(SELECT o.origin, v.*, strftime(interval_start, '%H:%M') AS clock, date_diff('day', o.origin, business_date) AS age FROM volume v CROSS JOIN {_ORIGINS} o)"""
_ROLLED = f"""(SELECT t.origin, t.service_scope, t.comparison_scope, t.business_date, t.interval_start, 'recent_mean' AS model_id, m.f AS forecast_volume, t.actual_volume FROM {_ROLL} t JOIN (
      SELECT origin, service_scope, comparison_scope, clock, avg(actual_volume) AS f FROM {_ROLL} WHERE age BETWEEN -7 AND -1 GROUP BY ALL) m USING (origin, service_scope, comparison_scope, clock) WHERE t.age BETWEEN 0 AND 6
    UNION ALL SELECT t.origin, t.service_scope, t.comparison_scope, t.business_date, t.interval_start, 'seasonal_naive', h.actual_volume, t.actual_volume FROM {_ROLL} t JOIN {_ROLL} h
      ON h.origin = t.origin AND h.service_scope = t.service_scope AND h.comparison_scope = t.comparison_scope AND h.interval_start = t.interval_start - INTERVAL 7 DAY WHERE t.age BETWEEN 0 AND 6 AND h.age BETWEEN -7 AND -1)"""
_SCORED = f"""(SELECT service_scope, origin, model_id, {_METRICS} FROM (SELECT *, forecast_volume - actual_volume AS signed_error, abs(forecast_volume - actual_volume) AS absolute_error FROM {_ROLLED}) GROUP BY service_scope, origin, model_id)"""


def _scores(spark, sf):
    errors = forecasting.rolling_origins(_volume(spark, sf), SCOPE)
    return forecasting.accuracy(errors, ["service_scope", "origin", "model_id"])


@query(f"SELECT service_scope, {day('origin')} AS origin, model_id, interval_count, bias, wape, mae, rmse, mape FROM {_SCORED}")
def rolling_origin(spark, sf):
    """DX-04."""
    return _scores(spark, sf)


@query(
    f"""SELECT service_scope, {day('origin')} AS origin, model_id, wape, bias, mae FROM {_SCORED} QUALIFY row_number() OVER (PARTITION BY service_scope, origin ORDER BY wape, abs(bias), mae, model_id) = 1"""
)
def model_selection(spark, sf):
    """PR-11 / SL-04."""
    return forecasting.select_model(_scores(spark, sf), ["service_scope", "origin"])


@query(
    """SELECT comparison_scope, service_scope, queue, sum(offered)::DOUBLE AS actual_volume, ((comparison_scope IS NOT NULL)::INT + (service_scope IS NOT NULL)::INT + (queue IS NOT NULL)::INT)::INT AS level
    FROM intervals GROUP BY ROLLUP (comparison_scope, service_scope, queue)"""
)
def hierarchy_rollup(spark, sf):
    """DX-06."""
    leaves = _intervals(spark, sf).withColumn("actual_volume", F.col("offered").cast("double"))
    return forecasting.bottom_up(leaves, ["comparison_scope", "service_scope", "queue"])


_LAGS = """(SELECT v.service_scope, v.comparison_scope, v.interval_start, v.actual_volume AS y, a.actual_volume AS lag_1, b.actual_volume AS lag_2 FROM volume v
    JOIN volume a ON a.service_scope = v.service_scope AND a.interval_start = v.interval_start - INTERVAL 15 MINUTE JOIN volume b ON b.service_scope = v.service_scope AND b.interval_start = v.interval_start - INTERVAL 30 MINUTE)"""


@query(f"SELECT service_scope, comparison_scope, {iso('interval_start')} AS interval_start, y, lag_1, lag_2 FROM {_LAGS}")
def lag_features(spark, sf):
    """DX-07."""
    return forecasting.lag_features(_volume(spark, sf), SCOPE)


@query(
    f"""SELECT service_scope, n, round(my - c1 * ma - c2 * mb, 6) AS intercept, round(c1, 6) AS coef_lag_1, round(c2, 6) AS coef_lag_2 FROM (
      SELECT *, (say * sbb - sby * sab) / det AS c1, (sby * saa - say * sab) / det AS c2 FROM (
        SELECT *, CASE WHEN abs(saa * sbb - sab * sab) > 1e-9 THEN saa * sbb - sab * sab END AS det FROM (
          SELECT service_scope, count(*)::BIGINT AS n, avg(y) AS my, avg(lag_1) AS ma, avg(lag_2) AS mb, var_pop(lag_1) AS saa, var_pop(lag_2) AS sbb, covar_pop(lag_1, lag_2) AS sab,
            covar_pop(lag_1, y) AS say, covar_pop(lag_2, y) AS sby FROM {_LAGS} GROUP BY 1)))"""
)
def lag_regression(spark, sf):
    """DX-07: closed-form fit on the lag features."""
    return forecasting.linear_lag_model(forecasting.lag_features(_volume(spark, sf), SCOPE), ["service_scope"])


# --- staffing ----------------------------------------------------------------

_DEMAND = """(SELECT business_date, interval_start, service_scope, sum(offered)::DOUBLE AS offered, sum(answered)::DOUBLE AS handled, sum(handled_seconds)::DOUBLE AS handle_seconds FROM intervals GROUP BY ALL)"""
_DEMAND_KEYS = f"{day('business_date')} AS business_date, {iso('interval_start')} AS interval_start, service_scope"


def _load(spark, sf):
    return staffing.workload(staffing.interval_demand(_intervals(spark, sf)))


@query(
    f"""SELECT {_DEMAND_KEYS}, offered, handled, handle_seconds, round(handle_seconds / nullif(handled, 0), 6) AS aht_seconds, round(offered * (handle_seconds / nullif(handled, 0)), 6) AS workload_seconds,
    round(offered * (handle_seconds / nullif(handled, 0)) / 900.0, 6) AS required_productive_fte FROM {_DEMAND}"""
)
def workload(spark, sf):
    """DX-09."""
    return _load(spark, sf)


@query(
    f"""SELECT {_DEMAND_KEYS}, round(offered * (handle_seconds / nullif(handled, 0)) / 900.0 / (1 - 0.3::DOUBLE), 6) AS required_scheduled_fte FROM {_DEMAND}"""
)
def shrinkage_uplift(spark, sf):
    """DX-10."""
    lifted = staffing.shrinkage_uplift(_load(spark, sf), 0.3)
    return lifted.select("business_date", "interval_start", "service_scope", "required_scheduled_fte")


@query(
    f"""SELECT {_DEMAND_KEYS}, x.s AS scenario, round(offered * x.vm, 6) AS scenario_volume, round(a + x.ad, 6) AS scenario_aht_seconds, round(offered * x.vm * (a + x.ad) / 900.0, 6) AS required_productive_fte,
    round(offered * x.vm * (a + x.ad) / 900.0 / (1 - x.sh), 6) AS required_scheduled_fte, x.fd AS scenario_fte_delta
    FROM (SELECT *, handle_seconds / nullif(handled, 0) AS a FROM {_DEMAND}) CROSS JOIN (VALUES ('peak', 1.1::DOUBLE, 30.0::DOUBLE, 0.0::DOUBLE, 0.31::DOUBLE), ('lean', 0.9, 0.0, -3.0, 0.25)) x(s, vm, ad, fd, sh)"""
)
def scenario_apply(spark, sf):
    """DX-13."""
    scenarios = [
        {"name": "peak", "volume_multiplier": 1.1, "aht_delta_seconds": 30, "additional_fte": 0, "shrinkage": 0.31},
        {"name": "lean", "volume_multiplier": 0.9, "aht_delta_seconds": 0, "additional_fte": -3, "shrinkage": 0.25},
    ]
    out = staffing.apply_scenarios(_load(spark, sf), scenarios)
    return out.select(
        "business_date", "interval_start", "service_scope", "scenario", "scenario_volume", "scenario_aht_seconds",
        "required_productive_fte", "required_scheduled_fte", "scenario_fte_delta",
    )


def _ladder(spark, sf):
    """Scope is the agent's line of business on the canonical roster."""
    people = roster.canonical_roster(_roster(spark, sf), _cells(spark, sf)).select(
        F.col("client_id").alias("roster_client_id"), F.col("lob").alias("service_scope")
    )
    shifts = _shifts(spark, sf)
    overlay = attendance.time_off_overlay(shifts, roster.canonical_time_off(_time_off(spark, sf)))
    working = shifts.filter("assignment_type <> 'Planned absence'")
    gaps = attendance.attendance_gaps(_model(spark, sf))
    scoped = lambda df: df.join(people, "roster_client_id")
    span = lambda df, s, e: scoped(df).select("service_scope", F.col(s).alias("start"), F.col(e).alias("end"))
    pieces = overlay.join(working.select("roster_client_id", "business_date"), ["roster_client_id", "business_date"]).select(
        "roster_client_id", F.explode("overlay").alias("p")
    ).select("roster_client_id", F.col("p.start").alias("s"), F.col("p.end").alias("e"))
    absent = gaps.filter("gap_type IN ('LATE', 'EARLY_LEAVE', 'NO_SHOW')")
    idle = gaps.filter("gap_type IN ('LOGGED_OFF', 'UNAVAILABLE')")
    return staffing.staffing_ladder(
        span(working, "scheduled_start", "scheduled_end"), span(pieces, "s", "e"),
        span(absent, "gap_start", "gap_end"), span(idle, "gap_start", "gap_end"),
    )


_PEOPLE = """(SELECT client_id AS c, lob FROM by_id UNION ALL SELECT x.roster_client_id, r.lob FROM (
      SELECT roster_client_id, arg_min(roster_row, (source_key, source_row, source_column)) AS rr FROM cells WHERE schedule_state <> 'INVALID' AND scope_match = 'name' AND roster_client_id IS NOT NULL GROUP BY 1) x
    JOIN roster r ON r.source_row = x.rr WHERE x.roster_client_id NOT IN (SELECT client_id FROM by_id))"""
_PIECES = """(SELECT c, s, e, 'scheduled' AS kind FROM shifts WHERE assignment_type <> 'Planned absence'
    UNION ALL SELECT o.c, o.ps, o.pe, 'time_off' FROM overlay o JOIN shifts h ON h.c = o.c AND h.bd = o.bd WHERE h.assignment_type <> 'Planned absence'
    UNION ALL SELECT roster_client_id, gap_start, gap_end, CASE WHEN gap_type IN ('LATE', 'EARLY_LEAVE', 'NO_SHOW') THEN 'absent' ELSE 'idle' END FROM gaps)"""
_GRID = f"""(SELECT lob, kind, q, date_diff('second', greatest(s, q), least(e, q + INTERVAL 15 MINUTE)) AS m FROM (
      SELECT p.*, lob, unnest(generate_series(time_bucket(INTERVAL 15 MINUTE, s), e - INTERVAL 1 MICROSECOND, INTERVAL 15 MINUTE)) AS q FROM {_PIECES} p JOIN {_PEOPLE} x USING (c)))"""
_sec = lambda k: f"coalesce(sum(m) FILTER (WHERE kind = '{k}'), 0)::BIGINT"
_fte = lambda *kinds: f"({' - '.join(map(_sec, kinds))})::DOUBLE / 900.0::DOUBLE"
_LADDER = f"""(SELECT lob AS service_scope, q AS interval_start, {_fte('scheduled')} AS scheduled_fte, {_fte('scheduled', 'time_off')} AS available_fte,
    {_fte('scheduled', 'time_off', 'absent')} AS present_fte, {_fte('scheduled', 'time_off', 'absent', 'idle')} AS effective_fte FROM {_GRID} GROUP BY 1, 2)"""


@query(
    f"""SELECT service_scope, {day('interval_start')} AS business_date, {iso('interval_start')} AS interval_start, round(scheduled_fte, 6) AS scheduled_fte, round(available_fte, 6) AS available_fte,
    round(present_fte, 6) AS present_fte, round(effective_fte, 6) AS effective_fte FROM {_LADDER}"""
)
def staffing_ladder(spark, sf):
    """DX-11."""
    return _ladder(spark, sf)


def _gapped(spark, sf):
    """Requirement rule of the testbed: half of the scheduled FTE plus one.

    The ladder meets a requirement derived from itself: as a stage it is worked out once, not once per side.
    """
    ladder = _silver(spark, sf, "staffing_ladder", _ladder)
    need = ladder.select(
        "service_scope", "interval_start", (F.col("scheduled_fte") * 0.5 + 1.0).alias("required_productive_fte")
    )
    return staffing.staffing_gap(ladder, need, ["service_scope", "interval_start"])


@query(
    f"""SELECT service_scope, {iso('interval_start')} AS interval_start, round(g, 6) AS staffing_gap, round(CASE WHEN g >= 0 THEN 0.0 ELSE least(abs(g) / 5.0, 1.0) END, 6) AS risk_score,
    CASE WHEN g >= 0 THEN 'safe' WHEN least(abs(g) / 5.0, 1.0) >= 0.6 THEN 'critical' WHEN least(abs(g) / 5.0, 1.0) >= 0.3 THEN 'risk' ELSE 'watch' END AS severity
    FROM (SELECT *, round(effective_fte - (scheduled_fte * 0.5::DOUBLE + 1.0::DOUBLE), 6) AS g FROM {_LADDER})"""
)
def risk_table(spark, sf):
    """PR-10 / FN-33."""
    rated = staffing.risk_table(_gapped(spark, sf))
    return rated.select("service_scope", "interval_start", "staffing_gap", "risk_score", "severity")


@query(
    f"""SELECT service_scope, floor(sum(round(greatest(-g, 0) * 1e6)::BIGINT) * 0.25::DOUBLE) / 1e6 AS fte_hours_under, floor(sum(round(greatest(g, 0) * 1e6)::BIGINT) * 0.25::DOUBLE) / 1e6 AS fte_hours_over,
    round(1 - sum(round(greatest(-g, 0) * 1e6)::BIGINT)::DOUBLE / nullif(sum(round(need * 1e6)::BIGINT), 0)::DOUBLE, 6) AS coverage_fit
    FROM (SELECT *, scheduled_fte * 0.5::DOUBLE + 1.0::DOUBLE AS need, round(effective_fte - (scheduled_fte * 0.5::DOUBLE + 1.0::DOUBLE), 6) AS g FROM {_LADDER}) GROUP BY 1"""
)
def coverage_quality(spark, sf):
    """DX-12."""
    return staffing.coverage_quality(_gapped(spark, sf), ["service_scope"])


@query(
    f"""SELECT service_scope, comparison_scope, {iso('interval_start')} AS interval_start, need AS required, n AS agent_count, (need <= 2 * n)::INT AS feasible,
    CASE WHEN need <= 2 * n THEN greatest(need - n, 0) END AS shortage, CASE WHEN need <= 2 * n THEN least(need, n) END AS assigned
    FROM (SELECT service_scope, comparison_scope, interval_start, sum(offered)::BIGINT AS need, (sum(answered) // 2 + 1)::BIGINT AS n FROM intervals GROUP BY ALL)"""
)
def coverage_shortage(spark, sf):
    """PR-12."""
    needs = _intervals(spark, sf).groupBy(*SCOPE, "interval_start").agg(
        F.sum("offered").alias("required"), (F.floor(F.sum("answered") / 2) + 1).alias("agent_count")
    )
    return staffing.coverage_shortage(needs)


@query(
    """SELECT decision_id, d.scope AS service_scope, sum(offered) FILTER (WHERE interval_end <= t)::BIGINT AS baseline_offered, sum(offered) FILTER (WHERE interval_start >= t)::BIGINT AS outcome_offered,
    round(sum(w) FILTER (WHERE interval_end <= t) / sum(offered) FILTER (WHERE interval_end <= t)::DOUBLE, 6) AS baseline_service_level,
    round(sum(w) FILTER (WHERE interval_start >= t) / sum(offered) FILTER (WHERE interval_start >= t)::DOUBLE, 6) AS outcome_service_level,
    round(sum(w) FILTER (WHERE interval_start >= t) / sum(offered) FILTER (WHERE interval_start >= t)::DOUBLE - sum(w) FILTER (WHERE interval_end <= t) / sum(offered) FILTER (WHERE interval_end <= t)::DOUBLE, 6) AS service_impact
    FROM (SELECT o_orderkey AS decision_id, ['Alpha FR', 'Beta NL', 'Gamma'][(o_orderkey % 3 + 1)::INT] AS scope, TIMESTAMP '2024-01-01' + to_minutes((o_orderkey * 37) % 43200) AS t, (30 + o_orderkey % 120)::INT AS width FROM orders) d
    LEFT JOIN (SELECT service_scope, interval_start, interval_end, sum(offered) AS offered, sum(answered_within_target) AS w FROM intervals GROUP BY ALL) i
      ON i.service_scope = d.scope AND i.interval_start < t + to_minutes(width) AND i.interval_end > t - INTERVAL 60 MINUTE GROUP BY 1, 2"""
)
def decision_outcomes(spark, sf):
    """DX-14: each order stands for a decision."""
    decisions = shape.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS decision_id",
        "element_at(array('Alpha FR', 'Beta NL', 'Gamma'), cast(o_orderkey % 3 AS int) + 1) AS service_scope",
        "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast((o_orderkey * 37) % 43200 AS int)) AS decided_at",
        "cast(30 + o_orderkey % 120 AS int) AS outcome_window_minutes",
    )
    return staffing.decision_outcomes(decisions, _intervals(spark, sf))


@query(
    """SELECT file_name, coalesce(CASE WHEN k = 'PLANALPHA' THEN 'Alpha FR' END, '') AS service_scope, coalesce(CASE WHEN k = 'PLANALPHA' THEN 'Alpha' END, '') AS comparison_scope, n AS row_count
    FROM (SELECT CASE WHEN event_type = 'click' THEN 'plan-alpha.csv' ELSE 'plan-' || event_type || '.csv' END AS file_name, CASE WHEN event_type = 'click' THEN 'PLANALPHA' END AS k, count(*)::BIGINT AS n FROM events GROUP BY ALL)"""
)
def forecast_file_mapping(spark, sf):
    """DX-17."""
    files = shape.table(spark, sf, "events").selectExpr(
        "CASE WHEN event_type = 'click' THEN 'plan-alpha.csv' ELSE concat('plan-', event_type, '.csv') END AS file_name"
    ).groupBy("file_name").agg(F.count("*").alias("row_count"))
    mapped = ident.map_forecast_files(files, shape.mapping(spark))
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return mapped.select("file_name", text("service_scope"), text("comparison_scope"), "row_count")


@query(
    """SELECT doc_id, sha256(text || '|x|I|7|2024-01-01 00:00:00|') AS call_key FROM documents"""
)
def call_key_hash(spark, sf):
    """FN-21 over whole texts as references."""
    docs = shape.table(spark, sf, "documents")
    key = call_key(
        F.col("text"), F.lit("x"), F.lit("I"), F.lit("7"), F.lit("2024-01-01 00:00:00").cast(NTZ), F.lit(None), F.lit("{}")
    )
    return docs.select("doc_id", key.alias("call_key"))


@query()
def folded_texts(spark, sf):
    """FN-03 over whole texts; checked against Unicode's own folding in the tests."""
    return shape.table(spark, sf, "documents").select("doc_id", F.md5(fold_name(F.col("text"))).alias("folded_md5"))


# --- read products -----------------------------------------------------------

_PAGE_DAY = "business_date = (SELECT max(business_date) FROM intervals)"
_PAGE_SCOPE = "service_scope = 'Alpha FR' AND comparison_scope = 'Alpha'"


def _latest_day(spark, sf) -> str:
    return _intervals(spark, sf).agg(F.max("business_date")).first()[0].isoformat()


@query(
    f"""SELECT 'scope' AS part, service_scope || ' / ' || comparison_scope AS label, count(DISTINCT 1)::BIGINT AS n, 0::BIGINT AS amount FROM intervals WHERE {_PAGE_DAY} GROUP BY service_scope, comparison_scope
    UNION ALL SELECT 'interval', {iso('interval_start')}, sum(offered)::BIGINT, sum(handled_seconds)::BIGINT FROM intervals WHERE {_PAGE_DAY} AND {_PAGE_SCOPE} GROUP BY interval_start
    UNION ALL SELECT 'state', evidence_state, count(*)::BIGINT, 0 FROM agent_day WHERE {_PAGE_DAY} GROUP BY evidence_state
    UNION ALL SELECT 'gap', gap_type, count(*)::BIGINT, sum(gap_minutes)::BIGINT FROM gaps WHERE {_PAGE_DAY} GROUP BY gap_type"""
)
def operate_evidence(spark, sf):
    """PR-07: the whole page of the latest date and one scope."""
    model = _model(spark, sf)
    page = evidence.operate_evidence(
        _intervals(spark, sf), attendance.agent_days(model), attendance.attendance_gaps(model), _latest_day(spark, sf), "Alpha FR", "Alpha"
    )
    row = lambda df, part, label, n, amount: df.select(
        F.lit(part).alias("part"), label.alias("label"), n.cast("bigint").alias("n"), amount.cast("bigint").alias("amount")
    )
    zero = F.lit(0)
    scope = F.concat_ws(" / ", "service_scope", "comparison_scope")
    parts = [
        row(page["scopes"], "scope", scope, F.lit(1), zero),
        row(page["intervals"], "interval", F.date_format("interval_start", "yyyy-MM-dd'T'HH:mm:ss"), F.col("offered"), F.col("handled_seconds")),
        row(page["states"], "state", F.col("evidence_state"), F.col("agent_days"), zero),
        row(page["gaps"], "gap", F.col("gap_type"), F.col("fragments"), F.col("minutes")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_PARITY = f"FROM intervals WHERE {_PAGE_DAY} AND upper(queue) IN ('Q CLICK', 'Q-CLICK', 'Q PURCHASE', 'Q-PURCHASE')"


@query(
    f"""SELECT 'hour' AS part, strftime(date_trunc('hour', interval_start), '%H') AS label, sum(offered)::BIGINT AS offered, sum(answered)::BIGINT AS answered {_PARITY} GROUP BY 2
    UNION ALL SELECT 'total', '', sum(offered)::BIGINT, sum(answered)::BIGINT {_PARITY}"""
)
def flash_parity(spark, sf):
    """PR-08: hours and totals of one profile on the latest date."""
    found = evidence.flash_parity(_intervals(spark, sf), shape.PROFILES[:1], _latest_day(spark, sf))
    pick = lambda df, part, label: df.select(F.lit(part).alias("part"), label.alias("label"), "offered", "answered")
    return pick(found["hours"], "hour", F.date_format("hour_start", "HH")).unionByName(pick(found["totals"], "total", F.lit("")))


@query(f"SELECT {day('business_date')} AS business_date, {iso('interval_start')} AS interval_start, {iso('interval_end')} AS interval_end, sum(offered)::BIGINT AS offered, sum(handled_seconds)::BIGINT AS handled_seconds FROM intervals WHERE upper(queue) IN ('Q CLICK', 'Q-CLICK', 'Q PURCHASE', 'Q-PURCHASE') GROUP BY ALL")
def flash_intervals(spark, sf):
    """AG-03: profile sums per interval, across scopes."""
    found = evidence.flash_intervals(_intervals(spark, sf), shape.PROFILES[0])
    return found.select("business_date", "interval_start", "interval_end", "offered", "handled_seconds")
