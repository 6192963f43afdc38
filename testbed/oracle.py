"""SQL checks: the expected domain tables written directly as values, then the same questions.

The Spark side renders text extracts and parses them; this side never parses,
it states the values the extracts stand for. `sql(select)` prefixes a query with
the common table expressions it mentions.
"""

from __future__ import annotations

import re

from testbed.shape import AS_OF, DAYS, MAPPING_ROWS

NOW = f"TIMESTAMP '{AS_OF:%Y-%m-%d %H:%M:%S}'"


def iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S')"


def day(d: str) -> str:
    return f"strftime({d}, '%Y-%m-%d')"


def minutes(start: str, end: str) -> str:
    return f"greatest(0, floor((epoch({end}) - epoch({start})) / 60))::BIGINT"


_NAME = "'Customer#' || lpad({}::VARCHAR, 9, '0')"
_KEY = "lower(regexp_replace({}, '[^A-Za-z0-9]+', ' ', 'g'))"
_MEASURES = (
    "offered", "answered", "abandoned", "short_abandoned", "abandoned_within_target",
    "answered_within_target", "talk_seconds", "hold_seconds", "wrap_seconds", "handled_seconds",
    "call_legs", "transferred_legs",
)


def sums(prefix: str = "") -> str:
    return ", ".join(f"sum({prefix}{m})::BIGINT AS {m}" for m in _MEASURES)


def _elig(alias: str, d: str) -> str:
    return f"({alias}.status = 'Active' OR ({alias}.status = 'Leaver' AND {d} <= {alias}.end_date))"


def _resolve(source: str, id_: str, name: str, d: str) -> str:
    """Adds canonical id and match kind to the rows of `source`."""
    return f"""
      SELECT f.*,
        CASE WHEN i.client_id IS NOT NULL AND {_elig('i', f'f.{d}')} THEN 'id'
             WHEN i.client_id IS NULL AND f.{id_} IS NOT NULL AND u.name_key IS NOT NULL AND {_elig('u', f'f.{d}')} THEN 'name'
             ELSE 'none' END AS scope_match,
        CASE WHEN (i.client_id IS NOT NULL AND {_elig('i', f'f.{d}')})
               OR (i.client_id IS NULL AND u.name_key IS NOT NULL AND {_elig('u', f'f.{d}')}) THEN f.{id_} END AS roster_client_id,
        coalesce(i.source_row, u.source_row) AS roster_row
      FROM {source} f
      LEFT JOIN by_id i ON f.{id_} = i.client_id
      LEFT JOIN unique_names u ON i.client_id IS NULL AND u.name_key = {_KEY.format(f'f.{name}')}"""


_mapping_values = ", ".join(str(row) for row in MAPPING_ROWS)

CTES: dict[str, str] = {
    # --- roster ---
    "roster0": f"""
      SELECT c_custkey + 2 AS source_row,
        CASE WHEN c_custkey % 40 = 13 THEN NULL
             ELSE (c_custkey - CASE WHEN c_custkey % 50 = 49 THEN 1 ELSE 0 END)::VARCHAR END AS client_id,
        CASE WHEN c_custkey % 12 = 11 THEN NULL WHEN c_acctbal < 0 THEN 'Leaver' ELSE 'Active' END AS status,
        CASE WHEN c_custkey % 97 = 5 THEN NULL
             ELSE {_NAME.format('(c_custkey - CASE WHEN c_custkey % 30 = 17 THEN 1 ELSE 0 END)')} END AS agent_name,
        c_custkey % 83 = 9 AS bad_end,
        CASE WHEN c_custkey % 83 = 9 THEN NULL WHEN c_acctbal < 0 AND c_custkey % 25 <> 7 THEN DATE '2024-01-15'
             WHEN c_acctbal >= 0 AND c_custkey % 60 = 5 THEN DATE '2024-02-01' END AS end_date,
        c_custkey % 33 = 2 AS missing_fte,
        c_custkey % 33 <> 2 AND c_custkey % 77 = 3 AS bad_fte,
        CASE WHEN c_custkey % 33 = 2 OR c_custkey % 77 = 3 THEN NULL WHEN c_custkey % 91 = 4 THEN -1.0
             ELSE (c_custkey % 5) / 4.0 END::DOUBLE AS fte,
        c_mktsegment AS lob
      FROM customer""",
    "roster1": """
      SELECT *, agent_name IS NOT NULL AND status IS NOT NULL AND NOT (status = 'Leaver' AND end_date IS NULL)
             AND NOT (status = 'Active' AND end_date IS NOT NULL) AND NOT bad_end AND NOT bad_fte
             AND NOT coalesce(fte < 0, false) AS ok,
        count(*) OVER (PARTITION BY client_id) > 1 AND client_id IS NOT NULL AS dup
      FROM roster0""",
    "roster": """
      SELECT *, ok AND (NOT dup OR row_number() OVER (PARTITION BY client_id, ok
          ORDER BY (status = 'Active')::INT DESC, coalesce(end_date, DATE '0001-01-01') DESC, source_row DESC) = 1) AS valid
      FROM roster1""",
    "by_id": "SELECT * FROM roster WHERE valid AND client_id IS NOT NULL",
    "unique_names": f"""
      SELECT {_KEY.format('agent_name')} AS name_key, any_value(status) AS status, any_value(end_date) AS end_date,
        any_value(source_row) AS source_row
      FROM roster WHERE valid AND agent_name IS NOT NULL GROUP BY 1 HAVING count(*) = 1""",
    # --- registers ---
    "off0": """
      SELECT o_orderkey AS o, o_orderkey + 2 AS source_row, o_orderpriority IN ('1-URGENT', '2-HIGH') AS pto,
        o_custkey::VARCHAR AS client_id, o_orderkey % 53 = 0 AS bad_start,
        (DATE '2024-01-01' + (o_orderkey % 365)::INT) AS d0, o_orderstatus AS st, o_orderkey % 41 = 0 AS no_type
      FROM orders""",
    "off1": """
      SELECT *, CASE WHEN bad_start THEN NULL ELSE d0 END AS start_date,
        CASE WHEN pto THEN (d0 + (CASE WHEN o % 2 = 0 THEN o % 3 WHEN o % 50 = 1 THEN 1 ELSE 0 END)::INT)
             WHEN o % 6 = 0 THEN NULL WHEN o % 61 = 4 THEN DATE '2023-01-01' ELSE (d0 + (o % 5)::INT) END AS end_date,
        CASE WHEN NOT pto OR o % 2 = 0 THEN 'FULL_DAY' WHEN o % 67 = 5 THEN NULL ELSE 'PARTIAL_DAY' END AS day_coverage,
        CASE WHEN o % 3 = 0 THEN 30600 ELSE 50400 END AS s0,
        CASE WHEN o % 3 = 0 THEN 38700 WHEN o % 19 = 1 THEN 46800 ELSE 62100 END AS e0
      FROM off0""",
    "off2": """
      SELECT f.*, b.client_id IS NULL AS unknown_client,
        list_filter([
          CASE WHEN b.client_id IS NULL THEN 'TIME_OFF_CLIENT_NOT_IN_ROSTER' END,
          CASE WHEN start_date IS NULL THEN 'INVALID_START_DATE' END,
          CASE WHEN f.end_date < start_date THEN 'END_DATE_BEFORE_START' END,
          CASE WHEN pto AND day_coverage IS NULL THEN 'INVALID_DAY_COVERAGE' END,
          CASE WHEN pto AND day_coverage = 'PARTIAL_DAY' AND start_date <> f.end_date THEN 'PARTIAL_PTO_MULTIPLE_DATES' END,
          CASE WHEN pto AND day_coverage = 'PARTIAL_DAY' AND e0 <= s0 THEN 'INVALID_PARTIAL_PTO_TIME' END,
          CASE WHEN pto AND no_type THEN 'MISSING_PTO_TYPE' END,
          CASE WHEN NOT pto AND no_type THEN 'MISSING_AWAY_TYPE' END,
          CASE WHEN NOT pto AND f.end_date IS NULL AND st <> 'O' THEN 'OPEN_END_ONLY_FOR_ACTIVE_AWAY' END
        ], lambda x: x IS NOT NULL) AS codes
      FROM off1 f LEFT JOIN (SELECT DISTINCT client_id FROM by_id) b USING (client_id)""",
    "time_off": """
      SELECT *, len(codes) = 0 AS valid, len(codes) = 0 AND (NOT pto OR st = 'F') AS eligible FROM off2""",
    # --- schedule ---
    "grid": f"""
      SELECT user_id AS u, d, DATE '2024-01-01' + (d - 1)::INT AS business_date
      FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN (SELECT unnest(range(1, {DAYS + 1})) AS d)""",
    "cells0": """
      SELECT *, 'schedule/base.txt' AS source_key, TIMESTAMP '2023-12-20' AS mtime,
        business_date::TIMESTAMP + to_hours([8, 14, 22][(u % 3 + 1)::INT]) AS s,
        CASE WHEN (u + d) % 7 = 0 THEN 'Off' WHEN (u * 3 + d) % 11 = 0 THEN NULL WHEN (u + 2 * d) % 97 = 5 THEN 'tbc'
             WHEN (u * 7 + d) % 89 = 3 THEN 'inverted' WHEN (u + d) % 10 = 0 THEN 'Training'
             WHEN (u + d) % 10 = 1 THEN 'Annual Leave' ELSE 'Work' END AS kind
      FROM grid
      UNION ALL
      SELECT *, 'schedule/rev.txt', TIMESTAMP '2023-12-28',
        business_date::TIMESTAMP + to_hours([9, 15, 23][(u % 3 + 1)::INT]),
        CASE WHEN (u + d) % 4 = 0 THEN 'Revised' END
      FROM grid""",
    "cells1": f"""
      SELECT u::VARCHAR AS id, {_NAME.format('u')} AS name, u + 2 AS source_row, d + 2 AS source_column,
        business_date, source_key, mtime, kind,
        CASE WHEN kind NOT IN ('Off', 'tbc') THEN s END AS scheduled_start,
        CASE WHEN kind = 'inverted' THEN s - INTERVAL 1 HOUR WHEN kind NOT IN ('Off', 'tbc') THEN s + INTERVAL 8 HOUR END AS scheduled_end,
        CASE kind WHEN 'Off' THEN 'Off' WHEN 'Training' THEN 'Training' WHEN 'Annual Leave' THEN 'Annual Leave'
             WHEN 'tbc' THEN 'Work tbc' WHEN 'Revised' THEN 'Revised' ELSE 'Work' END AS assignment,
        CASE kind WHEN 'Off' THEN 'Off' WHEN 'Training' THEN 'Non-phone planned' WHEN 'Annual Leave' THEN 'Planned absence'
             ELSE 'Work' END AS assignment_type,
        CASE WHEN kind = 'Off' THEN 'OFF' WHEN kind IN ('tbc', 'inverted') THEN 'INVALID' ELSE 'SHIFT' END AS schedule_state
      FROM cells0 WHERE kind IS NOT NULL""",
    "cells": _resolve("cells1", "id", "name", "business_date"),
    "schedule": """
      SELECT * FROM cells WHERE schedule_state <> 'INVALID' AND roster_client_id IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY roster_client_id, business_date
        ORDER BY mtime DESC, source_key DESC, source_row DESC, source_column DESC) = 1""",
    # --- status and LILO ---
    "status0": f"""
      SELECT event_id + 2 AS source_row, ['status/a.csv', 'status/b.csv', 'status/c.csv'][(event_id % 3 + 1)::INT] AS source_key,
        CASE WHEN event_id % 29 = 0 THEN NULL ELSE date_trunc('second', ts) END AS status_start,
        CASE WHEN event_id % 23 = 0 THEN 0 ELSE 3600 + (event_id * 7919) % 39600 END AS seconds,
        CASE WHEN event_id % 31 = 0 THEN 'X' || user_id WHEN event_id % 37 = 0 THEN 'Y' || user_id ELSE user_id::VARCHAR END AS id,
        CASE WHEN event_id % 31 = 0 THEN 'Ghost' ELSE {_NAME.format('user_id')} END AS name,
        CASE event_type WHEN 'purchase' THEN 'Lunch' WHEN 'error' THEN 'Logged Off' WHEN 'signup' THEN 'Unavailable' ELSE 'Productive' END AS category,
        event_type IN ('click', 'purchase') AS label_mapped
      FROM events""",
    "status1": """
      SELECT *, status_start + to_seconds(seconds) AS status_end, status_start::DATE AS extract_date FROM status0""",
    "status2": _resolve("status1", "id", "name", "extract_date"),
    "status_lanes": """
      SELECT *, CASE WHEN status_start IS NULL OR seconds <= 0 THEN 'invalid' WHEN scope_match = 'none' THEN 'outside' ELSE 'accepted' END AS lane
      FROM status2""",
    "status": "SELECT * FROM status_lanes WHERE lane = 'accepted'",
    "lilo0": """
      SELECT user_id, ts::DATE AS extract_date, date_trunc('second', min(ts)) AS a, date_trunc('second', max(ts)) AS b,
        user_id + any_value(day(ts)) AS n
      FROM events GROUP BY 1, 2""",
    "lilo1": f"""
      SELECT user_id::VARCHAR AS id, {_NAME.format('user_id')} AS name, extract_date, 'lilo/' || {day('extract_date')} || '.csv' AS source_key,
        CASE WHEN n % 9 = 0 THEN NULL WHEN n % 5 = 0 THEN b ELSE a END AS first_login,
        CASE WHEN n % 9 = 0 OR n % 13 = 0 THEN NULL WHEN n % 5 = 0 THEN a ELSE b END AS raw_last
      FROM lilo0""",
    "lilo_lanes": """
      SELECT *, CASE WHEN raw_last < first_login THEN raw_last + INTERVAL 1 DAY ELSE raw_last END AS last_logout,
        coalesce(raw_last < first_login, false) AS adjusted,
        CASE WHEN scope_match = 'none' THEN 'outside' ELSE 'accepted' END AS lane
      FROM (""" + _resolve("lilo1", "id", "name", "extract_date") + ")",
    "lilo": "SELECT * FROM lilo_lanes WHERE lane = 'accepted'",
    # --- attendance ---
    "shifts": f"""
      SELECT roster_client_id AS c, business_date AS bd, assignment, assignment_type, scheduled_start AS s, scheduled_end AS e, source_key,
        CASE WHEN {NOW} > scheduled_start THEN least(scheduled_end, {NOW}) ELSE scheduled_start END AS ee
      FROM schedule WHERE schedule_state <> 'OFF'""",
    "off_hits": """
      SELECT c, bd, s, e, day_coverage,
        CASE WHEN day_coverage = 'PARTIAL_DAY' THEN start_date::TIMESTAMP + to_seconds(s0) WHEN s::DATE BETWEEN start_date AND coalesce(end_date, start_date) THEN s END AS ps,
        CASE WHEN day_coverage = 'PARTIAL_DAY' THEN start_date::TIMESTAMP + to_seconds(e0) WHEN s::DATE BETWEEN start_date AND coalesce(end_date, start_date) THEN e END AS pe
      FROM shifts JOIN (SELECT client_id, day_coverage, start_date, end_date, s0, e0 FROM time_off WHERE eligible) t ON t.client_id = c
        AND start_date <= e::DATE AND coalesce(end_date, start_date) >= s::DATE""",
    "off_sources": "SELECT DISTINCT c, bd FROM off_hits",
    "overlay0": """
      SELECT c, bd, greatest(ps, s) AS ps, least(pe, e) AS pe FROM off_hits WHERE ps IS NOT NULL AND greatest(ps, s) < least(pe, e)
      UNION ALL SELECT c, bd, s, e FROM shifts WHERE assignment_type = 'Planned absence'""",
    "overlay": """
      SELECT c, bd, min(ps) AS ps, max(pe) AS pe FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY c, bd ORDER BY ps, pe ROWS UNBOUNDED PRECEDING) AS island FROM (
          SELECT *, CASE WHEN ps > max(pe) OVER (PARTITION BY c, bd ORDER BY ps, pe ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh
          FROM overlay0))
      GROUP BY c, bd, island""",
    "working": """
      SELECT c, bd, ws, we FROM (
        SELECT c, bd, lag(pe) OVER w AS ws, ps AS we FROM (
          SELECT c, bd, s AS ps, s AS pe, 0 AS o FROM shifts UNION ALL SELECT c, bd, ps, pe, 1 FROM overlay
          UNION ALL SELECT c, bd, e, e, 2 FROM shifts)
        WINDOW w AS (PARTITION BY c, bd ORDER BY ps, pe, o)) WHERE ws IS NOT NULL AND we > ws""",
    "clipped": """
      SELECT h.c, h.bd, greatest(h.s, t.status_start) AS s, least(h.ee, t.status_end) AS e, t.category, t.source_key, t.source_row
      FROM shifts h JOIN status t ON t.roster_client_id = h.c AND t.status_start < h.ee AND t.status_end > h.s AND h.ee > h.s""",
    "edges": "SELECT DISTINCT c, bd, x FROM (SELECT c, bd, s AS x FROM clipped UNION ALL SELECT c, bd, e FROM clipped)",
    "slots": "SELECT c, bd, x AS l, lead(x) OVER (PARTITION BY c, bd ORDER BY x) AS r FROM edges",
    "segments": """
      SELECT k.c, k.bd, l, r, category, source_key FROM slots k JOIN clipped t ON t.c = k.c AND t.bd = k.bd AND t.s <= l AND t.e > l
      WHERE r IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY k.c, k.bd, l ORDER BY t.s DESC, source_key DESC, source_row DESC) = 1""",
    "pieces": """
      SELECT g.c, g.bd, greatest(l, ws) AS s, least(r, we) AS e, category FROM segments g JOIN working w ON w.c = g.c AND w.bd = g.bd AND l < we AND r > ws""",
    "piece_sums": f"""
      SELECT c, bd, sum({minutes('s', 'e')})::BIGINT AS covered, count(*) AS n, count(*) FILTER (WHERE category <> 'Logged Off') AS present,
        min(s) FILTER (WHERE category <> 'Logged Off') AS sf, max(e) FILTER (WHERE category <> 'Logged Off') AS sl
      FROM pieces GROUP BY 1, 2""",
    "work_sums": f"""
      SELECT c, bd, sum({minutes('ws', 'we')})::BIGINT AS work, coalesce(sum({minutes('ws', f'least(we, {NOW})')}) FILTER (WHERE ws < {NOW}), 0)::BIGINT AS elapsed
      FROM working GROUP BY 1, 2""",
    "over_sums": f"SELECT c, bd, sum({minutes('ps', 'pe')})::BIGINT AS planned FROM overlay GROUP BY 1, 2",
    "seg_sums": "SELECT c, bd, list(DISTINCT source_key) AS src FROM clipped GROUP BY 1, 2",
    "shift_dates": """
      SELECT c, bd, s, e, unnest(generate_series(s::DATE, (e - INTERVAL 1 MICROSECOND)::DATE, INTERVAL 1 DAY))::DATE AS x FROM shifts""",
    "lilo_sums": """
      SELECT k.c, k.bd, min(first_login) FILTER (WHERE first_login BETWEEN s - INTERVAL 4 HOUR AND e) AS lf,
        max(last_logout) FILTER (WHERE last_logout BETWEEN s AND e + INTERVAL 4 HOUR) AS ll, count(o.id) AS n,
        list(DISTINCT o.source_key) FILTER (WHERE o.source_key IS NOT NULL) AS src,
        bool_and(x IN (SELECT extract_date FROM status)) AS status_loaded, bool_and(x IN (SELECT extract_date FROM lilo)) AS lilo_loaded
      FROM shift_dates k LEFT JOIN lilo o ON o.roster_client_id = k.c AND o.extract_date = k.x GROUP BY 1, 2""",
    "day1": f"""
      SELECT h.*, coalesce(covered, 0) AS covered, coalesce(p.n, 0) AS np, coalesce(present, 0) AS present, sf, sl,
        coalesce(work, 0) AS work, coalesce(elapsed, 0) AS elapsed, coalesce(planned, 0) AS planned,
        g.src IS NOT NULL AS has_status, coalesce(g.src, []) AS status_src, coalesce(o.src, []) AS lilo_src, f.c IS NOT NULL AS has_off,
        lf, ll, o.n > 0 AS lilo_row, status_loaded, lilo_loaded, {minutes('s', 'e')} AS scheduled,
        assignment_type = 'Planned absence' AS absence
      FROM shifts h LEFT JOIN piece_sums p USING (c, bd) LEFT JOIN work_sums w USING (c, bd) LEFT JOIN over_sums v USING (c, bd)
        LEFT JOIN seg_sums g USING (c, bd) LEFT JOIN lilo_sums o USING (c, bd) LEFT JOIN off_sources f USING (c, bd)""",
    "day2": "SELECT *, CASE WHEN elapsed > 0 THEN covered / elapsed::DOUBLE ELSE 0.0 END AS ratio FROM day1",
    "day3": f"""
      SELECT *, has_status AND ratio >= 0.8 AS is_primary, np > 0 AND present = 0 AND ratio >= 0.8 AS disconnected,
        lilo_loaded AND lilo_row AND lf IS NULL AND ll IS NULL AS blank_lilo,
        CASE WHEN has_status AND ratio >= 0.8 AND sf IS NOT NULL THEN sf ELSE least(CASE WHEN lf <= {NOW} THEN lf END, sf) END AS fs,
        CASE WHEN has_status AND ratio >= 0.8 AND sl IS NOT NULL THEN sl ELSE greatest(CASE WHEN ll IS NOT NULL THEN least(ll, {NOW}) END, sl) END AS ls
      FROM day2""",
    "day4": f"""
      SELECT *, coalesce(ls >= fs AND ls > s AND fs < e, false) AS usable, {NOW} >= e AS complete, {NOW} >= s AND {NOW} < e AS running FROM day3""",
    "late": f"""
      SELECT d.c, d.bd, greatest(ws, s) AS gs, least(we, fs, e) AS ge FROM day4 d JOIN working w USING (c, bd)
      WHERE usable AND fs > s AND ws < least(fs, e)""",
    "early": """
      SELECT d.c, d.bd, greatest(ws, ls, s) AS gs, least(we, e) AS ge FROM day4 d JOIN working w USING (c, bd)
      WHERE usable AND complete AND e > ls AND we > greatest(ls, s)""",
    "no_show": """
      SELECT d.c, d.bd, ws AS gs, we AS ge FROM day4 d JOIN working w USING (c, bd) WHERE (blank_lilo OR disconnected) AND NOT absence AND complete""",
    "late_sum": f"SELECT c, bd, sum({minutes('gs', 'ge')})::BIGINT AS m FROM late GROUP BY 1, 2 HAVING sum({minutes('gs', 'ge')}) > 5",
    "early_sum": f"SELECT c, bd, sum({minutes('gs', 'ge')})::BIGINT AS m FROM early GROUP BY 1, 2 HAVING sum({minutes('gs', 'ge')}) > 5",
    "no_show_sum": f"SELECT c, bd, sum({minutes('gs', 'ge')})::BIGINT AS m FROM no_show GROUP BY 1, 2",
    "day5": """
      SELECT d.*, coalesce(a.m, 0) AS late_m, coalesce(b.m, 0) AS early_m, coalesce(n.m, 0) AS no_show_m,
        absence OR (scheduled > 0 AND planned >= scheduled) AS excused,
        CASE WHEN lilo_row AND has_status THEN 'LILO+AGENT_STATUS' WHEN lilo_row THEN 'LILO' WHEN has_status THEN 'AGENT_STATUS' ELSE 'NONE' END AS basis
      FROM day4 d LEFT JOIN late_sum a USING (c, bd) LEFT JOIN early_sum b USING (c, bd) LEFT JOIN no_show_sum n USING (c, bd)""",
    "verdicts": f"""
      SELECT *, CASE WHEN excused THEN 'Planned absence|NOT_REQUIRED' WHEN {NOW} < s THEN 'Not started|NOT_STARTED'
        WHEN running AND late_m > 0 THEN 'Late - shift in progress|PROVISIONAL'
        WHEN running AND fs IS NULL AND elapsed > 5 AND (blank_lilo OR disconnected) THEN 'Not seen - shift in progress|PROVISIONAL'
        WHEN running THEN 'Shift in progress|PROVISIONAL'
        WHEN NOT status_loaded AND NOT lilo_loaded THEN 'Data not loaded|UNKNOWN'
        WHEN no_show_m > 0 THEN CASE WHEN planned > 0 THEN 'No show - partial time off' ELSE 'No show' END || '|COMPLETE'
        WHEN fs IS NULL AND ls IS NULL THEN 'Missing actual evidence|UNKNOWN'
        WHEN fs IS NULL OR ls IS NULL THEN 'Incomplete actual evidence|UNKNOWN'
        WHEN NOT usable THEN 'No schedule overlap|UNKNOWN'
        WHEN late_m > 0 AND early_m > 0 THEN 'Late + early leave|COMPLETE' WHEN late_m > 0 THEN 'Late|COMPLETE'
        WHEN early_m > 0 THEN 'Early leave|COMPLETE'
        ELSE CASE WHEN planned > 0 THEN 'Present - partial time off' ELSE 'Present' END || '|COMPLETE' END AS verdict,
        to_json(list_sort(list_distinct([source_key] || status_src || lilo_src || CASE WHEN has_off THEN ['fte/roster.xlsx'] ELSE [] END)))::VARCHAR AS sources
      FROM day5""",
    "agent_day": f"""
      SELECT strftime(bd, '%Y%m%d') || '-' || c AS agent_day_key, bd AS business_date, c AS roster_client_id, assignment, assignment_type, s AS scheduled_start, e AS scheduled_end,
        scheduled AS scheduled_minutes, work AS planned_work_minutes, planned AS planned_time_off_minutes, fs AS actual_first_seen, ls AS actual_last_seen,
        basis AS actual_evidence, covered AS status_covered_minutes, round(ratio, 6) AS status_coverage_ratio, is_primary::INT AS status_is_primary,
        coalesce({minutes('s', 'fs')}, 0)::BIGINT AS raw_late_minutes,
        CASE WHEN excused THEN 0 ELSE late_m END::BIGINT AS late_minutes, CASE WHEN excused THEN 0 ELSE early_m END::BIGINT AS early_leave_minutes,
        CASE WHEN excused THEN 0 ELSE no_show_m END::BIGINT AS no_show_minutes, split_part(verdict, '|', 1) AS attendance_result, split_part(verdict, '|', 2) AS evidence_state,
        status_loaded::INT AS status_source_loaded, lilo_loaded::INT AS lilo_source_loaded, lilo_row::INT AS lilo_row_present, source_key AS schedule_source_key, sources AS source_keys_json
      FROM verdicts
      UNION ALL
      SELECT strftime(business_date, '%Y%m%d') || '-' || roster_client_id, business_date, roster_client_id, assignment, assignment_type, NULL, NULL,
        0, 0, 0, NULL, NULL, 'NONE', 0, 0.0, 0, 0, 0, 0, 0, 'Off', 'NOT_REQUIRED', 0, 0, 0, source_key, '[]'
      FROM schedule WHERE schedule_state = 'OFF'""",
    "runs": """
      SELECT c, bd, category, min(l) AS l, max(r) AS r FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY c, bd, category ORDER BY l ROWS UNBOUNDED PRECEDING) AS island FROM (
          SELECT *, CASE WHEN l > lag(r) OVER (PARTITION BY c, bd, category ORDER BY l) THEN 1 ELSE 0 END AS fresh
          FROM segments WHERE category IN ('Logged Off', 'Unavailable')))
      GROUP BY c, bd, category, island""",
    "run_parts": """
      SELECT x.c, x.bd, x.category, greatest(l, fs, ws) AS gs, least(r, ls, we) AS ge
      FROM runs x JOIN verdicts d USING (c, bd) JOIN working w USING (c, bd)
      WHERE ls > fs AND greatest(l, fs, ws) < least(r, ls, we)""",
    "run_gaps": f"""
      SELECT p.c, p.bd, CASE category WHEN 'Logged Off' THEN 'LOGGED_OFF' ELSE 'UNAVAILABLE' END AS kind, gs, ge,
        (SELECT to_json(list_sort(list(DISTINCT source_key)))::VARCHAR FROM segments g WHERE g.c = p.c AND g.bd = p.bd AND g.category = p.category AND g.l < p.ge AND g.r > p.gs) AS src
      FROM run_parts p WHERE {minutes('gs', 'ge')} > 5""",
    "gap_rows": """
      SELECT c, bd, 'NO_SHOW' AS kind, gs, ge, NULL AS src FROM no_show
      UNION ALL SELECT c, bd, 'LATE', gs, ge, NULL FROM late SEMI JOIN late_sum USING (c, bd)
      UNION ALL SELECT c, bd, 'EARLY_LEAVE', gs, ge, NULL FROM early SEMI JOIN early_sum USING (c, bd)
      UNION ALL SELECT * FROM run_gaps""",
    "gaps": f"""
      SELECT strftime(bd, '%Y%m%d') || '-' || c AS agent_day_key, bd AS business_date, c AS roster_client_id, kind AS gap_type, gs AS gap_start, ge AS gap_end,
        {minutes('gs', 'ge')} AS gap_minutes, CASE WHEN src IS NULL THEN basis ELSE 'AGENT_STATUS' END AS evidence_basis,
        coalesce(src, to_json(list_sort(list_distinct(status_src || lilo_src)))::VARCHAR) AS source_keys_json,
        (CASE WHEN kind IN ('NO_SHOW', 'EARLY_LEAVE') THEN false ELSE running END)::INT AS is_provisional
      FROM gap_rows JOIN verdicts USING (c, bd) WHERE NOT excused""",
    # --- calls ---
    "mapping": f"SELECT * FROM (VALUES {_mapping_values}) t(mapping_type, source_system, source_value, service_scope, designation)",
    "rollups": "SELECT upper(source_value) AS k, service_scope AS comparison FROM mapping WHERE mapping_type = 'scope_rollup'",
    "queues": """
      SELECT m.queue_key, m.service_scope, coalesce(r.comparison, m.service_scope) AS comparison_scope, nullif(designation, '') AS designation FROM (
        SELECT *, regexp_replace(upper(source_value), '[^A-Z0-9]', '', 'g') AS queue_key FROM mapping WHERE mapping_type = 'queue') m
      LEFT JOIN rollups r ON r.k = upper(m.service_scope)
      QUALIFY row_number() OVER (PARTITION BY m.queue_key ORDER BY (source_system = 'STORM')::INT DESC) = 1""",
    "calls0": f"""
      SELECT event_id AS e, event_id + 2 AS source_row, kind, date_trunc('second', ts) AS t0, CASE WHEN event_id % 71 = 0 THEN NULL ELSE date_trunc('second', ts) END AS call_start,
        event_id % 4 = 0 AS agentless, CASE WHEN event_id % 21 <> 0 THEN event_id::VARCHAR END AS ref, CASE WHEN event_id % 42 <> 0 THEN 'C' || event_id END AS call_id,
        CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 31 = 0 THEN 'X' || user_id ELSE user_id::VARCHAR END AS id,
        CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 31 = 0 THEN 'Ghost' ELSE {_NAME.format('user_id')} END AS name,
        CASE WHEN event_id % 4 <> 0 THEN floor(value)::BIGINT END AS talk, CASE WHEN event_id % 4 <> 0 THEN event_id % 7 END AS hold,
        CASE WHEN event_id % 4 <> 0 THEN event_id % 11 END AS wrap, floor(value)::BIGINT AS v,
        CASE WHEN event_id % 43 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'O' WHEN event_id % 4 = 1 THEN 'i' ELSE 'I' END AS direction,
        event_id % 17 <> 0 AND event_id % 59 = 0 AS bad_wait, CASE WHEN event_id % 17 = 0 OR event_id % 59 = 0 THEN NULL ELSE event_id % 60 END AS wait, event_id % 3 AS ring,
        CASE WHEN event_id % 61 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'Q ' || upper(event_type) ELSE 'q-' || event_type END AS queue,
        kind = 'day' AND event_id % 6 = 0 AS transferred, ['fr', 'nl', NULL][(event_id % 3 + 1)::INT] AS language,
        CASE WHEN kind = 'day' THEN 'calls/day-' || strftime(ts, '%Y%m%d') || '.csv' ELSE 'calls/week-' || ((day(ts) - 1) // 7) || '.csv' END AS source_key,
        CASE WHEN kind = 'day' THEN ts::DATE + (1 + CASE WHEN day(ts) % 3 = 0 THEN 9 ELSE 0 END)::INT ELSE DATE '2024-01-01' + (((day(ts) - 1) // 7 + 1) * 7)::INT END AS mtime
      FROM events CROSS JOIN (VALUES ('day'), ('week')) k(kind)""",
    "calls1": "SELECT *, call_start::DATE AS business_date FROM calls0",
    "calls2": _resolve("calls1", "id", "name", "business_date"),
    "call_lanes": """
      SELECT c.*, q.service_scope, q.comparison_scope, q.designation, q.queue_key IS NOT NULL AS mapped, scope_match <> 'none' AS resolved,
        q.queue_key IS NOT NULL AND upper(coalesce(direction, '')) = 'I' AS service_eligible,
        CASE WHEN call_start IS NULL THEN 'invalid' WHEN scope_match <> 'none' OR q.queue_key IS NOT NULL THEN 'accepted' ELSE 'outside' END AS lane,
        list_sort(list_filter([CASE WHEN bad_wait THEN 'INVALID_DURATION' END, CASE WHEN queue IS NULL THEN 'MISSING_QUEUE' END,
          CASE WHEN direction IS NULL THEN 'MISSING_CALL_DIRECTION' END,
          CASE WHEN q.queue_key IS NOT NULL AND upper(coalesce(direction, '')) = 'I' AND wait IS NULL THEN 'MISSING_RESPONSE_CLOCK' END], lambda x: x IS NOT NULL)) AS codes,
        CASE WHEN e % 47 = 0 THEN t0 - INTERVAL 1 HOUR ELSE t0 + to_seconds(v) END AS end0
      FROM calls2 c LEFT JOIN queues q ON q.queue_key = regexp_replace(upper(c.queue), '[^A-Z0-9]', '', 'g')""",
    "legs": """
      SELECT *, CASE WHEN end0 < call_start THEN end0 + INTERVAL 1 DAY ELSE end0 END AS call_end FROM call_lanes WHERE lane = 'accepted'
      QUALIFY row_number() OVER (PARTITION BY coalesce(ref, ''), coalesce(call_id, ''), coalesce(direction, ''), coalesce(roster_client_id, id, ''), call_start,
          CASE WHEN ref IS NULL AND call_id IS NULL THEN kind || e END ORDER BY mtime DESC, source_key DESC, source_row DESC) = 1""",
    "measured": """
      SELECT *, time_bucket(INTERVAL 15 MINUTE, call_start) AS interval_start, coalesce(queue, 'UNNAMED MAPPED QUEUE') AS q, coalesce(designation, '') AS dsg,
        CASE WHEN upper(split_part(service_scope, ' ', -1)) IN ('FR', 'VL', 'NL', 'DE', 'EN') THEN upper(split_part(service_scope, ' ', -1)) ELSE coalesce(upper(language), '(blank)') END AS lang,
        id IS NOT NULL OR coalesce(talk, 0) + coalesce(hold, 0) + coalesce(wrap, 0) > 0 AS answered_b, wait + ring AS clock
      FROM legs WHERE service_eligible""",
    "intervals": """
      SELECT business_date, interval_start, interval_start + INTERVAL 15 MINUTE AS interval_end, service_scope, comparison_scope, q AS queue, dsg AS designation, lang AS language,
        count(*)::BIGINT AS offered, sum(answered_b::INT)::BIGINT AS answered, sum((NOT answered_b)::INT)::BIGINT AS abandoned,
        count(*) FILTER (WHERE NOT answered_b AND clock < 5)::BIGINT AS short_abandoned, count(*) FILTER (WHERE NOT answered_b AND clock >= 5 AND clock < 30)::BIGINT AS abandoned_within_target,
        count(*) FILTER (WHERE answered_b AND clock < 30)::BIGINT AS answered_within_target,
        sum(coalesce(talk, 0))::BIGINT AS talk_seconds, sum(coalesce(hold, 0))::BIGINT AS hold_seconds, sum(coalesce(wrap, 0))::BIGINT AS wrap_seconds,
        sum(coalesce(talk, 0) + coalesce(hold, 0) + coalesce(wrap, 0))::BIGINT AS handled_seconds, count(*)::BIGINT AS call_legs, sum(transferred::INT)::BIGINT AS transferred_legs,
        to_json(list_sort(list(DISTINCT source_key)))::VARCHAR AS source_files_json
      FROM measured GROUP BY ALL""",
    "volume": """
      SELECT service_scope, comparison_scope, business_date, interval_start, sum(offered)::DOUBLE AS actual_volume FROM intervals GROUP BY ALL""",
    "naive": """
      SELECT v.*, h.actual_volume AS forecast_volume, h.actual_volume - v.actual_volume AS signed_error, abs(h.actual_volume - v.actual_volume) AS absolute_error
      FROM volume v JOIN volume h ON h.service_scope = v.service_scope AND h.interval_start = v.interval_start - INTERVAL 7 DAY""",
}


def sql(select: str) -> str:
    """`select` with the common table expressions it needs, in order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(CTES[name])

    visit(select)
    parts = [f"{name} AS ({CTES[name]})" for name in CTES if name in needed]
    return "WITH " + ",\n".join(parts) + "\n" + select if parts else select
