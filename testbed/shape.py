"""Raw text extracts rendered from the driver tables.

Every row of the source table becomes rows of an extract: remainders of keys
only vary the cell contents (blank ids, bad dates, overnight bounds, repeated
exports), they never select rows.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotaspark.plans.evidence import FlashProfile
from rotaspark.policy import AttendancePolicy, ServiceRules

AS_OF = datetime(2024, 1, 20, 12)
FIRST_DAY = date(2024, 1, 1)
DAYS = 30
RULES = ServiceRules(target_seconds=30, short_abandon_seconds=5)
ATTENDANCE = AttendancePolicy()
MAPPING_ROWS = [
    ("scope_rollup", "ANY", "Alpha FR", "Alpha", ""),
    ("scope_rollup", "ANY", "Beta NL", "Alpha", ""),
    ("queue", "STORM", "Q click", "Alpha FR", "primary"),
    ("queue", "STORM", "Q purchase", "Alpha FR", "secondary"),
    ("queue", "ANY", "Q view", "Beta NL", ""),
    ("queue", "STORM", "Q-signup", "Gamma", ""),
    ("queue", "ANY", "Q signup", "Delta", ""),
    ("forecast_file", "PLANNER", "PLAN_ALPHA", "Alpha FR", "plan"),
]
PROFILES = [
    FlashProfile("alpha_day", "Alpha day", date(2024, 1, 1), ("q CLICK", "q-click", "Q purchase", "Q-purchase")),
    FlashProfile("gamma_old", "Gamma", date(2023, 1, 1), ("Q-signup",), date(2023, 12, 31)),
]
GROUPS = [("Clicks", ["q-click", "Q click"], []), ("Buys", [], ["purchase"])]


# Rows of a driver table in one task. A row of it becomes up to sixty rows of text.
TASK_ROWS = 50_000


def tasks(spark: SparkSession, df: DataFrame) -> int:
    """How many tasks share the work on a table: every core has one, and none has more than `TASK_ROWS` rows."""
    return max(spark.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; one that fills fewer input splits than its rows ask for is spread over more.

    Parsing is CPU work and a row of a few compressed bytes becomes kilobytes of
    text, so the bytes of a split say little about the time and memory of its task.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    wanted = tasks(spark, df)
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def mapping(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        MAPPING_ROWS,
        "mapping_type string, source_system string, source_value string, service_scope string, designation string",
    )


def _clock(seconds: str) -> str:
    """H:MM:SS text of whole seconds."""
    return (
        f"concat(cast(({seconds}) div 3600 AS string), ':', lpad(cast((({seconds}) div 60) % 60 AS string), 2, '0'), "
        f"':', lpad(cast(({seconds}) % 60 AS string), 2, '0'))"
    )


def _stamp(ts: str) -> str:
    return f"date_format({ts}, 'MM/dd/yyyy hh:mm:ss a')"


_NAME = "concat('Customer#', lpad(cast(user_id AS string), 9, '0'))"


def calls_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is a call leg that two overlapping exports carry: its day and its week."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    e = e.withColumn("kind", F.explode(F.array(F.lit("day"), F.lit("week")))).selectExpr(
        "*",
        "day(ts) AS d",
        "cast((day(ts) - 1) div 7 AS int) AS week",
        "cast(date_trunc('second', ts) AS timestamp_ntz) AS start",
        "event_id % 4 = 0 AS agentless",
    )
    return e.selectExpr(
        f"CASE WHEN event_id % 71 = 0 THEN 'n/a' ELSE {_stamp('start')} END AS `Call Date/Time`",
        f"CASE WHEN event_id % 47 = 0 THEN {_stamp('start - INTERVAL 1 HOUR')} "
        f"ELSE {_stamp('start + make_dt_interval(0, 0, 0, cast(floor(value) AS decimal(18,6)))')} END "
        "AS `Call End Date/Time`",
        "CASE WHEN event_id % 42 = 0 THEN '' ELSE concat(' C', event_id) END AS `Call ID`",
        "CASE WHEN event_id % 21 = 0 THEN '' ELSE cast(event_id AS string) END AS `Call Reference Number`",
        "CASE WHEN agentless THEN '' WHEN event_id % 31 = 0 THEN concat('X', user_id) "
        "WHEN event_id % 13 = 0 THEN concat(user_id, '.0') ELSE cast(user_id AS string) END AS `Agent ID`",
        f"CASE WHEN agentless THEN '' WHEN event_id % 31 = 0 THEN 'Ghost' ELSE {_NAME} END AS `Agent`",
        f"CASE WHEN agentless THEN '' ELSE {_clock('cast(floor(value) AS bigint)')} END AS `Talk Time`",
        "CASE WHEN agentless THEN '' ELSE cast(event_id % 7 AS string) END AS `Hold Time`",
        "CASE WHEN agentless THEN '' ELSE concat('0:00:', event_id % 11) END AS `Total Wrap Time`",
        "CASE WHEN event_id % 43 = 0 THEN '' WHEN event_id % 5 = 0 THEN 'O' WHEN event_id % 4 = 1 THEN 'i' "
        "ELSE 'I' END AS `Call Direction`",
        "CASE WHEN event_id % 17 = 0 THEN '' WHEN event_id % 59 = 0 THEN 'abc' "
        "ELSE concat('0:00:', event_id % 60) END AS `Total Queue Wait Time`",
        "cast(event_id % 3 AS string) AS `Ringing Duration`",
        "CASE WHEN event_id % 61 = 0 THEN '' WHEN event_id % 2 = 0 THEN concat('Q ', upper(event_type)) "
        "ELSE concat('q-', event_type) END AS `Queue`",
        "CASE WHEN kind = 'week' THEN '' WHEN event_id % 6 = 0 THEN 'Yes' ELSE 'no' END AS `Transferred?`",
        "element_at(array('fr', 'nl', ''), cast(event_id % 3 AS int) + 1) AS `Language`",
        "kind AS `PCSStatus`",
        "CASE WHEN kind = 'day' THEN concat('calls/day-', date_format(ts, 'yyyyMMdd'), '.csv') "
        "ELSE concat('calls/week-', week, '.csv') END AS source_key",
        "CASE WHEN kind = 'day' THEN cast(date_add(cast(ts AS date), 1 + CASE WHEN d % 3 = 0 THEN 9 ELSE 0 END) AS timestamp) "
        "ELSE cast(date_add(DATE'2024-01-01', (week + 1) * 7) AS timestamp) END AS source_mtime",
        "event_id + 2 AS source_row",
    )


def bulk_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as admitted call legs, for volume."""
    l = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate"
    )
    return l.selectExpr(
        "cast(l_shipdate AS timestamp_ntz) + make_dt_interval(0, 0, 0, "
        "cast((l_orderkey * 37 + l_linenumber * 911) % 86400 AS decimal(18,6))) AS call_start",
        "cast(l_shipdate AS date) AS business_date",
        "l_returnflag AS service_scope",
        "l_returnflag AS comparison_scope",
        "concat(l_returnflag, l_linestatus) AS queue",
        "cast(NULL AS string) AS designation",
        "CASE WHEN l_linenumber % 2 = 0 THEN 'nl' END AS language",
        "CASE WHEN l_orderkey % 4 <> 0 THEN cast(l_suppkey AS string) END AS source_agent_id",
        "CASE WHEN l_orderkey % 4 <> 0 THEN cast(l_quantity AS bigint) END AS talk_seconds",
        "cast(NULL AS bigint) AS hold_seconds",
        "cast(NULL AS bigint) AS wrap_seconds",
        "CASE WHEN l_orderkey % 17 <> 0 THEN cast(l_quantity AS bigint) END AS queue_wait_seconds",
        "cast(l_linenumber % 3 AS bigint) AS ringing_seconds",
        "l_orderkey % 6 = 0 AS transferred",
        "concat('bulk/', l_linenumber, '.csv') AS source_key",
        "true AS service_eligible",
    )


def roster_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer is a roster row, with blank, doubled and invalid cells among them."""
    c = table(spark, sf_dir, "customer")
    return c.selectExpr(
        "'fte/roster.xlsx' AS source_key",
        "c_custkey + 2 AS source_row",
        "CASE WHEN c_custkey % 40 = 13 THEN 'N/A' ELSE concat(' ', c_custkey - CASE WHEN c_custkey % 50 = 49 THEN 1 ELSE 0 END, "
        "CASE WHEN c_custkey % 10 = 3 THEN '.0' ELSE '' END) END AS client_id",
        "CASE WHEN c_custkey % 12 = 11 THEN 'Suspended' WHEN c_acctbal < 0 THEN ' leaver ' ELSE 'ACTIVE' END AS employment_status",
        "CASE WHEN c_custkey % 97 = 5 THEN ' ' ELSE concat('Customer#', lpad(cast(c_custkey - "
        "CASE WHEN c_custkey % 30 = 17 THEN 1 ELSE 0 END AS string), 9, '0')) END AS agent_name",
        "concat('TL ', c_nationkey) AS team_leader",
        "c_mktsegment AS lob",
        "CASE WHEN c_custkey % 83 = 9 THEN 'soon' WHEN c_acctbal < 0 AND c_custkey % 25 <> 7 THEN '1/15/2024' "
        "WHEN c_acctbal >= 0 AND c_custkey % 60 = 5 THEN '2024-02-01' ELSE '' END AS end_date",
        "CASE WHEN c_custkey % 33 = 2 THEN '' WHEN c_custkey % 77 = 3 THEN 'abc' WHEN c_custkey % 91 = 4 THEN '-1' "
        "ELSE cast(cast((c_custkey % 5) / 4.0 AS double) AS string) END AS fte",
    )


def registers_raw(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each order is a register row: urgent and high priorities are PTO, the rest AWAY."""
    o = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS o", "o_custkey", "o_orderstatus", "o_orderpriority IN ('1-URGENT', '2-HIGH') AS pto",
        "date_add(DATE'2024-01-01', cast(o_orderkey % 365 AS int)) AS d0",
        "CASE WHEN o_orderkey % 53 = 0 THEN 'soon' ELSE "
        "date_format(date_add(DATE'2024-01-01', cast(o_orderkey % 365 AS int)), 'yyyy-MM-dd') END AS start_date",
        "concat(' ', o_custkey) AS client_id", "'fte/roster.xlsx' AS source_key", "o_orderkey + 2 AS source_row",
        "CASE WHEN o_orderkey % 41 = 0 THEN '' ELSE 'Rest' END AS absence_type",
    )
    pto = o.filter("pto").selectExpr(
        "source_key", "source_row", "client_id", "start_date", "absence_type",
        "date_format(date_add(d0, CASE WHEN o % 2 = 0 THEN cast(o % 3 AS int) WHEN o % 50 = 1 THEN 1 ELSE 0 END), 'M/d/yyyy') AS end_date",
        "CASE WHEN o % 2 = 0 THEN 'Full day' WHEN o % 67 = 5 THEN 'half' ELSE 'partial_day' END AS day_coverage",
        "CASE WHEN o % 2 = 0 THEN '' WHEN o % 3 = 0 THEN '08:30' ELSE '2:00 PM' END AS start_time",
        "CASE WHEN o % 2 = 0 THEN '' WHEN o % 3 = 0 THEN '10:45:00' WHEN o % 19 = 1 THEN '1:00 PM' ELSE '5:15 pm' END AS end_time",
        "element_at(map('F', 'Approved', 'O', 'pending', 'P', 'Cancelled'), o_orderstatus) AS record_status",
    )
    away = o.filter("NOT pto").selectExpr(
        "source_key", "source_row", "client_id", "start_date", "absence_type",
        "CASE WHEN o % 6 = 0 THEN '' WHEN o % 61 = 4 THEN '01/01/2023' ELSE date_format(date_add(d0, cast(o % 5 AS int)), 'yyyy/MM/dd') END AS end_date",
        "element_at(map('F', 'closed', 'O', 'ACTIVE', 'P', 'Planned'), o_orderstatus) AS record_status",
    )
    return pto, away


def schedule_days() -> list[date]:
    return [FIRST_DAY + timedelta(days=i) for i in range(DAYS)]


def schedule_raw(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Each user has a row in the published schedule and one in its revision."""
    events = table(spark, sf_dir, "events")
    # The ids alone are so small that AQE would leave them, and all their cells, to one task.
    users = events.select("user_id").distinct().repartition(tasks(spark, events))
    names = [d.strftime("%m/%d/%Y") for d in schedule_days()]

    def bounds(d: int, shift_hours: int, invert: bool = False) -> str:
        # A day has three shifts: their texts are written here, not formatted for every cell.
        texts = []
        for hour in (8, 14, 22):
            begin = datetime.combine(FIRST_DAY + timedelta(days=d - 1), datetime.min.time()) + timedelta(hours=hour + shift_hours)
            later = begin - timedelta(hours=1) if invert else begin + timedelta(hours=8)
            texts.append(" - ".join(f"{t:%m/%d/%Y} {t.hour % 12 or 12}:{t:%M %p}" for t in (begin, later)))
        return f"element_at(array({', '.join(repr(t) for t in texts)}), cast(user_id % 3 AS int) + 1)"

    def base(d: int) -> str:
        kind = f"CASE (user_id + {d}) % 10 WHEN 0 THEN 'Training ' WHEN 1 THEN 'Annual Leave ' ELSE '.ORG | Work ' END"
        return (
            f"CASE WHEN (user_id + {d}) % 7 = 0 THEN ' off ' WHEN (user_id * 3 + {d}) % 11 = 0 THEN '' "
            f"WHEN (user_id + {2 * d}) % 97 = 5 THEN 'Work tbc' "
            f"WHEN (user_id * 7 + {d}) % 89 = 3 THEN concat('Work ', {bounds(d, 0, True)}) "
            f"ELSE concat({kind}, {bounds(d, 0)}) END AS `{names[d - 1]}`"
        )

    def revised(d: int) -> str:
        return f"CASE WHEN (user_id + {d}) % 4 = 0 THEN concat('.ORG | Revised ', {bounds(d, 1)}) ELSE '' END AS `{names[d - 1]}`"

    identity = [f"{_NAME} AS Name", "concat(user_id, '') AS `Data Source IDs`", "user_id + 2 AS source_row"]
    parts = [
        users.selectExpr(*identity, f"'schedule/{key}.txt' AS source_key", f"TIMESTAMP'{when}' AS source_mtime",
                         *[cell(d) for d in range(1, DAYS + 1)])
        for key, when, cell in (("base", "2023-12-20 00:00:00", base), ("rev", "2023-12-28 00:00:00", revised))
    ]
    return reduce(DataFrame.unionByName, parts), names


def status_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event opens a status segment of one to twelve hours."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return e.selectExpr(
        "CASE WHEN event_id % 19 = 0 THEN '' ELSE cast(event_id AS string) END AS `[Serial Number]`",
        "element_at(map('click', 'Available', 'view', '  Inbound   call', 'purchase', 'LUNCH', 'error', 'Logged Off', "
        "'signup', 'unavailable'), event_type) AS `[Status]`",
        f"CASE WHEN event_id % 29 = 0 THEN 'not a date' ELSE {_stamp('ts')} END AS `[Status Start Date and Time]`",
        f"CASE WHEN event_id % 31 = 0 THEN 'Ghost' ELSE {_NAME} END AS `[Agent]`",
        "CASE WHEN event_id % 31 = 0 THEN concat('X', user_id) WHEN event_id % 37 = 0 THEN concat('Y', user_id) "
        "ELSE cast(user_id AS string) END AS `[Agent ID]`",
        f"CASE WHEN event_id % 23 = 0 THEN '0:00:00' ELSE {_clock('3600 + (event_id * 7919) % 39600')} END AS `[Status Duration]`",
        "event_type AS `[Queue]`",
        "element_at(array('status/a.csv', 'status/b.csv', 'status/c.csv'), cast(event_id % 3 AS int) + 1) AS source_key",
        "event_id + 2 AS source_row",
    )


def lilo_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user and date has one log-in / log-out row, some blank, some overnight."""
    e = table(spark, sf_dir, "events").selectExpr("user_id", "cast(ts AS date) AS d", "ts")
    days = e.groupBy("user_id", "d").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    days = days.selectExpr("*", "user_id + day(d) AS n")
    return days.selectExpr(
        f"{_NAME} AS `[Agent]`",
        "cast(user_id AS string) AS `[Agent ID]`",
        f"CASE WHEN n % 9 = 0 THEN '' WHEN n % 5 = 0 THEN {_stamp('b')} ELSE {_stamp('a')} END AS `[First Log-on Time]`",
        f"CASE WHEN n % 9 = 0 OR n % 13 = 0 THEN '' WHEN n % 5 = 0 THEN {_stamp('a')} ELSE {_stamp('b')} END AS `[Last Log-off Time]`",
        "CASE WHEN n % 3 = 1 THEN '' ELSE date_format(d, 'yyyy-MM-dd') END AS `Report Date`",
        "concat('lilo/', date_format(d, 'yyyy-MM-dd'), '.csv') AS source_key",
        "user_id + 2 AS source_row",
    )
