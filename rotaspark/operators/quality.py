"""Data-quality operators: findings are rows, evidence is never dropped."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("info", "warning", "error")
FINDING_COLUMNS = ("issue_code", "severity", "source_key", "source_row", "source_column", "details")


class QualityGateError(ValueError):
    """A cut holds findings that block its activation."""


def _position(df: DataFrame, name: str) -> Column:
    return (F.col(name) if name in df.columns else F.lit(None)).cast("bigint").alias(name)


def row_findings(df: DataFrame, severity: Mapping[str, str] | str, codes: str = "validation_codes") -> DataFrame:
    """DQ-01..06, DQ-09: one finding per code held by a row."""
    base = df.select(
        F.explode(codes).alias("issue_code"), "source_key", _position(df, "source_row"),
        _position(df, "source_column"),
    )
    if isinstance(severity, str):
        level: Column = F.lit(severity)
    else:
        table = F.create_map(*[F.lit(x) for pair in severity.items() for x in pair])
        level = F.coalesce(F.try_element_at(table, F.col("issue_code")), F.lit("warning"))
    where = F.concat(F.lit("source row "), F.coalesce(F.col("source_row").cast("string"), F.lit("unknown")))
    return base.select(
        "issue_code", level.alias("severity"), "source_key", "source_row", "source_column",
        F.concat_ws(": ", where, F.lower(F.replace(F.col("issue_code"), F.lit("_"), F.lit(" ")))).alias("details"),
    )


def counted_findings(counters: DataFrame, rules: Mapping[str, tuple[str, str, str]]) -> DataFrame:
    """DQ-07 / DQ-08: one finding per source and counter above zero.

    `rules` maps a counter column to (code, severity, text after the count).
    """
    entries = [
        F.struct(
            F.lit(code).alias("issue_code"),
            F.lit(severity).alias("severity"),
            F.col(column).cast("bigint").alias("row_count"),
            F.lit(text).alias("text"),
        )
        for column, (code, severity, text) in rules.items()
    ]
    return (
        counters.select("source_key", F.explode(F.array(*entries)).alias("x"))
        .filter("x.row_count > 0")
        .select(
            "x.issue_code", "x.severity", "source_key",
            F.lit(None).cast("bigint").alias("source_row"),
            F.lit(None).cast("bigint").alias("source_column"),
            F.concat_ws(" ", F.col("x.row_count").cast("string"), F.col("x.text")).alias("details"),
            "x.row_count",
        )
    )


# Finding codes of the counted checks.
STATUS_COUNTERS = {
    "rejected_rows": ("AGENT_STATUS_REJECTED_ROWS", "warning", "status rows could not be read"),
    "outside_rows": ("AGENT_STATUS_OUTSIDE_ROSTER_ROWS", "info", "status rows belong to nobody on the roster that day"),
    "unmapped_rows": ("AGENT_STATUS_UNMAPPED_LABELS", "warning", "status rows have a label without a rule"),
}
LILO_COUNTERS = {
    "rejected_rows": ("LILO_REJECTED_ROWS", "warning", "log-in rows could not be read"),
    "outside_rows": ("LILO_OUTSIDE_ROSTER_ROWS", "info", "log-in rows belong to nobody on the roster that day"),
}
CALL_COUNTERS = {
    "rejected_rows": ("CALL_REJECTED_ROWS", "warning", "calls start at no readable time"),
    "outside_rows": ("CALL_OUTSIDE_SCOPE_ROWS", "info", "calls belong to no roster agent and no known queue"),
    "unmapped_rows": ("CALL_UNMAPPED_AGENT_ROWS", "info", "calls of roster agents came through an unknown queue"),
    "degraded_rows": ("CALL_DEGRADED_ROWS", "warning", "calls miss a service field or a usable duration"),
}


def source_counters(lanes: DataFrame, day: str, **flags: Column) -> DataFrame:
    """AG-08: per source the accepted / outside / rejected rows, flags and date range.

    `lanes` has a `lane` column; `flags` are conditions counted over accepted rows.
    """
    accepted = F.col("lane") == "accepted"
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")
    return lanes.groupBy("source_key").agg(
        count(accepted).alias("accepted_rows"),
        count(F.col("lane") == "outside").alias("outside_rows"),
        count(F.col("lane") == "invalid").alias("rejected_rows"),
        *[count(accepted & cond).alias(name) for name, cond in flags.items()],
        F.min(F.when(accepted, F.col(day))).alias("date_from"),
        F.max(F.when(accepted, F.col(day))).alias("date_to"),
    )


def by_severity(findings: DataFrame) -> DataFrame:
    """AG-11: counts with all three severities always present."""
    spark = findings.sparkSession
    levels = spark.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    counted = findings.groupBy("severity").agg(F.count("*").alias("n"))
    return levels.join(counted, "severity", "left").select(
        "severity", F.coalesce("n", F.lit(0)).cast("bigint").alias("finding_count")
    )


def gate(findings: DataFrame) -> DataFrame:
    """DQ-10: raise when any finding is an error."""
    first = findings.filter("severity = 'error'").limit(1).collect()
    if first:
        raise QualityGateError(f"blocking finding: {first[0]['issue_code']} in {first[0]['source_key']}")
    return findings


def violations(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """DQ-11 / DQ-12: how many rows break each check (unknown counts as broken)."""
    counts = df.agg(
        *[F.sum(F.when(F.coalesce(ok, F.lit(False)), 0).otherwise(1)).alias(name) for name, ok in checks.items()]
    )
    pairs = [
        F.struct(F.lit(name).alias("check_name"), F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias("broken_rows"))
        for name in checks
    ]
    return counts.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")


def require(df: DataFrame, checks: Mapping[str, Column], label: str) -> DataFrame:
    """DQ-11 as a post-write assertion."""
    broken = violations(df, checks).filter("broken_rows > 0").collect()
    if broken:
        raise QualityGateError(f"{label}: " + ", ".join(f"{r.check_name} x{r.broken_rows}" for r in broken))
    return df
