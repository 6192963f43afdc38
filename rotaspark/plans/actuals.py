"""Agent status segments and log-in / log-out rows (PR-02)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotaspark.functions.keys import serial_or_hash
from rotaspark.functions.rules import fallback_category, label_text
from rotaspark.functions.temporal import (
    add_seconds,
    duration_seconds,
    filename_date,
    overnight_end,
    parse_date,
    parse_datetime,
)
from rotaspark.functions.text import normalize_header, normalize_id, status_label, with_clean
from rotaspark.operators.identity import resolve_agents
from rotaspark.operators.quality import (
    LILO_COUNTERS,
    STATUS_COUNTERS,
    counted_findings,
    source_counters,
)
from rotaspark.policy import StatusPolicy

# Source headers.
STATUS_HEADERS = (
    "[Serial Number]", "[Status]", "[Status Start Date and Time]", "[Agent]", "[Agent ID]",
    "[Status Duration]", "[Queue]",
)
LILO_HEADERS = ("[Agent]", "[Agent ID]", "[First Log-on Time]", "[Last Log-off Time]")
LILO_DATE_HEADERS = ("BUSINESSDATE", "EXTRACTDATE", "REPORTDATE", "DATE")
_ADDED = ("source_key", "source_row", "source_mtime")


def classify_status(df: DataFrame, policy: StatusPolicy, status: str = "status") -> DataFrame:
    """FN-13: exact label rule first, else the fallback classifier; adds label_mapped."""
    table = policy.table(df.sparkSession)
    joined = (
        df.withColumn("_label", status_label(F.col(status)))
        .withColumn("_text", label_text(F.col(status)))
        .join(table, F.col("_label") == F.col("label_key"), "left")
    )
    return (
        joined.withColumn("label_mapped", F.col("label_key").isNotNull())
        .withColumn("actual_category", F.coalesce("rule_category", fallback_category(F.col(status), F.col("_text"))))
        .drop("_label", "_text", "label_key", "rule_category")
    )


def parse_status(raw: DataFrame, roster: DataFrame, policy: StatusPolicy) -> DataFrame:
    """Status rows with a `lane`: accepted, outside the roster, or invalid (FL-05)."""
    cells = [c for c in raw.columns if c not in _ADDED]
    texts = {
        "_start": "[Status Start Date and Time]", "_duration": "[Status Duration]", "_id": "[Agent ID]", "agent_name": "[Agent]",
        "status": "[Status]", "queue": "[Queue]", "_serial": "[Serial Number]",
    }
    rows = (
        with_clean(raw, texts)
        .withColumn("status_start", parse_datetime(F.col("_start"), is_clean=True))
        .withColumn("duration_seconds", duration_seconds(F.col("_duration"), is_clean=True))
        .withColumn("status_end", add_seconds(F.col("status_start"), F.col("duration_seconds")))
        .withColumn("extract_date", F.to_date("status_start"))
        .withColumn("source_agent_id", normalize_id(F.col("_id"), is_clean=True))
        .withColumn("serial_number", serial_or_hash(F.col("_serial"), cells))
        .select(
            "source_key", "source_row", "serial_number", "extract_date", "source_agent_id", "agent_name",
            "status", "status_start", "status_end", "duration_seconds", "queue",
        )
    )
    resolved = resolve_agents(rows, roster, day="extract_date")
    whole = F.coalesce(F.col("status_end") > F.col("status_start"), F.lit(False))
    lanes = resolved.withColumn(
        "lane",
        F.when(~whole, "invalid").when(F.col("scope_match") == "none", "outside").otherwise("accepted"),
    )
    return classify_status(lanes, policy).drop("roster_row", "roster_key")


def lilo_date_header(columns: list[str]) -> str | None:
    """SRC-05: the optional date column, found by normalised name."""
    by_name = {normalize_header(c): c for c in columns if c not in _ADDED}
    return next((by_name[key] for key in LILO_DATE_HEADERS if key in by_name), None)


def _own_date(raw: DataFrame) -> Column:
    """The date column of a row's own file: where files of several headers are united, `header_cells` tells it."""
    none = F.lit(None).cast("date")
    if "header_cells" not in raw.columns:
        header = lilo_date_header(raw.columns)
        return parse_date(F.col(f"`{header}`")) if header else none
    by_name: dict[str, list[str]] = {}
    for c in raw.columns:
        by_name.setdefault(normalize_header(c), []).append(c)
    found = none
    for c in reversed([c for key in LILO_DATE_HEADERS for c in by_name.get(key, [])]):
        found = F.when(F.array_contains("header_cells", c), parse_date(F.col(f"`{c}`"))).otherwise(found)
    return found


def lilo_date(raw: DataFrame, own: Column | None = None, first: Column | None = None, last: Column | None = None) -> Column:
    """FL-06: the date of a LILO row: its date column, first or last date, or the one date in the file's name.

    What is parsed already may be handed in.
    """
    name = F.element_at(F.split(F.col("source_key"), "/"), -1)
    return F.coalesce(
        _own_date(raw) if own is None else own,
        F.to_date(parse_datetime(F.col("[First Log-on Time]")) if first is None else first),
        F.to_date(parse_datetime(F.col("[Last Log-off Time]")) if last is None else last),
        filename_date(name),
    )


def parse_lilo(raw: DataFrame, roster: DataFrame) -> DataFrame:
    """LILO rows with a `lane`; FL-06 date fallback, FN-28 overnight correction."""
    texts = {"_first": "[First Log-on Time]", "_last": "[Last Log-off Time]", "_id": "[Agent ID]", "agent_name": "[Agent]"}
    header = None if "header_cells" in raw.columns else lilo_date_header(raw.columns)
    if header:
        texts["_day"] = header
    own = parse_date(F.col("_day"), is_clean=True) if header else None
    rows = (
        with_clean(raw, texts)
        .withColumn("first_login", parse_datetime(F.col("_first"), is_clean=True))
        .withColumn("raw_last_logout", parse_datetime(F.col("_last"), is_clean=True))
        .withColumn("extract_date", lilo_date(raw, own, F.col("first_login"), F.col("raw_last_logout")))
        .withColumn("last_logout", overnight_end(F.col("first_login"), F.col("raw_last_logout")))
        .withColumn(
            "overnight_adjusted",
            F.coalesce(F.col("raw_last_logout") < F.col("first_login"), F.lit(False)),
        )
        .withColumn("source_agent_id", normalize_id(F.col("_id"), is_clean=True))
        .select(
            "source_key", "source_row", "extract_date", "source_agent_id", "agent_name", "first_login",
            "raw_last_logout", "last_logout", "overnight_adjusted",
        )
    )
    resolved = resolve_agents(rows, roster, day="extract_date")
    return resolved.withColumn(
        "lane",
        F.when(F.col("extract_date").isNull(), "invalid")
        .when(F.col("scope_match") == "none", "outside")
        .otherwise("accepted"),
    ).drop("roster_row", "roster_key")


def accepted(lanes: DataFrame) -> DataFrame:
    return lanes.filter("lane = 'accepted'").drop("lane")


def status_counters(lanes: DataFrame) -> DataFrame:
    return source_counters(lanes, "extract_date", unmapped_rows=~F.col("label_mapped"))


def lilo_counters(lanes: DataFrame) -> DataFrame:
    return source_counters(lanes, "extract_date")


def status_findings(lanes: DataFrame) -> DataFrame:
    """DQ-07."""
    return counted_findings(status_counters(lanes), STATUS_COUNTERS)


def lilo_findings(lanes: DataFrame) -> DataFrame:
    """DQ-07."""
    return counted_findings(lilo_counters(lanes), LILO_COUNTERS)
