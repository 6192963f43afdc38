"""Text extracts as DataFrames of text columns plus their source position.

Every reader returns the file's own columns and `source_key`, `source_mtime`
and `source_row`. Types are never inferred: ids would lose their zeros.
"""

from __future__ import annotations

import csv
import io
from collections import defaultdict
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rotaspark.functions.text import catalog_key, normalize_header, strip
from rotaspark.operators.latest import require_unique
from rotaspark.plans.actuals import LILO_HEADERS, STATUS_HEADERS
from rotaspark.plans.calls import REQUIRED_HEADERS
from rotaspark.sources import records
from rotaspark.sources.inventory import source_key


class SourceError(ValueError):
    """A source does not meet its file-level contract."""


def headers_of(spark: SparkSession, paths: Sequence[str], sep: str = ",") -> dict[str, tuple[list[str], bool]]:
    """Header cells of every file, and whether each record sits on one line; one pass over all files.

    A record may span lines only where a line holds an odd number of quotes.
    """
    odd = (F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))) % 2 == 1
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("uri"), at.alias("at"), "value", odd.alias("odd"))
    found = lines.groupBy("uri").agg(F.min_by("value", "at").alias("header"), F.max("odd").alias("odd"))
    rows = {r["path"]: r for r in found.select(decoded_path(F.col("uri")).alias("path"), "header", "odd").collect()}
    out = {}
    for path in paths:
        row = rows.get(path) or next((r for p, r in rows.items() if p.split(":", 1)[-1].lstrip("/") == path.split(":", 1)[-1].lstrip("/")), None)
        if row is None:
            raise SourceError(f"empty extract: {path}")
        cells = next(csv.reader(io.StringIO(row["header"].lstrip("\ufeff")), delimiter=sep))
        out[path] = cells, not row["odd"]
    return out


def header_of(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """The first line of one file, as header cells."""
    return headers_of(spark, [path], sep)[path][0]


def decoded_path(uri: Column) -> Column:
    """`_metadata.file_path` is percent-encoded; a literal plus sign must survive the decoding."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


#: A task of a scan reads so many splits at most, with Spark's sizes for splits and for opening a file.
_SPLITS_A_TASK = 33


def with_source_rows(df: DataFrame, first_row: int = 2) -> DataFrame:
    """SRC-16: row number inside each file, without sorting or gathering a file.

    Every input split counts its rows; the small table of split offsets is
    joined back, and the row's place in its split is added. Up to MAX_SPLITS
    splits, some 128 TB, it is broadcast, so no raw row is shuffled; beyond, it
    is an ordinary join. `df` must come straight from a file scan, with
    `_split` holding its start offset.
    """
    numbered = df.withColumn("_at", F.monotonically_increasing_id())
    splits = numbered.groupBy("source_key", "_split").agg(
        F.count("*").alias("_n"), F.min("_at").alias("_first")
    )
    before = Window.partitionBy("source_key").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        "source_key", "_split", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    if df.rdd.getNumPartitions() * _SPLITS_A_TASK <= records.MAX_SPLITS:
        offsets = F.broadcast(offsets)
    return (
        numbered.join(offsets, ["source_key", "_split"])
        .withColumn("source_row", F.col("_at") - F.col("_first") + F.col("_offset") + F.lit(first_row))
        .drop("_at", "_split", "_first", "_offset")
    )


def _spanning(spark: SparkSession, root: str, paths: Sequence[str], names: Sequence[str], sep: str, encoding: str) -> DataFrame:
    """Rows of files whose records span lines, read in splits."""
    charset = "cp1252" if encoding.lower() == "windows-1252" else encoding
    rows = records.read_records(spark, paths, sep, charset).where("row > 0")
    rows = rows.withColumn("cells", records.cells_of(F.col("record"), names, sep))
    return rows.select(
        "cells.*", source_key(decoded_path(F.col("uri")), root).alias("source_key"),
        F.timestamp_micros("mtime").alias("source_mtime"), (F.col("row") + 1).alias("source_row"),
    )


def read_delimited(
    spark: SparkSession,
    root: str,
    paths: Sequence[str],
    *,
    sep: str = ",",
    encoding: str = "UTF-8",
    rename: Callable[[list[str]], list[str]] = list,
    check: Callable[[list[str]], None] = lambda header: None,
    keep_header: bool = False,
) -> DataFrame:
    """SRC-03..06: files with the same header are scanned together and united by name (SET-01).

    Files of any size are read in splits, also those whose records span lines.

    keep_header adds `header_cells`, the file's own column names in order.
    """
    if encoding.upper() not in ("UTF-8", "UTF8"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    groups: dict[tuple[tuple[str, ...], bool], list[str]] = defaultdict(list)
    for path, (cells, lines) in headers_of(spark, paths, sep).items() if paths else ():
        header = rename(cells)
        check(header)
        groups[(tuple(header), lines)].append(path)
    frames = []
    for (header, lines), members in groups.items():
        names = [name if name else f"_blank_{i}" for i, name in enumerate(header)]
        if lines:
            ddl = ", ".join(f"`{name.replace('`', '``')}` string" for name in names)
            raw = (
                spark.read.schema(ddl)
                .option("header", True)
                .option("sep", sep)
                .option("encoding", encoding)
                .option("escape", '"')
                .csv(members)
            )
            placed = raw.select(
                "*",
                source_key(decoded_path(F.col("_metadata.file_path")), root).alias("source_key"),
                F.col("_metadata.file_modification_time").alias("source_mtime"),
                F.col("_metadata.file_block_start").alias("_split"),
            )
            rows = with_source_rows(placed)
        else:
            rows = _spanning(spark, root, members, names, sep, encoding)
        frames.append(rows.withColumn("header_cells", F.array(*map(F.lit, names))) if keep_header else rows)
    if not frames:
        raise SourceError("no files were given")
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def _require(header: list[str], required: Sequence[str], label: str) -> None:
    missing = sorted(set(required) - set(header))
    if missing:
        raise SourceError(f"{label} misses columns: {', '.join(missing)}")


def _no_repeats(header: list[str], label: str) -> None:
    seen: set[str] = set()
    for name in header:
        if name in seen:
            raise SourceError(f"{label} repeats column: {name}")
        seen.add(name)


def read_calls(spark: SparkSession, root: str, paths: Sequence[str]) -> DataFrame:
    """SRC-03: call-by-call CSV; headers lose blanks and square brackets."""

    def check(header: list[str]) -> None:
        _no_repeats(header, "call extract")
        _require(header, REQUIRED_HEADERS, "call extract")

    return read_delimited(
        spark, root, paths, rename=lambda h: [c.strip().strip("[]") for c in h], check=check
    )


def read_status(spark: SparkSession, root: str, paths: Sequence[str]) -> DataFrame:
    """SRC-04: agent-status CSV with its exact bracketed headers."""
    return read_delimited(
        spark, root, paths, check=lambda h: _require(h, STATUS_HEADERS, "status extract")
    )


def read_lilo(spark: SparkSession, root: str, paths: Sequence[str], keep_header: bool = False) -> DataFrame:
    """SRC-05: LILO CSV with an optional date column."""
    check = lambda h: _require(h, LILO_HEADERS, "LILO extract")
    return read_delimited(spark, root, paths, check=check, keep_header=keep_header)


def read_schedule(spark: SparkSession, root: str, paths: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """SRC-06: wide Windows-1252 TSV; returns the frame and its date columns."""
    dates: dict[str, None] = {}

    def tidy(header: list[str]) -> list[str]:
        return [c.strip() for c in header]

    def check(header: list[str]) -> None:
        if len(header) < 3 or header[:2] != ["Name", "Data Source IDs"]:
            raise SourceError("a schedule begins with Name and Data Source IDs")
        named = [c for c in header[2:] if c]
        values = [is_header_date(c) for c in named]
        if None in values:
            raise SourceError(f"not a business date: {named[values.index(None)]}")
        if not named:
            raise SourceError("a schedule needs business-date columns")
        if len(set(values)) != len(values):
            raise SourceError("a schedule repeats a business date")
        dates.update(dict.fromkeys(named))

    wide = read_delimited(
        spark, root, paths, sep="\t", encoding="windows-1252", rename=tidy, check=check, keep_header=True
    )
    blank = [c for c in wide.columns if c.startswith("_blank_")]
    if blank:
        filled = F.coalesce(*[F.nullif(strip(F.col(c)), F.lit("")) for c in blank])
        if wide.filter(filled.isNotNull()).limit(1).count():
            raise SourceError("a schedule cell has data without a header")
        wide = wide.drop(*blank)
    return wide, list(dates)


def is_header_date(text: str):
    """Business date of a schedule header, or None (driver side)."""
    from datetime import datetime

    for pattern in ("%m/%d/%Y", "%Y-%m-%d", "%d/%m/%Y"):
        try:
            return datetime.strptime(text.strip(), pattern).date()
        except ValueError:
            continue
    return None


# The headers that tell an activities file from a schedule.
ACTIVITY_HEADERS = {"Scheduling Period", "Shift Assignment", "Shift Events"}


def sniff_schedule(header: Sequence[str]) -> bool:
    """SRC-02: whether a header presents as a wide schedule; such a file must then validate."""
    cells = [c.strip() for c in header]
    if len(cells) < 3 or cells[:2] != ["Name", "Data Source IDs"]:
        return False
    if ACTIVITY_HEADERS <= set(cells):
        return False
    return any(is_header_date(c) is not None for c in cells[2:])


# Normalised headers accepted for each roster field.
ROSTER_ALIASES = {
    "client_id": ("CLIENTID", "AGENTID", "VERINTID", "DATASOURCEID", "DATASOURCEIDS"),
    "agent_name": ("NAME", "AGENTNAME", "AGENT", "EMPLOYEENAME", "FULLNAME"),
    "employment_status": ("STATUS", "EMPLOYMENTSTATUS", "AGENTSTATUS"),
    "team_leader": ("TEAMLEADER", "TEAMLEADERNAME", "TL"),
    "ops_manager": ("OPSMANAGER", "OPERATIONSMANAGER", "OPERATIONSMANAGERNAME"),
    "lob": ("LOB", "LINEOFBUSINESS"),
    "market": ("MARKET",),
    "language": ("LANGUAGE",),
    "location": ("LOCATION", "SITE"),
    "city": ("CITY",),
    "fte": ("FTE", "FTECOUNT"),
    "end_date": ("ENDDATEIFLEAVER", "ENDDATE", "LEAVERENDDATE"),
}
# Normalised titles of an authoritative roster table.
ROSTER_TITLES = (
    "AGENT", "AGENTS", "AGENTLIST", "AGENTROSTER", "FTE", "FTECOUNT", "FTEAGENT", "FTEAGENTS",
    "HEADCOUNT", "ROSTER",
)
# Register titles and required normalised headers.
REGISTER_TITLES = {
    "PTO": ("PTO", "PTOS"),
    "AWAY": ("AWAY", "AWAYPEOPLE", "LONGABSENCE", "LONGABSENCES"),
}
REGISTER_FIELDS = {
    "PTO": {
        "CLIENTID": "client_id", "STARTDATE": "start_date", "ENDDATE": "end_date",
        "DAYCOVERAGE": "day_coverage", "STARTTIME": "start_time", "ENDTIME": "end_time",
        "PTOTYPE": "absence_type", "APPROVALSTATUS": "record_status",
    },
    "AWAY": {
        "CLIENTID": "client_id", "STARTDATE": "start_date", "ENDDATE": "end_date",
        "AWAYTYPE": "absence_type", "CASESTATUS": "record_status",
    },
}
_POSITION = ("source_key", "source_mtime", "source_row")


def _alias_matches(columns: Sequence[str]) -> dict[str, list[str]]:
    by_name: dict[str, list[str]] = defaultdict(list)
    for column in columns:
        if column not in _POSITION:
            by_name[normalize_header(column)].append(column)
    return {
        field: [c for alias in aliases for c in by_name.get(alias, [])]
        for field, aliases in ROSTER_ALIASES.items()
    }


def roster_columns(df: DataFrame) -> DataFrame:
    """SRC-07: the logical roster columns; an ambiguous alias is an error."""
    matches = _alias_matches(df.columns)
    doubled = sorted(field for field, found in matches.items() if len(found) > 1)
    if doubled:
        raise SourceError(f"ambiguous roster columns: {', '.join(doubled)}")
    missing = [f for f in ("client_id", "agent_name", "employment_status") if not matches[f]]
    if missing:
        raise SourceError(f"roster misses: {', '.join(missing)}")
    pick = [
        (F.col(f"`{found[0]}`").cast("string") if found else F.lit(None).cast("string")).alias(field)
        for field, found in matches.items()
    ]
    return df.select(*[c for c in _POSITION if c in df.columns], *pick)


def roster_tier(title: str, columns: Sequence[str]) -> int:
    """SRC-08: 3 exact title, 2 title word, 1 by column evidence, 0 none."""
    if normalize_header(title) in ROSTER_TITLES:
        return 3
    words = set("".join(ch if ch.isalnum() else " " for ch in title.upper()).split())
    if words & {"ROSTER", "HEADCOUNT"}:
        return 2
    present = {field for field, found in _alias_matches(columns).items() if found}
    organisation = present & {"lob", "market", "language", "location", "city"}
    led = present & {"team_leader", "ops_manager"}
    return 1 if "employment_status" in present and led and len(organisation) >= 2 else 0


def choose_roster(tables: dict[str, DataFrame]) -> DataFrame:
    """SRC-08: the one best roster among named tables, with logical columns."""
    scored = []
    for title, df in tables.items():
        tier = roster_tier(title, df.columns)
        matches = _alias_matches(df.columns)
        if not tier or not (matches["client_id"] and matches["agent_name"]):
            continue
        if any(len(found) > 1 for found in matches.values()):
            raise SourceError(f"ambiguous roster columns in table {title!r}")
        if matches["employment_status"]:
            scored.append((tier, title))
    if not scored:
        raise SourceError(f"no roster among: {', '.join(tables) or '(none)'}")
    best = max(tier for tier, _ in scored)
    winners = [title for tier, title in scored if tier == best]
    if len(winners) != 1:
        raise SourceError(f"several authoritative rosters: {', '.join(winners)}")
    return roster_columns(tables[winners[0]])


def register_columns(df: DataFrame, kind: str) -> DataFrame:
    """SRC-09: a PTO or AWAY register with its required headers."""
    by_name = {normalize_header(c): c for c in df.columns if c not in _POSITION}
    missing = sorted(set(REGISTER_FIELDS[kind]) - set(by_name))
    if missing:
        raise SourceError(f"{kind} register misses: {', '.join(missing)}")
    pick = [F.col(f"`{by_name[h]}`").cast("string").alias(f) for h, f in REGISTER_FIELDS[kind].items()]
    for header, field in (("NAME", "agent_name"), ("COMMENT", "comment")):
        value = F.col(f"`{by_name[header]}`") if header in by_name else F.lit(None)
        pick.append(value.cast("string").alias(field))
    return df.select(*[c for c in _POSITION if c in df.columns], *pick)


def choose_register(tables: dict[str, DataFrame], kind: str) -> DataFrame | None:
    """SRC-09: none or one register of a kind."""
    found = [t for t in tables if normalize_header(t) in REGISTER_TITLES[kind]]
    if len(found) > 1:
        raise SourceError(f"several {kind} registers: {', '.join(found)}")
    return register_columns(tables[found[0]], kind) if found else None


# The queue-mapping catalog.
MAPPING_COLUMNS = ("mapping_type", "source_system", "source_value", "service_scope", "designation")
MAPPING_TYPES = ("queue", "forecast_file", "scope_rollup")
MAX_MAPPING_BYTES = 2 * 1024 * 1024


def validate_mapping(mapping: DataFrame) -> DataFrame:
    """SRC-10: trimmed rows; known types, required fields and unique normalised keys."""
    trimmed = mapping.select(
        F.lower(strip(F.coalesce("mapping_type", F.lit("")))).alias("mapping_type"),
        *[strip(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in MAPPING_COLUMNS[1:]],
    )
    blank = F.concat(*[F.col(c) for c in MAPPING_COLUMNS]) == ""
    rows = trimmed.filter(~blank)
    system, value = catalog_key(F.col("source_system")), catalog_key(F.col("source_value"))
    bad = ~F.col("mapping_type").isin(*MAPPING_TYPES) | (system == "") | (value == "") | (
        F.col("service_scope") == ""
    )
    first = rows.filter(bad).limit(1).collect()
    if first:
        raise SourceError(f"invalid mapping row: {first[0].asDict()}")
    keyed = rows.select(
        "mapping_type",
        F.when(F.col("mapping_type") == "queue", system).otherwise("").alias("system_key"),
        value.alias("value_key"),
    )
    require_unique(keyed, ["mapping_type", "system_key", "value_key"], "queue mapping")
    if not rows.limit(1).count():
        raise SourceError("the queue mapping has no rows")
    return rows


def read_queue_mapping(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """SRC-10: the catalog and the SHA-256 of its bytes; its size is limited before it is read.

    A row with missing or extra cells is an error, as it is in the header.
    """
    files = spark.read.format("binaryFile").load(path)
    size = files.select(F.max("length")).first()[0]
    if size is None or size > MAX_MAPPING_BYTES:
        raise SourceError("the queue mapping exceeds its size limit")
    digest = files.select(F.sha2("content", 256)).first()[0]
    header = header_of(spark, path)
    if tuple(header) != MAPPING_COLUMNS:
        raise SourceError("the queue mapping needs its five-column header")
    ddl = ", ".join(f"{c} string" for c in (*MAPPING_COLUMNS, "_whole"))
    options = {"header": True, "multiLine": True, "escape": '"', "columnNameOfCorruptRecord": "_whole"}
    rows = spark.read.schema(ddl).options(**options).csv(path)
    torn = [r["_whole"] for r in rows.collect() if r["_whole"] is not None]
    if torn:
        raise SourceError(f"a mapping row needs five cells: {torn[0].strip()[:200]}")
    return validate_mapping(rows.drop("_whole")), digest
