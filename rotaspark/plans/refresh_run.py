"""One refresh from source folder to pointer.

inventory -> unchanged? -> new generation -> hash what changed -> reuse or read -> Bronze -> moved meanwhile? ->
what must be rebuilt, by cause -> findings and gate -> those marts and dates -> pointer.

Work follows the change. Bronze holds source rows as text by source date; they depend on the file and its adapter only,
so a change of mapping or policy opens no raw file. A generation is a list of mart parts (mart, date), each in the
folder of the generation that wrote it: untouched dates are pointed to, not copied. Base marts read the Bronze dates
they rebuild, derived marts read the published parts below them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotaspark import schemas
from rotaspark.functions.keys import fingerprint
from rotaspark.operators.latest import keep_first
from rotaspark.plans import actuals, attendance, calls, refresh, roster
from rotaspark.plans.causes import ALL, BY_NAME, GENERATION_INPUT, MARTS, Scope, around, scopes
from rotaspark.policy import AttendancePolicy, ServiceRules, StatusPolicy
from rotaspark.sources import bronze, readers, writers
from rotaspark.sources import inventory as inv
from rotaspark.sources.adapters import Adapter, AdapterRegistry
from rotaspark.sources.stage import staged

ANY = "unsorted"
TYPES = ("fte_roster", "pto_register", "away_register", "published_schedule", "agent_status", "lilo", "call_by_call")
ADAPTER_VERSIONS = dict.fromkeys(TYPES, "1")
_DATED = ("published_schedule", "agent_status", "lilo", "call_by_call")
#: Base marts and the source type each is made of.
_BASE = {"schedule_shift": "published_schedule", "agent_status": "agent_status", "lilo": "lilo", "call_leg": "call_by_call"}
_IDENTITY = (
    "business_date date, roster_client_id string, roster_key string, roster_row bigint, source_key string, "
    "source_row bigint, source_column int"
)
_UNKNOWN, _PRIMARY, _CARRY = "unknown", "status_primary", "carry_days"


@dataclass(frozen=True)
class RefreshPolicies:
    """What besides the files decides a result."""

    mapping_path: str
    as_of: datetime
    status: StatusPolicy = field(default_factory=StatusPolicy)
    attendance: AttendancePolicy = field(default_factory=AttendancePolicy)
    service: ServiceRules = field(default_factory=ServiceRules)
    model_version: str = "1"


@dataclass(frozen=True)
class RefreshResult:
    generation_id: int | None
    changed: bool
    read_sources: int = 0
    reused_sources: int = 0
    rebuilt_dates: int | None = None
    scopes: dict[str, Scope] = field(default_factory=dict)


def sort_source(title: str, comma: list[str], tab: list[str]) -> str | None:
    """SRC-02: the source type that a file's header, or a register's title, names; None for a file of no kind."""
    bare = {c.strip().strip("[]").strip() for c in comma}
    if readers.sniff_schedule(tab):
        return "published_schedule"
    if set(actuals.STATUS_HEADERS) <= set(comma):
        return "agent_status"
    if set(actuals.LILO_HEADERS) <= set(comma):
        return "lilo"
    if set(calls.REQUIRED_HEADERS) <= bare:
        return "call_by_call"
    for kind in ("PTO", "AWAY"):
        if readers.normalize_header(title) in readers.REGISTER_TITLES[kind]:
            return f"{kind.lower()}_register"
    return "fte_roster" if readers.roster_tier(title, comma) else None


def _title(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def adapters() -> AdapterRegistry:
    """The source types with their readers; each reader takes (spark, root, paths) and gives text rows."""
    registry = AdapterRegistry()
    plain = lambda spark, root, paths: readers.read_delimited(spark, root, paths, keep_header=True)
    by_type: dict[str, Callable] = {
        "published_schedule": lambda spark, root, paths: readers.read_schedule(spark, root, paths)[0],
        "agent_status": readers.read_status,
        "lilo": lambda spark, root, paths: readers.read_lilo(spark, root, paths, keep_header=True),
        "call_by_call": readers.read_calls,
    }
    for name in TYPES:
        registry.register(Adapter(name, ADAPTER_VERSIONS[name], lambda key: False, by_type.get(name, plain)))
    return registry


def _current(spark: SparkSession, root: str, active: DataFrame | None) -> DataFrame:
    """Files with their type; a header is read only where the file is new or moved."""
    files = staged(inv.inventory(spark, root, "", None, ANY, recursive=True).drop("source_type"), "inventory")
    if active is not None:
        known = active.select("source_key", F.col("source_type").alias("known"), F.struct("file_size", "mtime").alias("was"))
        files = files.join(known, "source_key", "left")
        same = F.coalesce(F.struct("file_size", "mtime") == F.col("was"), F.lit(False))
        files = files.withColumn("known", F.when(same, F.col("known"))).drop("was")
    else:
        files = files.withColumn("known", F.lit(None).cast("string"))
    new = {r["source_key"]: r["path"] for r in files.where("known IS NULL").collect()}
    plain = {k: p.removeprefix("file:") if p.startswith("file:/") else p for k, p in new.items()}
    comma = readers.headers_of(spark, list(plain.values())) if plain else {}
    found = []
    for key, path in plain.items():
        cells = comma[path][0]
        tab = cells[0].split("\t") if len(cells) == 1 else []
        found.append((key, sort_source(_title(path), cells, tab)))
    types = spark.createDataFrame(found, "source_key string, found string")
    typed = files.join(types, "source_key", "left").withColumn("source_type", F.coalesce("known", "found"))
    return staged(typed.where("source_type IS NOT NULL").drop("known", "found"), "inventory-typed")


def _contracts(spark: SparkSession, policies: RefreshPolicies, catalog: str) -> DataFrame:
    prints = {"agent_status": policies.status.fingerprint, "call_by_call": policies.service.fingerprint(catalog)}
    rows = [(t, ADAPTER_VERSIONS[t], prints.get(t, policies.attendance.fingerprint)) for t in TYPES]
    return spark.createDataFrame(rows, "source_type string, adapter_version string, policy_fingerprint string")


def raw_owners(wanted: DataFrame, manifest: DataFrame, generations: DataFrame) -> DataFrame:
    """GN-04 for raw rows: the newest succeeded generation whose Bronze holds the same content by the same adapter."""
    key = ["source_type", "source_key", "content_sha256", "adapter_version"]
    ok = generations.where("status = 'succeeded'").select("generation_id")
    held = manifest.where("state = 'present' AND row_count IS NOT NULL").join(ok, "generation_id", "left_semi")
    held = held.select(*key, "generation_id", "bronze_generation_id", "row_count", "date_from", "date_to")
    best = keep_first(held.join(wanted.select(key), key, "left_semi"), key, [F.desc("generation_id")])
    return best.drop("generation_id")


def _tables(raw: DataFrame) -> dict[str, DataFrame]:
    """The tables among Bronze rows of a type, each with its own columns: rosters and registers are a few files."""
    headers = raw.groupBy("source_key").agg(F.first("header_cells").alias("cells")).collect()
    place = ("source_key", "source_mtime", "source_row")
    return {r["source_key"]: raw.where(F.col("source_key") == r["source_key"]).select(*place, *[f"`{c}`" for c in r["cells"]]) for r in headers}


class _Run:
    """The frames of one refresh; raw rows come from Bronze by their owners, marts from their parts."""

    def __init__(self, spark: SparkSession, store: refresh.GenerationStore, policies: RefreshPolicies, manifest: DataFrame, mapping: DataFrame):
        self.spark, self.store, self.policies, self.manifest, self.mapping = spark, store, policies, manifest, mapping
        self.generation = manifest.first()["generation_id"] if manifest.limit(1).count() else None
        self.built: dict[str, DataFrame | None] = {}
        self.parts: dict[str, list] = {}

    def held(self, source_type: str) -> DataFrame:
        """BRONZE_PART rows of the sources of a type, in the generation that owns each."""
        mine = self.manifest.where((F.col("source_type") == source_type) & (F.col("state") == "present"))
        owners = mine.select(F.col("bronze_generation_id").alias("generation_id"), "source_type", "source_key")
        return self.store.control("bronze_part", bronze.BRONZE_PART).join(owners, ["generation_id", "source_type", "source_key"])

    def raw(self, source_type: str, dates: frozenset[date] | None = None, keys: DataFrame | None = None) -> DataFrame | None:
        """Bronze rows of a type: of some dates, of some sources, or all; None where there is none.

        Only the folders of the dates that are asked for are opened; a schedule's file has many dates, and is opened
        whole where its header has one of them. The driver sees one row per generation and date.
        """
        spark, held, whole = self.spark, self.held(source_type), source_type not in ("agent_status", "lilo", "call_by_call")
        folders = self.store.control("bronze_folder", bronze.BRONZE_FOLDER).where(F.col("source_type") == source_type)
        folders = {r["generation_id"]: r["columns"] for r in folders.collect()}
        owners = {r[0] for r in held.select("generation_id").distinct().collect()}
        columns = [c for g in sorted(owners) for c in folders[g]]
        manifest = self.manifest
        if keys is not None:
            held, manifest = held.join(keys, "source_key", "left_semi"), manifest.join(keys, "source_key", "left_semi")
        if dates is not None:
            days = spark.createDataFrame([(d,) for d in sorted(dates)], "source_date date")
            held = held.join(days, "source_date", "left_semi")
            if whole:
                manifest = manifest.join(held.select("source_key"), "source_key", "left_semi")
        if whole:
            places = [r[0] for r in held.select("generation_id").distinct().collect()]
        else:
            places = [(r[0], r[1]) for r in held.select("generation_id", "source_date").distinct().collect()]
        rows = bronze.read(spark, self.store.root, source_type, columns, places)
        if rows is None:
            return None
        return refresh.bronze_for(manifest, self.generation, rows, source_type).drop("generation_id", "source_date")

    def get(self, name: str) -> DataFrame | None:
        if name not in self.built:
            made = getattr(self, f"_{name}")()
            self.built[name] = None if made is None else staged(made, name)
        return self.built[name]

    def _roster(self) -> DataFrame:
        raw = self.raw("fte_roster")
        if raw is None:
            raise refresh.RefreshError("no roster among the sources")
        tables = {_title(key): table for key, table in _tables(raw).items()}
        return roster.parse_roster(readers.choose_roster(tables))

    def _time_off(self) -> DataFrame | None:
        registers = {}
        for kind in ("PTO", "AWAY"):
            raw = self.raw(f"{kind.lower()}_register")
            tables = {} if raw is None else {_title(key): table for key, table in _tables(raw).items()}
            registers[kind] = readers.choose_register(tables, kind)
        if registers["PTO"] is None and registers["AWAY"] is None:
            return self.spark.createDataFrame([], schemas.RAW_FTE_TIME_OFF)
        return roster.parse_time_off(self.get("roster"), registers["PTO"], registers["AWAY"])

    def lanes(self, source_type: str, dates: frozenset[date] | None = None, keys: DataFrame | None = None) -> DataFrame | None:
        """Parsed rows of a type with their lanes."""
        raw = self.raw(source_type, dates, keys)
        if raw is None:
            return None
        people = self.get("roster")
        if source_type == "published_schedule":
            days = [c for c in raw.columns if (d := readers.is_header_date(c)) and (dates is None or d in dates)]
            return roster.parse_schedule(raw, days, people)
        if source_type == "agent_status":
            return actuals.parse_status(raw, people, self.policies.status)
        if source_type == "lilo":
            return actuals.parse_lilo(raw, people)
        return calls.parse_calls(raw, people, self.mapping)

    def all_lanes(self, source_type: str) -> DataFrame | None:
        """The lanes of all rows of a type, parsed once for mart and findings."""
        if source_type not in self.built:
            rows = self.lanes(source_type)
            self.built[source_type] = None if rows is None else staged(rows, f"lanes-{source_type}")
        return self.built[source_type]

    def findings(self, scope: dict[str, Scope], changed: DataFrame, old: DataFrame | None) -> DataFrame:
        """Findings of the roster and of changed sources; those of other sources as the base recorded them."""
        out = roster.roster_findings(self.get("roster"))
        makers = {
            "published_schedule": roster.schedule_findings, "agent_status": actuals.status_findings,
            "lilo": actuals.lilo_findings, "call_by_call": calls.call_findings,
        }
        kept = self.manifest.where(F.col("state") == "present").select("source_type", "source_key")
        for mart, source_type in _BASE.items():
            whole = scope[mart] == ALL or old is None
            keys = changed.where(F.col("source_type") == source_type).select("source_key")
            rows = self.all_lanes(source_type) if whole else self.lanes(source_type, keys=keys)
            if rows is not None:
                out = out.unionByName(makers[source_type](rows).drop("row_count"))
            if whole:
                kept = kept.where(F.col("source_type") != source_type)
        if old is None:
            return out
        kept = kept.where(F.col("source_type").isin(*_DATED)).join(changed, ["source_type", "source_key"], "left_anti")
        return out.unionByName(old.join(kept.select("source_key"), "source_key", "left_semi").select(out.columns))

    def view(self, mart: str, like: str, dates: frozenset[date] | None = None) -> DataFrame:
        """Rows of a mart of this generation: of some dates, or all."""
        parts = [p for p in self.parts.get(mart, []) if dates is None or p["part_date"] in dates]
        return refresh.read_parts(self.spark, self.store.root, mart, BY_NAME[mart].day, parts, like)

    def _base(self, mart: str, scope: Scope) -> DataFrame:
        source_type = _BASE[mart]
        pick, like = {
            "schedule_shift": (roster.canonical_schedule, schemas.SCHEDULE_SHIFT), "agent_status": (actuals.accepted, schemas.RAW_AGENT_STATUS),
            "lilo": (actuals.accepted, schemas.RAW_LILO), "call_leg": (lambda rows: calls.canonical_calls(calls.accepted(rows)), schemas.CALL_LEG),
        }[mart]
        rows = self.all_lanes(source_type) if scope == ALL else self.lanes(source_type, dates=scope)
        names = [c.split(" ")[0] for c in like.replace("array<string>", "array").split(", ")]
        return self.spark.createDataFrame([], like) if rows is None else pick(rows).select(*names)

    def _identities(self, scope: Scope) -> DataFrame:
        """The first cell per date of each agent that schedules know by name only."""
        rows = self.all_lanes("published_schedule") if scope == ALL else self.lanes("published_schedule", dates=scope)
        if rows is None:
            return self.spark.createDataFrame([], _IDENTITY)
        named = rows.where("valid AND in_roster_scope AND scope_match = 'name'")
        seen = F.struct("source_key", "source_row", "source_column")
        first = named.groupBy("business_date", "roster_client_id").agg(
            F.min_by(F.struct("roster_key", "roster_row", "source_key", "source_row", "source_column"), seen).alias("f")
        )
        return first.select("business_date", "roster_client_id", "f.*")

    def _attendance(self, scope: Scope) -> DataFrame:
        """The attendance model of the shifts in scope, from the evidence of their dates and those beside them."""
        if scope == ALL:
            status_dates = lilo_dates = shifts = None
        else:
            shifts, lilo_dates = scope, around(dict.fromkeys(scope, 0))
            status_dates = frozenset(
                p["part_date"] for p in self.parts.get("agent_status", [])
                if any(p["part_date"] + timedelta(n) in lilo_dates for n in range((p["measures"] or {}).get(_CARRY, 0) + 1))
            )
        off = self.view("time_off", schemas.RAW_FTE_TIME_OFF.replace("valid boolean, validation_codes array<string>, ", ""))
        return attendance.attendance_model(
            self.view("schedule_shift", schemas.SCHEDULE_SHIFT, shifts), self.view("agent_status", schemas.RAW_AGENT_STATUS, status_dates),
            self.view("lilo", schemas.RAW_LILO, lilo_dates), off, self.policies.attendance, self.policies.as_of,
        )

    def rows(self, mart: str, scope: Scope) -> DataFrame:
        """The rows of a mart in a scope."""
        if mart in _BASE:
            return self._base(mart, scope)
        if mart == "schedule_identity":
            return self._identities(scope)
        if mart == "service_interval":
            legs = self.view("call_leg", schemas.CALL_LEG, None if scope == ALL else scope)
            return calls.service_intervals(legs, self.policies.service)
        if mart == "time_off":
            return roster.canonical_time_off(self.get("time_off"))
        if mart == "agent_roster":
            named = self.view("schedule_identity", _IDENTITY).withColumns(
                {"valid": F.lit(True), "in_roster_scope": F.lit(True), "scope_match": F.lit("name")}
            )
            return roster.canonical_roster(self.get("roster"), named)
        if self.built.get("model_scope") != scope:
            self.built["model"], self.built["model_scope"] = staged(self._attendance(scope), "attendance_model"), scope
        model = self.built["model"]
        return attendance.agent_days(model) if mart == "attendance_agent_day" else attendance.attendance_gaps(model)

    def publish(self, number: int, scope: dict[str, Scope], base: list) -> None:
        """Writes the parts in scope, points to the base's for the rest, and records both."""
        for mart in MARTS:
            mine = scope[mart.name]
            kept = [p.asDict() for p in base if p["mart"] == mart.name]
            if mine == ALL or mart.day is None and mine:
                kept = []
            elif mine:
                kept = [p for p in kept if p["part_date"] not in mine]
            self.parts[mart.name] = kept
            if not mine:
                continue
            rows = self.rows(mart.name, mine if mart.day else ALL)
            if mart.day and mine != ALL:
                rows = rows.where(F.col(mart.day).isin(sorted(mine)))
            path = writers.write_mart(rows, self.store.root, "mart", mart.name, number, by=(mart.day,) if mart.day else ())
            kept.extend(_measured(self.spark, path, rows, mart, number))
        rows = [(number, m, p["part_date"], p["owner_generation_id"], p["row_count"], p["measures"]) for m, parts in self.parts.items() for p in parts]
        self.store.append(self.spark.createDataFrame(rows, refresh.MART_PART), "mart_part")
        summary = generation_counts(self.parts, refresh.source_totals(self.manifest).collect())
        self.store.append(self.spark.createDataFrame([(number, k, v) for k, v in summary.items()], refresh.GENERATION_SUMMARY), "generation_summary")


def _measured(spark: SparkSession, path: str, rows: DataFrame, mart, number: int) -> list[dict]:
    """One record per written part: its rows, and what later refreshes and the summary need to know of it."""
    written = spark.read.schema(rows.schema).parquet(path)
    extra = {
        "agent_status": {_CARRY: F.max(F.greatest(F.datediff(F.to_date("status_end"), F.col("extract_date")), F.lit(0)))},
        "attendance_agent_day": {_PRIMARY: F.count_if("status_is_primary"), _UNKNOWN: F.count_if(F.col("evidence_state") == "UNKNOWN")},
    }.get(mart.name, {})
    by = [F.col(mart.day)] if mart.day else [F.lit(None).cast("date")]
    found = written.groupBy(*[c.alias("part_date") for c in by]).agg(F.count("*").alias("n"), *[c.cast("bigint").alias(k) for k, c in extra.items()])
    return [
        {"mart": mart.name, "part_date": r["part_date"], "owner_generation_id": number, "row_count": r["n"], "measures": {k: r[k] for k in extra}}
        for r in found.collect()
    ]


def generation_counts(parts: dict[str, list], totals: list) -> dict[str, int]:
    """AG-09: the seventeen counts of a generation, from its parts and its manifest."""
    n = {mart: sum(p["row_count"] for p in mine) for mart, mine in parts.items()}
    days = [p["measures"] or {} for p in parts.get("attendance_agent_day", [])]
    files = {t["source_type"]: t for t in totals}
    of = lambda kind, what: int(files[kind][what]) if kind in files else 0
    return {
        "roster_agents": n.get("agent_roster", 0), "time_off_records": n.get("time_off", 0),
        "schedule_assignments": n.get("schedule_shift", 0), "agent_status_rows": of("agent_status", "row_count"),
        "lilo_rows": of("lilo", "row_count"), "raw_call_legs": of("call_by_call", "row_count"),
        "canonical_call_legs": n.get("call_leg", 0), "service_intervals": n.get("service_interval", 0),
        "attendance_agent_days": n.get("attendance_agent_day", 0), "attendance_gap_fragments": n.get("attendance_gap", 0),
        "status_primary_days": sum(d.get(_PRIMARY, 0) for d in days), "attendance_unknown_days": sum(d.get(_UNKNOWN, 0) for d in days),
        "source_files": sum(int(t["file_count"]) for t in totals), "schedule_files": of("published_schedule", "file_count"),
        "agent_status_files": of("agent_status", "file_count"), "lilo_files": of("lilo", "file_count"), "call_files": of("call_by_call", "file_count"),
    }


def published_health(store: refresh.GenerationStore, catalog_sha256: str) -> DataFrame:
    """GN-09 / PR-09 of the active generation, from its control tables only."""
    active = store.active_id()
    number = -1 if active is None else active
    summary = store.parts(number).groupBy(F.col("mart").alias("table_name")).agg(
        F.sum("row_count").alias("row_count"), F.min("part_date").alias("date_from"), F.max("part_date").alias("date_to")
    )
    totals = refresh.source_totals(store.manifest().where(F.col("generation_id") == number))
    return refresh.source_health(totals, summary, store.generations(), active, catalog_sha256)


def run_refresh(spark: SparkSession, root: str, store: refresh.GenerationStore, policies: RefreshPolicies) -> RefreshResult:
    """Refreshes all marts from the files under root and moves the pointer; the active generation stays on any failure.

    Raises SourceError or QualityGateError on bad sources and RefreshError where files move while they are read or
    another refresh was faster.
    """
    mapping, catalog = readers.read_queue_mapping(spark, policies.mapping_path)
    active_id = store.active_id()
    active = None if active_id is None else store.manifest().where(F.col("generation_id") == active_id).where("state = 'present'")
    current = _current(spark, root, active)
    contracts = _contracts(spark, policies, catalog)
    base = None
    if active is not None:
        base = store.generations().where(F.col("generation_id") == active_id).first()
        stands = refresh.unchanged(active, current, contracts).first()[0]
        if stands and (base["catalog_sha256"], base["model_version"]) == (catalog, policies.model_version):
            return RefreshResult(active_id, False)
    generation = store.start(catalog, policies.model_version)
    try:
        return _refresh(spark, root, store, policies, generation, current, contracts, mapping, active, base)
    except Exception as exc:
        store.fail(generation, f"{type(exc).__name__}: {exc}"[:500])
        raise


def _versions(spark, root, store, current, contracts, active) -> DataFrame:
    """The current files with content hash, adapter and policy; only new or moved files are hashed."""
    none = spark.createDataFrame([], schemas.SOURCE_MANIFEST)
    fresh = [r["path"] for r in refresh.to_hash(active if active is not None else none, current).collect()]
    hashed = inv.fingerprint(spark, fresh).select(inv.source_key(F.col("path"), root).alias("source_key"), F.col("content_sha256").alias("new_sha")) if fresh else None
    old = (active if active is not None else none).select("source_type", "source_key", F.col("content_sha256").alias("old_sha"))
    rows = current.join(old, ["source_type", "source_key"], "left")
    rows = rows.join(hashed, "source_key", "left") if hashed is not None else rows.withColumn("new_sha", F.lit(None).cast("string"))
    rows = rows.withColumn("content_sha256", F.coalesce("new_sha", "old_sha")).drop("new_sha", "old_sha")
    return staged(rows.join(contracts, "source_type"), "source-versions")


def _intact_owners(spark: SparkSession, store: refresh.GenerationStore, owners: DataFrame) -> DataFrame:
    """AG-15: owners whose Bronze is whole. Only folders that no longer look as recorded are counted."""
    parts = store.control("bronze_part", bronze.BRONZE_PART)
    known = parts.select(F.col("generation_id").alias("bronze_generation_id"), "source_type", "source_key").distinct()
    owners = owners.join(known, ["bronze_generation_id", "source_type", "source_key"], "left_semi")
    used = owners.select("source_type", F.col("bronze_generation_id").alias("generation_id")).distinct()
    folders = store.control("bronze_folder", bronze.BRONZE_FOLDER).join(used, ["source_type", "generation_id"]).collect()
    for source_type in TYPES:
        mine = [f for f in folders if f["source_type"] == source_type]
        for generation in bronze.broken(spark, store.root, source_type, mine):
            columns = next(f["columns"] for f in mine if f["generation_id"] == generation)
            there = bronze.content(spark, f"{store.root}/bronze/{source_type}/generation_id={generation}")[0]
            rows = bronze.read(spark, store.root, source_type, columns, [generation] if there else [])
            hit = (F.col("source_type") == source_type) & (F.col("bronze_generation_id") == generation)
            if rows is None:
                owners = owners.where(~hit)
            else:
                short = refresh.staged_counts(owners.where(hit).withColumn("state", F.lit("present")), rows)
                owners = owners.join(short.select("source_type", "source_key"), ["source_type", "source_key"], "left_anti")
    return owners


def _read_missing(spark, root, store, generation, missing) -> None:
    """Reads the sources that no generation holds into Bronze, and records what was written."""
    registry = adapters()
    for source_type in TYPES:
        paths = [r["path"].removeprefix("file:") if r["path"].startswith("file:/") else r["path"] for r in missing if r["source_type"] == source_type]
        if paths:
            written = bronze.write(registry.get(source_type).normalize(spark, root, paths), store.root, source_type, generation)
            store.append(bronze.parts_of(written, source_type, generation), "bronze_part")
            store.append(bronze.folder_of(spark, written, store.root, source_type, generation), "bronze_folder")


def _inputs(store, policies: RefreshPolicies, contracts_catalog: str, manifest: DataFrame) -> dict[str, str]:
    """What decides whole marts, by name; a changed value names the cause of a rebuild."""
    def versions(*types: str) -> str:
        rows = manifest.where(F.col("source_type").isin(*types)).select("source_key", "content_sha256", "adapter_version").collect()
        return fingerprint("sources-1", repr(sorted(map(tuple, rows))))

    folders = store.control("bronze_folder", bronze.BRONZE_FOLDER).withColumnRenamed("generation_id", "bronze_generation_id")
    used = manifest.select("source_type", "bronze_generation_id").distinct()
    columns = folders.join(used, ["source_type", "bronze_generation_id"]).groupBy("source_type").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("columns")))).alias("columns")
    )
    named = {f"columns:{r['source_type']}": fingerprint("columns-1", repr(r["columns"])) for r in columns.collect()}
    return named | {
        "model": policies.model_version, "mapping": contracts_catalog, "roster": versions("fte_roster"),
        "registers": versions("pto_register", "away_register"), "service_rules": repr(policies.service),
        "status_policy": policies.status.fingerprint, "attendance_policy": policies.attendance.fingerprint,
        "as_of": policies.as_of.replace(microsecond=0).isoformat(),
    }


def _source_dates(store, *manifests: DataFrame) -> dict[str, dict[date, int]]:
    """Per type, the dates of some source versions and how far rows of each date carry over: one row per type and date."""
    parts = store.control("bronze_part", bronze.BRONZE_PART).where("source_date IS NOT NULL")
    out: dict[str, dict[date, int]] = {}
    for manifest in manifests:
        owned = manifest.select(F.col("bronze_generation_id").alias("generation_id"), "source_type", "source_key")
        found = parts.join(owned, ["generation_id", "source_type", "source_key"]).groupBy("source_type", "source_date")
        for r in found.agg(F.max("carry_days").alias("carry")).collect():
            mine = out.setdefault(r["source_type"], {})
            mine[r["source_date"]] = max(mine.get(r["source_date"], 0), r["carry"] or 0)
    return out


def _refresh(spark, root, store, policies, generation, current, contracts, mapping, active, base) -> RefreshResult:
    wanted = _versions(spark, root, store, current, contracts, active)
    key = ["source_type", "source_key", "content_sha256", "adapter_version"]
    owners = staged(_intact_owners(spark, store, raw_owners(wanted, store.manifest(), store.generations())), "bronze-owners")
    missing = wanted.join(owners.select(key), key, "left_anti").select("source_type", "path").collect()
    _read_missing(spark, root, store, generation, missing)
    again = inv.inventory(spark, root, "", None, ANY, recursive=True)
    seen = current.select(F.lit(ANY).alias("source_type"), "source_key", "file_size", "mtime")
    if inv.moved(seen, again.join(current.select("source_key"), "source_key", "left_semi")).limit(1).count():
        raise refresh.RefreshError("a source changed while it was read")
    fresh = store.control("bronze_part", bronze.BRONZE_PART).where(F.col("generation_id") == generation).groupBy("source_type", "source_key").agg(
        F.sum("row_count").alias("new_rows"), F.min("source_date").alias("first"),
        F.max(F.expr("date_add(source_date, coalesce(carry_days, 0))")).alias("last"),
    )
    rows = wanted.join(owners, key, "left").join(fresh, ["source_type", "source_key"], "left")
    manifest = rows.select(
        F.lit(generation).cast("bigint").alias("generation_id"), "source_type", "source_key", F.lit("present").alias("state"),
        "file_size", "mtime", "content_sha256", "adapter_version", "policy_fingerprint",
        F.coalesce("row_count", "new_rows", F.lit(0)).cast("bigint").alias("row_count"),
        F.coalesce("bronze_generation_id", F.lit(generation)).cast("bigint").alias("bronze_generation_id"),
        F.coalesce("date_from", "first").alias("date_from"), F.coalesce("date_to", "last").alias("date_to"),
    )
    run = _Run(spark, store, policies, staged(manifest, "manifest"), mapping)
    versions, gone = run.manifest.drop("generation_id"), None
    if active is not None:
        gone = active.join(current.select("source_type", "source_key"), ["source_type", "source_key"], "left_anti")
        versions = versions.unionByName(gone.withColumn("state", F.lit("removed")).drop("generation_id"))
    store.record_sources(generation, versions)
    inputs = _inputs(store, policies, store.generations().where(F.col("generation_id") == generation).first()["catalog_sha256"], run.manifest)
    store.append(spark.createDataFrame([(generation, k, v) for k, v in inputs.items()], GENERATION_INPUT), "generation_input")
    scope, changed, parts = _scope(run, active, base, current, inputs)
    old = None if base is None else store.issues().where(F.col("generation_id") == base["generation_id"])
    store.record_issues(generation, run.findings(scope, changed, old))
    store.activate(generation, lambda number: run.publish(number, scope, parts))
    every = None if ALL in scope.values() else len(frozenset().union(*scope.values()))
    return RefreshResult(generation, True, len(missing), wanted.count() - len(missing), every, scope)


def _scope(run: _Run, active, base, current, inputs: dict[str, str]) -> tuple[dict[str, Scope], DataFrame, list]:
    """GN-08 / GN-04: what to rebuild, the changed sources, and the parts of the base that the rest is pointed to."""
    store, keys = run.store, ["source_type", "source_key"]
    everything = dict.fromkeys(BY_NAME, ALL)
    parts = [] if base is None else store.parts(base["generation_id"]).collect()
    if not parts:
        return everything, run.manifest.select(keys), []
    before = {r["name"]: r["value"] for r in store.control("generation_input", GENERATION_INPUT).where(F.col("generation_id") == base["generation_id"]).collect()}
    diff = refresh.manifest_diff(active, current).where("change <> 'same'").select(keys)
    owner = [*keys, "bronze_generation_id"]
    other = run.manifest.select(owner).join(active.select(owner), owner, "left_anti").select(keys)
    changed = staged(diff.unionByName(other).distinct(), "changed-sources")
    touched = _source_dates(store, active.join(changed, keys, "left_semi"), run.manifest.join(changed, keys, "left_semi"))
    unfinished: frozenset[date] = frozenset()
    if before.get("as_of") != inputs["as_of"]:
        then = datetime.fromisoformat(before["as_of"]).date() - timedelta(2)
        unfinished = frozenset(p["part_date"] for p in parts if p["mart"] == "schedule_shift" and p["part_date"] >= then)
    causes = {name for name, value in inputs.items() if before.get(name) != value} - {"as_of"}
    return scopes(causes, touched, unfinished), changed, parts
