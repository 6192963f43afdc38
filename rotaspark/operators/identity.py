"""Agent and queue identity.

Rosters and catalogs are joined without a broadcast hint: Spark broadcasts
them while their size is under `spark.sql.autoBroadcastJoinThreshold` and
shuffles beyond it. Keys that cannot match are replaced by spread-out texts, so
that the shuffled form has no NULL partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotaspark.functions.text import catalog_key, clean, fold_name

# Ids and folded names never start with this character.
_NO_MATCH = "\x01"


def spread_nulls(key: Column, *spread_by: str) -> Column:
    """`key`, or a text that matches nothing and hashes evenly when it is NULL."""
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(4096)).cast("string")
    return F.coalesce(key, F.concat(F.lit(_NO_MATCH), salt))


def eligible_on(status: Column, end_date: Column, day: Column) -> Column:
    """FL-01, for rows that are already valid."""
    return (status == "Active") | ((status == "Leaver") & F.coalesce(day <= end_date, F.lit(False)))


def valid_ids(roster: DataFrame) -> DataFrame:
    return roster.filter("valid AND client_id IS NOT NULL")


def unique_names(roster: DataFrame) -> DataFrame:
    """JN-02: folded names held by exactly one valid row."""
    row = F.struct("employment_status", "end_date", "source_row", "source_key")
    return (
        roster.filter("valid")
        .withColumn("name_key", fold_name(F.col("agent_name")))
        .filter("name_key IS NOT NULL")
        .groupBy("name_key")
        .agg(F.count("*").alias("holders"), F.max(row).alias("row"))
        .filter("holders = 1")
        .select("name_key", "row.*")
    )


def match_agents(
    facts: DataFrame,
    roster: DataFrame,
    *,
    agent_id: str = "source_agent_id",
    agent_name: str = "agent_name",
    spread_by: Sequence[str] = ("source_row",),
) -> DataFrame:
    """JN-01 without its date: adds `_match`, the roster row that an id or else a unique name finds.

    An id known to the roster settles the match. Only an unknown id falls back to a unique name; a blank id finds
    nothing. Where many dates share an agent, match once and use `on_day` per date.
    """
    columns = {"employment_status": "status", "end_date": "end", "source_row": "row", "source_key": "key"}
    by_id = valid_ids(roster).select(
        F.col("client_id").alias("_id"), F.struct(*[F.col(c).alias(n) for c, n in columns.items()]).alias("_by_id")
    )
    by_name = unique_names(roster).select(
        F.col("name_key").alias("_name"), F.struct(*[F.col(c).alias(n) for c, n in columns.items()]).alias("_by_name")
    )
    joined = facts.withColumn("_id_key", spread_nulls(F.col(agent_id), *spread_by)).join(
        by_id, F.col("_id_key") == F.col("_id"), "left"
    )
    # The name is folded only for a known id that missed the roster.
    wanted = F.when(F.col("_id").isNull() & F.col(agent_id).isNotNull(), fold_name(F.col(agent_name)))
    joined = joined.withColumn("_name_key", spread_nulls(wanted, *spread_by)).join(
        by_name, F.col("_name_key") == F.col("_name"), "left"
    )
    kind = F.when(F.col("_id").isNotNull(), "id").when(F.col("_name").isNotNull(), "name")
    match = F.struct(kind.alias("kind"), F.coalesce("_by_id", "_by_name").alias("agent"))
    return joined.withColumn("_match", match).drop("_id_key", "_id", "_by_id", "_name_key", "_name", "_by_name")


def on_day(matched: DataFrame, agent_id: str = "source_agent_id", day: str = "business_date") -> DataFrame:
    """JN-01 on the rows of `match_agents`: scope_match, and the roster ids of those that are eligible on the day."""
    kind, agent = F.col("_match.kind"), F.col("_match.agent")
    ok = kind.isNotNull() & eligible_on(agent["status"], agent["end"], F.col(day))
    resolved = matched.withColumn("scope_match", F.when(ok, kind).otherwise("none"))
    found = F.col("scope_match") != "none"
    return (
        resolved.withColumn("roster_client_id", F.when(found, F.col(agent_id)))
        .withColumn("roster_row", F.when(found, agent["row"]))
        .withColumn("roster_key", F.when(found, agent["key"]))
        .drop("_match")
    )


def resolve_agents(
    facts: DataFrame,
    roster: DataFrame,
    *,
    agent_id: str = "source_agent_id",
    agent_name: str = "agent_name",
    day: str = "business_date",
    spread_by: Sequence[str] = ("source_row",),
) -> DataFrame:
    """JN-01: adds roster_client_id, scope_match (`id`, `name`, `none`), roster_key and roster_row.

    An id known to the roster settles the match even when it is not eligible on
    the day. Only an unknown id falls back to a unique name, and keeps the
    source's own id; a blank id stays outside.
    """
    return on_day(match_agents(facts, roster, agent_id=agent_id, agent_name=agent_name, spread_by=spread_by), agent_id, day)


def scope_rollups(mapping: DataFrame) -> DataFrame:
    """JN-04: service scope key -> comparison scope."""
    return mapping.filter("mapping_type = 'scope_rollup'").select(
        catalog_key(F.col("source_value")).alias("rollup_key"),
        F.col("service_scope").alias("rollup_scope"),
    )


def with_comparison_scope(df: DataFrame, mapping: DataFrame, scope: str = "service_scope") -> DataFrame:
    """JN-04: a scope without a roll-up is its own comparison scope."""
    rolled = df.join(scope_rollups(mapping), catalog_key(F.col(scope)) == F.col("rollup_key"), "left")
    return rolled.withColumn("comparison_scope", F.coalesce("rollup_scope", scope)).drop(
        "rollup_key", "rollup_scope"
    )


def queue_lookup(mapping: DataFrame, source_system: str) -> DataFrame:
    """One row per queue key: the source system's own row, else STORM's, else ANY's."""
    system = catalog_key(F.col("source_system"))
    ranks = [catalog_key(F.lit(source_system)), F.lit("STORM"), F.lit("ANY")]
    rank = F.when(system == ranks[0], 0).when(system == ranks[1], 1).when(system == ranks[2], 2)
    rows = (
        mapping.filter("mapping_type = 'queue'")
        .withColumn("queue_key", catalog_key(F.col("source_value")))
        .withColumn("system_rank", rank)
        .filter("system_rank IS NOT NULL AND queue_key <> ''")
    )
    best = rows.groupBy("queue_key").agg(
        F.min_by(F.struct("service_scope", F.nullif(F.col("designation"), F.lit("")).alias("designation")),
                 "system_rank").alias("hit")
    )
    return with_comparison_scope(best.select("queue_key", "hit.*"), mapping)


def map_queues(
    facts: DataFrame,
    mapping: DataFrame,
    *,
    source_system: str = "STORM",
    queue: str = "queue",
    partner: str | None = None,
    lob: str | None = None,
    spread_by: Sequence[str] = ("source_row",),
) -> DataFrame:
    """JN-03: adds service_scope, comparison_scope, designation and mapping_status.

    The queue is tried before the business partner; a line of business is the
    last resort. Calls pass the queue only.
    """
    lookup = queue_lookup(mapping, source_system)
    out, hits = facts, []
    for i, column in enumerate([queue] if partner is None else [queue, partner]):
        side = lookup.select(
            F.col("queue_key").alias(f"_k{i}"),
            F.struct("service_scope", "comparison_scope", "designation").alias(f"_hit{i}"),
        )
        key = spread_nulls(F.nullif(catalog_key(F.col(column)), F.lit("")), *spread_by)
        out = out.withColumn(f"_key{i}", key).join(side, F.col(f"_key{i}") == F.col(f"_k{i}"), "left")
        out = out.drop(f"_key{i}", f"_k{i}")
        hits.append(F.col(f"_hit{i}"))
    hit = F.coalesce(*hits)
    fallback = clean(F.col(lob)) if lob is not None else F.lit(None).cast("string")
    out = (
        out.withColumn("_hit", hit)
        .withColumn("_lob", fallback)
        .withColumn("service_scope", F.coalesce(F.col("_hit.service_scope"), F.col("_lob")))
        .withColumn("comparison_scope", F.coalesce(F.col("_hit.comparison_scope"), F.col("_lob")))
        .withColumn("designation", F.col("_hit.designation"))
        .withColumn(
            "mapping_status",
            F.when(F.col("_hit").isNotNull(), "MAPPED")
            .when(F.col("_lob").isNotNull(), "FALLBACK_LOB")
            .otherwise("UNMAPPED"),
        )
    )
    return out.drop("_hit", "_lob", *[f"_hit{i}" for i in range(len(hits))])


def map_forecast_files(files: DataFrame, mapping: DataFrame, name: str = "file_name") -> DataFrame:
    """DX-17: forecast file -> service and comparison scope."""
    side = mapping.filter("mapping_type = 'forecast_file'").select(
        catalog_key(F.col("source_value")).alias("_file_key"), "service_scope"
    )
    stem = F.regexp_replace(F.col(name), r"\.[A-Za-z0-9]+$", "")
    mapped = files.join(side, catalog_key(stem) == F.col("_file_key"), "left").drop("_file_key")
    return with_comparison_scope(mapped, mapping)
