"""Risk, coverage, workload, staffing ladder and scenarios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotaspark.functions.rules import risk_score, risk_severity
from rotaspark.functions.temporal import last_instant, quarter_end, quarter_start
from rotaspark.operators.intervals import overlap_join


def _ratio(top: Column, bottom: Column) -> Column:
    return top / F.nullif(bottom, F.lit(0))


def risk_table(gaps: DataFrame, gap: str = "staffing_gap") -> DataFrame:
    """PR-10 / FN-33."""
    return gaps.withColumn("risk_score", risk_score(F.col(gap))).withColumn(
        "severity", risk_severity(F.col(gap))
    )


def coverage_shortage(needs: DataFrame, agents: str = "agent_count", need: str = "required") -> DataFrame:
    """PR-12: least shortage per interval.

    Assigned and short agents are each limited by the agent count, and no
    interval constrains another, so the optimum is a column expression. A need
    above twice the agents has no solution.
    """
    feasible = F.col(need) <= 2 * F.col(agents)
    return needs.withColumn("feasible", feasible).withColumn(
        "shortage", F.when(feasible, F.greatest(F.col(need) - F.col(agents), F.lit(0)))
    ).withColumn("assigned", F.when(feasible, F.least(F.col(need), F.col(agents))))


def interval_demand(intervals: DataFrame) -> DataFrame:
    """Declared table service_interval_demand, per scope and interval."""
    return intervals.groupBy("business_date", "interval_start", "service_scope").agg(
        F.sum("offered").cast("double").alias("offered"),
        F.sum("answered").cast("double").alias("handled"),
        F.sum("handled_seconds").cast("double").alias("handle_seconds"),
    )


def workload(demand: DataFrame, interval_minutes: int = 15) -> DataFrame:
    """DX-09: AHT = handled seconds / answered; workload = volume x AHT, also in agents."""
    aht = _ratio(F.col("handle_seconds"), F.col("handled"))
    return (
        demand.withColumn("aht_seconds", aht)
        .withColumn("workload_seconds", F.col("offered") * F.col("aht_seconds"))
        .withColumn("required_productive_fte", F.col("workload_seconds") / F.lit(interval_minutes * 60.0))
    )


def shrinkage_uplift(required: DataFrame, shrinkage: str | float) -> DataFrame:
    """DX-10: scheduled = productive / (1 - shrinkage); total shrinkage gives NULL."""
    rate = F.col(shrinkage) if isinstance(shrinkage, str) else F.lit(float(shrinkage))
    return required.withColumn(
        "required_scheduled_fte", F.when(rate < 1, F.col("required_productive_fte") / (1 - rate))
    )


def quarters(df: DataFrame, start: str, end: str) -> DataFrame:
    """One row per 15-minute interval touched, with the overlap in whole seconds."""
    first = quarter_start(F.col(start))
    solid = df.filter(F.col(end) > F.col(start)).withColumn("_first", first)
    grid = solid.withColumn(
        "interval_start",
        F.explode(F.sequence("_first", last_instant(F.col(end)), F.expr("INTERVAL 15 MINUTES"))),
    ).drop("_first")
    lo = F.greatest("interval_start", F.col(start))
    hi = F.least(quarter_end(F.col("interval_start")), F.col(end))
    return grid.withColumn("overlap_seconds", F.timestamp_diff("SECOND", lo, hi))


def staffing_ladder(
    shifts: DataFrame,
    time_off_pieces: DataFrame,
    gaps: DataFrame,
    idle: DataFrame,
    scope: str = "service_scope",
) -> DataFrame:
    """DX-11: scheduled -> available -> present -> effective FTE per scope and interval.

    Every input is a set of (scope, start, end) pieces of one agent-day:
    shifts, planned time off, absence (late, early, no-show) and
    non-productive time. Each piece is cut to the 15-minute grid where it
    stands and all kinds are summed in one aggregate; nothing is joined. Sums
    are whole seconds, so they are exact in any order and divided once.
    """
    parts = {"scheduled": shifts, "time_off": time_off_pieces, "absent": gaps, "idle": idle}
    union: DataFrame | None = None
    for kind, df in parts.items():
        cut = quarters(df.select(scope, "start", "end"), "start", "end").select(
            scope, "interval_start", F.lit(kind).alias("kind"), "overlap_seconds"
        )
        union = cut if union is None else union.unionByName(cut)
    seconds = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("overlap_seconds")).otherwise(F.lit(0).cast("bigint")))
    sums = union.groupBy(scope, "interval_start").agg(*[seconds(kind).alias(f"_{kind}") for kind in parts])
    available = F.col("_scheduled") - F.col("_time_off")
    present = available - F.col("_absent")
    return sums.select(
        scope,
        F.to_date("interval_start").alias("business_date"),
        "interval_start",
        (F.col("_scheduled") / F.lit(900.0)).alias("scheduled_fte"),
        (available / F.lit(900.0)).alias("available_fte"),
        (present / F.lit(900.0)).alias("present_fte"),
        ((present - F.col("_idle")) / F.lit(900.0)).alias("effective_fte"),
    )


def staffing_gap(ladder: DataFrame, required: DataFrame, keys: Sequence[str]) -> DataFrame:
    """DX-11: effective minus required FTE to six digits; an interval without a requirement keeps an unknown gap."""
    need = required.select(*keys, "required_productive_fte")
    return ladder.join(need, list(keys), "left").withColumn(
        "staffing_gap", F.round(F.col("effective_fte") - F.col("required_productive_fte"), 6)
    )


def coverage_quality(staffing: DataFrame, by: Sequence[str], hours: float = 0.25) -> DataFrame:
    """DX-12: FTE-hours under and over requirement, and the share of required hours that is met.

    FTE is summed in millionths, as integers: the sums do not depend on the order
    of rows, and hours are whole millionths, rounded down.
    """
    gap = F.col("staffing_gap")
    millionths = lambda c: F.sum(F.round(c * 1e6).cast("bigint"))
    under = millionths(F.greatest(-gap, F.lit(0.0)))
    over = millionths(F.greatest(gap, F.lit(0.0)))
    need = millionths(F.when(gap.isNotNull(), F.col("required_productive_fte")))
    sums = staffing.groupBy(*by).agg(under.alias("_under"), over.alias("_over"), need.alias("_need"))
    in_hours = lambda c: F.floor(F.col(c) * F.lit(hours)) / F.lit(1e6)
    return sums.select(
        *by,
        in_hours("_under").alias("fte_hours_under"),
        in_hours("_over").alias("fte_hours_over"),
        (1 - _ratio(F.col("_under"), F.col("_need"))).alias("coverage_fit"),
    )


def apply_scenarios(baseline: DataFrame, scenarios: Sequence[dict]) -> DataFrame:
    """DX-13: explicit deltas on a governed baseline, one output row per scenario.

    The scenario list is a driver-side value that travels inside the plan as an
    array literal. Volume is multiplied, AHT is shifted, FTE is added, and the
    requirement goes through the same workload and uplift formulas. Where the
    baseline has an effective FTE, the added FTE goes into it and into the gap.
    """
    fields = ("volume_multiplier", "aht_delta_seconds", "additional_fte", "shrinkage")
    rows = [
        F.struct(F.lit(str(s["name"])).alias("name"), *[F.lit(float(s[f])).alias(f) for f in fields])
        for s in scenarios
    ]
    out = baseline.withColumn("_s", F.explode(F.array(*rows)))
    volume = F.col("offered") * F.col("_s.volume_multiplier")
    aht = F.col("aht_seconds") + F.col("_s.aht_delta_seconds")
    out = (
        out.withColumn("scenario", F.col("_s.name"))
        .withColumn("scenario_volume", volume)
        .withColumn("scenario_aht_seconds", aht)
        .withColumn("required_productive_fte", volume * aht / 900.0)
        .withColumn("scenario_fte_delta", F.col("_s.additional_fte"))
        .withColumns(_scenario_supply(baseline, F.col("_s.additional_fte")))
        .withColumn("_shrinkage", F.col("_s.shrinkage"))
    )
    return shrinkage_uplift(out, "_shrinkage").drop("_s", "_shrinkage")


def _scenario_supply(baseline: DataFrame, added: Column) -> dict[str, Column]:
    if "effective_fte" not in baseline.columns:
        return {}
    effective = F.col("effective_fte") + added
    return {
        "scenario_effective_fte": effective,
        "scenario_staffing_gap": F.round(effective - F.col("required_productive_fte"), 6),
    }


def decision_outcomes(decisions: DataFrame, intervals: DataFrame, baseline_minutes: int = 60) -> DataFrame:
    """DX-14: service level in the outcome window after a decision, against the window before it.

    Components are summed inside each window before any ratio is taken. Spans
    and intervals meet by scope and hour; a decision without any interval stays,
    with unknown measures.
    """
    width = F.make_dt_interval(F.lit(0), F.lit(0), F.col("outcome_window_minutes"))
    before = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(baseline_minutes))
    spans = decisions.select(
        "decision_id", "service_scope", "decided_at",
        (F.col("decided_at") - before).alias("_from"), (F.col("decided_at") + width).alias("_to"),
    )
    facts = intervals.groupBy("service_scope", "interval_start", "interval_end").agg(
        F.sum("offered").alias("offered"), F.sum("answered_within_target").alias("answered_within_target")
    )
    met = overlap_join(
        spans, facts, ["service_scope"], left_span=("_from", "_to"), right_span=("interval_start", "interval_end"),
        unit="HOUR", small=True,  # at most a row per scope and quarter of an hour
    )
    after = F.col("interval_start") >= F.col("decided_at")
    earlier = F.col("interval_end") <= F.col("decided_at")
    part = lambda cond, name: F.sum(F.when(cond, F.col(name)))
    found = met.groupBy("decision_id", "service_scope").agg(
        part(earlier, "offered").cast("bigint").alias("baseline_offered"),
        part(after, "offered").cast("bigint").alias("outcome_offered"),
        part(earlier, "answered_within_target").alias("_b"),
        part(after, "answered_within_target").alias("_a"),
    )
    sums = decisions.select("decision_id", "service_scope").join(found, ["decision_id", "service_scope"], "left")
    return sums.select(
        "decision_id", "service_scope", "baseline_offered", "outcome_offered",
        _ratio(F.col("_b"), F.col("baseline_offered")).alias("baseline_service_level"),
        _ratio(F.col("_a"), F.col("outcome_offered")).alias("outcome_service_level"),
    ).withColumn("service_impact", F.col("outcome_service_level") - F.col("baseline_service_level"))
