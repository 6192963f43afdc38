"""What a refresh must rebuild: from changed inputs and changed sources to marts and their dates.

A mart is rebuilt whole when an input that decides all its rows changed (roster, mapping, a policy, the columns that
raw rows are hashed with), for some dates when sources or marts below it changed there, and not at all otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import date, timedelta

ALL = "all"
Scope = str | frozenset[date]
GENERATION_INPUT = "generation_id bigint, name string, value string"


@dataclass(frozen=True)
class Mart:
    """A published table: its date column, the inputs that decide all of it, its source types and the marts it reads."""

    name: str
    day: str | None = "business_date"
    causes: frozenset[str] = frozenset()
    sources: tuple[str, ...] = ()
    reads: tuple[str, ...] = ()
    evidence: tuple[str, ...] = field(default=())


def _mart(name: str, day: str | None = "business_date", causes: str = "", **kw) -> Mart:
    return Mart(name, day, frozenset(causes.split()), **kw)


#: In build order. `evidence` names marts whose rows also matter to the dates beside their own.
MARTS = (
    _mart("schedule_shift", causes="model roster", sources=("published_schedule",)),
    _mart("schedule_identity", causes="model roster", sources=("published_schedule",)),
    _mart("agent_status", "extract_date", "model roster status_policy columns:agent_status", sources=("agent_status",)),
    _mart("lilo", "extract_date", "model roster", sources=("lilo",)),
    _mart("call_leg", causes="model roster mapping columns:call_by_call", sources=("call_by_call",)),
    _mart("service_interval", causes="service_rules", reads=("call_leg",)),
    _mart("time_off", None, "model roster registers"),
    _mart("agent_roster", None, "model roster", reads=("schedule_identity",)),
    _mart("attendance_agent_day", causes="attendance_policy registers", reads=("schedule_shift",), evidence=("agent_status", "lilo")),
    _mart("attendance_gap", causes="attendance_policy registers", reads=("schedule_shift",), evidence=("agent_status", "lilo")),
)
BY_NAME = {m.name: m for m in MARTS}


def around(days: Mapping[date, int], margin: int = 1) -> frozenset[date]:
    """The dates from a margin before each date to a margin behind what it carries over."""
    return frozenset(
        d + timedelta(n) for d, carry in days.items() for n in range(-margin, carry + margin + 1)
    )


def scopes(
    changed: set[str], sources: Mapping[str, Mapping[date, int]], unfinished: frozenset[date] = frozenset()
) -> dict[str, Scope]:
    """Mart -> ALL or the dates to rebuild.

    changed: names of inputs that differ from the base. sources: per type, the dates of changed source versions, old and
    new, with the days that rows of the date carry over. unfinished: dates whose attendance the base judged before they
    were over.
    """
    out: dict[str, Scope] = {}
    carried: dict[str, frozenset[date]] = {}
    for mart in MARTS:
        below = [out[m] for m in (*mart.reads, *mart.evidence)]
        if mart.causes & changed or ALL in below:
            out[mart.name] = ALL
            continue
        own = {d: n for t in mart.sources for d, n in sources.get(t, {}).items()}
        dates = frozenset(own).union(*(out[m] for m in mart.reads), *(carried[m] for m in mart.evidence))
        out[mart.name] = dates | unfinished if mart.evidence else dates
        carried[mart.name] = around(own)
    return out
