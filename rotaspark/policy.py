"""Small reviewed policies: thresholds and the status label table.

Policies are driver-side values. They reach the executors as literals or as
local relations whose size Spark knows exactly.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from rotaspark.functions.keys import fingerprint
from rotaspark.functions.rules import CATEGORIES

# Exact status labels and their attendance category.
STATUS_RULES = {
    "Brief": "Auxiliary",
    "Conférence": "Auxiliary",
    "Réunion": "Auxiliary",
    "Meeting": "Auxiliary",
    "Ops Support": "Auxiliary",
    "Support": "Auxiliary",
    "Training": "Auxiliary",
    "Formation": "Auxiliary",
    "Back Office (BO)": "Productive",
    "Backoffice": "Productive",
    "Back-Office": "Productive",
    "Other Tasks": "Productive",
    "Break": "Break",
    "Personal": "Break",
    "Available": "Productive",
    "Disponible": "Productive",
    "RONA": "Auxiliary",
    "IT downtime": "Auxiliary",
    "Prépa Appel entrant": "Productive",
    "Entrant": "Productive",
    "Post-appel": "Productive",
    "Prépa Appel sortant": "Productive",
    "Sortants en attente": "Productive",
    "Sortant": "Productive",
    "Appel entrant de rappel": "Productive",
    "Entrant en attente": "Productive",
    "Statut non disponible": "Auxiliary",
    "Consultation": "Auxiliary",
    "Meal": "Lunch",
    "Indisponible": "Auxiliary",
    "Lunch": "Lunch",
    "Consultation en attente": "Auxiliary",
}


class PolicyError(ValueError):
    """A policy value is missing or out of range."""


@dataclass(frozen=True)
class AttendancePolicy:
    """SRC-11: attendance thresholds."""

    late_tolerance_minutes: int = 5
    status_gap_tolerance_minutes: int = 5
    minimum_status_coverage: float = 0.80

    def __post_init__(self) -> None:
        for name in ("late_tolerance_minutes", "status_gap_tolerance_minutes"):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int) or value < 0:
                raise PolicyError(f"{name} must be a whole number of at least 0")
        cover = self.minimum_status_coverage
        if isinstance(cover, bool) or not isinstance(cover, (int, float)) or not 0 < cover <= 1:
            raise PolicyError("minimum_status_coverage must be in (0, 1]")

    @property
    def fingerprint(self) -> str:
        return fingerprint("attendance-policy-1", repr(self))


@dataclass(frozen=True)
class ServiceRules:
    """SRC-11: answer target and short-abandon limit, in seconds."""

    target_seconds: int = 30
    short_abandon_seconds: int = 5

    def __post_init__(self) -> None:
        if not (self.target_seconds > 0 and 0 <= self.short_abandon_seconds < self.target_seconds):
            raise PolicyError("service rules need 0 <= short abandon < target")

    def fingerprint(self, mapping_sha256: str) -> str:
        return fingerprint("call-policy-1", repr(self), mapping_sha256)


@dataclass(frozen=True)
class StatusPolicy:
    """SRC-11: exact status labels; anything else goes to the fallback classifier."""

    rules: dict[str, str] = field(default_factory=lambda: dict(STATUS_RULES))

    def __post_init__(self) -> None:
        if not self.rules:
            raise PolicyError("the status policy has no rules")
        seen: set[str] = set()
        for label, category in self.rules.items():
            key = self.label_key(label)
            if not key or key in seen:
                raise PolicyError(f"status label is blank or repeated: {label!r}")
            if category not in CATEGORIES:
                raise PolicyError(f"unknown attendance category: {category!r}")
            seen.add(key)

    @staticmethod
    def label_key(label: str) -> str:
        return " ".join(label.casefold().split())

    @property
    def fingerprint(self) -> str:
        return fingerprint("status-policy-1", repr(sorted(self.rules.items())))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(self.label_key(label), category) for label, category in self.rules.items()]
        return spark.createDataFrame(rows, "label_key string, rule_category string")
