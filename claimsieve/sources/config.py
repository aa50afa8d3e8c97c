"""Thresholds of the rules, of risk fusion, of cases and of the work queue, as frozen values with checks."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class RuleConfig:
    """Defaults of all rule families (fixed values: detection thresholds)."""

    version: str = "1.0.0"
    # claims that an alert lists; operators.rules has functions that give all of them as rows
    listed_claims: int = 100_000
    listed_links: int = 1000
    listed_samples: int = 50
    # duplicates
    void_statuses: tuple[str, ...] = ("voided", "void", "reversed")
    corrected_statuses: tuple[str, ...] = ("corrected", "adjusted", "replacement")
    legitimate_modifiers: tuple[str, ...] = ("LT", "RT", "50", "76", "77")
    near_duplicate_days: int = 1
    # upcoding
    min_em_claims: int = 50
    mad_z: float = 3.0
    share_multiplier: float = 2.0
    low_complexity: int = 1
    recoverable_share: float = 0.35
    # unbundling
    override_modifiers: tuple[str, ...] = ("59", "25", "XE")
    unbundling_percentile: float = 0.95
    # phantom services
    ambulance_prefix: str = "A0"
    ambulance_days: int = 1
    ghost_months: int = 12
    ghost_claims: int = 5
    # utilisation: group -> (procedure prefixes, visits in 30 days)
    caps: Mapping[str, tuple[tuple[str, ...], int]] = field(default_factory=lambda: {"physical_therapy": (("9714",), 12), "psychotherapy": (("9083",), 8), "chiropractic": (("9894",), 12)})
    peer_multiplier: float = 3.0
    # timing
    day_minutes: float = 960
    travel_mph: float = 60
    telehealth_pos: tuple[str, ...] = ("02", "10")
    # referrals
    concentration: float = 0.70
    min_referrals: int = 20
    reciprocal: int = 15
    lab_specialties: tuple[str, ...] = ("laboratory", "clinical_lab", "pathology")
    referral_z: float = 3.0
    referral_weeks: int = 12
    # geography
    routine_miles: float = 75
    other_miles: float = 150
    routine_specialties: tuple[str, ...] = ("primary_care", "family_medicine", "internal_medicine", "pediatrics", "general_practice", "physical_therapy", "chiropractic")
    distance_min_rows: int = 20
    counties: int = 5
    facility_types: tuple[str, ...] = ("residential", "virtual_office", "po_box")
    # identity
    fuzzy_owner: float = 88
    office_building: int = 5
    # bursts
    burst_floor: float = 5000
    burst_ratio: float = 3.0
    burst_weeks: int = 12
    burst_history: int = 4


@dataclass(frozen=True)
class RiskConfig:
    """Weights of the signal families must sum to one (within 1e-5)."""

    weights: Mapping[str, float] = field(default_factory=lambda: {"rules": 0.25, "ml": 0.25, "anomaly": 0.15, "network": 0.20, "temporal": 0.05, "future": 0.10, "historical": 0.0})
    future: tuple[float, float, float] = (0.5, 0.3, 0.2)
    alert_cap: int = 10
    dollar_cap: float = 50000.0
    rule_cap: int = 5
    severity: Mapping[str, float] = field(default_factory=lambda: {"LOW": 0.25, "MEDIUM": 0.5, "HIGH": 0.75, "CRITICAL": 1.0})
    active: float = 0.20
    evidence: Mapping[str, float] = field(default_factory=lambda: {"depth": 0.30, "ml": 0.25, "network": 0.25, "corroboration": 0.20})
    confidence: tuple[float, float, float] = (0.60, 0.25, 0.15)
    claim_cap: int = 50
    size_cap: int = 15
    burst_cap: float = 3.0

    def __post_init__(self) -> None:
        _sums_to_one("risk weights", self.weights.values(), 1e-5)
        _sums_to_one("future weights", self.future, 1e-5)


@dataclass(frozen=True)
class QueueConfig:
    """Weights of the queue signals must sum to one (within 1e-4)."""

    weights: Mapping[str, float] = field(default_factory=lambda: {"risk": 0.35, "evidence": 0.20, "exposure": 0.15, "network": 0.10, "anomaly": 0.05, "future": 0.10, "behaviour": 0.05})
    capacity: int = 20
    statuses: tuple[str, ...] = ("NEW", "IN_REVIEW", "ESCALATED")
    tiers: tuple[float, float, float] = (0.35, 0.60, 0.80)
    reasons: int = 5

    def __post_init__(self) -> None:
        _sums_to_one("queue weights", self.weights.values(), 1e-4)


@dataclass(frozen=True)
class CaseConfig:
    min_risk: float = 0.25
    tiers: tuple[str, ...] = ("MODERATE", "HIGH", "CRITICAL")
    min_evidence: float = 0.50
    need_two_families: bool = False
    all_providers: bool = False


def _sums_to_one(what: str, values, within: float) -> None:
    total = sum(values)
    if abs(total - 1) > within:
        raise ValueError(f"{what} sum to {total}, not to 1")


def with_overrides(config, **values):
    """A copy with some values replaced; unknown names raise, and sums are checked again."""
    return replace(config, **values)
