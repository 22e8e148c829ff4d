"""Frozen, strict configuration objects (unknown keys are rejected)."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, is_dataclass, replace
from datetime import datetime, timedelta
from pathlib import Path
from typing import Any, get_args, get_origin, get_type_hints

from tidemark.sources.contracts import DIMENSIONS


def _need(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


@dataclass(frozen=True)
class CohortSpec:
    name: str
    dimensions: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        _need(len(self.dimensions) <= 2, "a cohort has at most two dimensions")
        _need(set(self.dimensions) <= set(DIMENSIONS), f"unknown dimension in cohort {self.name}")


@dataclass(frozen=True)
class ContributionSpec:
    name: str
    metric: str
    dimension: str
    time_grain: str = "day"


# The standard cohorts and contribution analyses.
STANDARD_COHORTS = (
    CohortSpec("overall"),
    CohortSpec("region", ("region",)),
    CohortSpec("device", ("device",)),
    CohortSpec("channel", ("channel",)),
    CohortSpec("customer-type", ("customer_type",)),
    CohortSpec("app-version", ("app_version",)),
    CohortSpec("issuer", ("issuer",)),
    CohortSpec("payment-method", ("payment_method",)),
    CohortSpec("processor", ("processor",)),
    CohortSpec("customer-segment", ("customer_segment",)),
    CohortSpec("loyalty-tier", ("loyalty_tier",)),
    CohortSpec("product-category", ("product_category",)),
    CohortSpec("seller", ("seller_id",)),
    CohortSpec("warehouse", ("warehouse_id",)),
    CohortSpec("pipeline-name", ("pipeline_name",)),
    CohortSpec("service", ("service",)),
    CohortSpec("deployment-scope", ("deployment_scope",)),
    CohortSpec("region-device", ("region", "device")),
)
STANDARD_CONTRIBUTIONS = (
    ContributionSpec("checkout-conversion-by-region", "checkout_conversion_rate", "region"),
    ContributionSpec("payment-approval-by-issuer", "payment_approval_rate", "issuer"),
    ContributionSpec("on-time-delivery-by-region", "on_time_delivery_rate", "region"),
    ContributionSpec("inventory-accuracy-by-seller", "inventory_exact_match_rate", "seller_id"),
)
STANDARD_FUNNEL_COHORTS = (
    "overall", "region", "device", "channel", "customer-type", "app-version", "region-device",
)


@dataclass(frozen=True)
class AnalyticsConfig:
    metrics: tuple[str, ...] = ("*",)
    time_grains: tuple[str, ...] = ("hour", "day")
    cohorts: tuple[CohortSpec, ...] = STANDARD_COHORTS
    funnel_cohorts: tuple[str, ...] = STANDARD_FUNNEL_COHORTS
    contributions: tuple[ContributionSpec, ...] = STANDARD_CONTRIBUTIONS
    minimum_denominator: int = 25

    def __post_init__(self) -> None:
        names = [cohort.name for cohort in self.cohorts]
        _need(len(set(names)) == len(names), "two cohorts share a name")
        shapes = [frozenset(cohort.dimensions) for cohort in self.cohorts]
        _need(len(set(shapes)) == len(shapes), "two cohorts share their dimensions")
        _need("overall" in names, "an overall cohort is required")
        _need(set(self.time_grains) <= {"hour", "day"}, "time grains are hour and day")
        _need(set(self.funnel_cohorts) <= set(names), "funnel cohort is not configured")
        single = {c.dimensions[0] for c in self.cohorts if len(c.dimensions) == 1}
        for item in self.contributions:
            _need(item.dimension in single, f"no cohort on {item.dimension} for {item.name}")
        _need(self.minimum_denominator >= 1, "minimum_denominator must be positive")

    def cohort(self, name: str) -> CohortSpec:
        return next(item for item in self.cohorts if item.name == name)


@dataclass(frozen=True)
class BaselinePolicy:
    lookback_periods: int
    minimum_history: int
    seasonal_periods: int
    minimum_seasonal_history: int
    minimum_scale: float = 1e-6
    relative_scale_floor: float = 0.01

    def __post_init__(self) -> None:
        _need(1 <= self.minimum_history <= self.lookback_periods, "history exceeds lookback")
        _need(self.seasonal_periods >= 1, "seasonal_periods must be positive")


@dataclass(frozen=True)
class Selector:
    metric: str
    time_grains: tuple[str, ...]
    cohorts: tuple[str, ...]

    def __post_init__(self) -> None:
        _need(bool(self.time_grains) and bool(self.cohorts), "a selector needs grains and cohorts")


@dataclass(frozen=True)
class CusumPolicy:
    enabled: bool = True
    drift: float = 0.5
    threshold: float = 4.5


@dataclass(frozen=True)
class SequentialPolicy:
    enabled: bool = True
    alpha: float = 0.01
    alternative_standardized_shift: float = 1.5


@dataclass(frozen=True)
class AlertPolicy:
    fdr_alpha: float = 0.05
    robust_z_threshold: float = 3.0
    minimum_detector_support: int = 2
    minimum_relative_effect: float = 0.08
    minimum_absolute_effect: float = 0.0
    minimum_sample_size: int = 10


@dataclass(frozen=True)
class MetricOverride:
    metric: str
    robust_z_threshold: float | None = None
    minimum_detector_support: int | None = None
    minimum_relative_effect: float | None = None
    minimum_absolute_effect: float | None = None
    minimum_sample_size: int | None = None


@dataclass(frozen=True)
class Scenario:
    scenario_id: str
    metric: str
    time_grain: str
    cohort: str
    start_at: datetime
    duration_periods: int
    kind: str
    magnitude: float
    expected_direction: str
    dimension_values: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        _need(self.kind in ("level_shift", "spike", "drift"), "unknown scenario kind")
        _need(self.duration_periods >= 1, "a scenario lasts at least one period")

    @property
    def end_at(self) -> datetime:
        unit = timedelta(hours=1) if self.time_grain == "hour" else timedelta(days=1)
        return self.start_at + self.duration_periods * unit


@dataclass(frozen=True)
class DetectionConfig:
    selectors: tuple[Selector, ...]
    hour: BaselinePolicy = BaselinePolicy(168, 72, 24, 3)
    day: BaselinePolicy = BaselinePolicy(14, 7, 7, 2)
    cusum: CusumPolicy = CusumPolicy()
    sequential: SequentialPolicy = SequentialPolicy()
    alert_policy: AlertPolicy = AlertPolicy()
    metric_overrides: tuple[MetricOverride, ...] = ()
    benchmark_scenarios: tuple[Scenario, ...] = ()

    def __post_init__(self) -> None:
        _need(bool(self.selectors), "at least one selector is required")
        names = [item.metric for item in self.metric_overrides]
        _need(len(set(names)) == len(names), "a metric is overridden twice")
        ids = [item.scenario_id for item in self.benchmark_scenarios]
        _need(len(set(ids)) == len(ids), "scenario ids must be unique")


INCIDENT_FAMILIES = ("checkout_failure", "payment_decline", "late_delivery", "refund_delay")


@dataclass(frozen=True)
class Incident:
    incident_id: str
    family: str
    started_at: datetime
    ended_at: datetime
    region: str | None = None
    device: str | None = None
    minimum_interactions: int = 1

    def __post_init__(self) -> None:
        _need(self.family in INCIDENT_FAMILIES, "unknown incident family")
        _need(self.ended_at > self.started_at, "the incident must end after it starts")
        _need(self.ended_at - self.started_at <= timedelta(days=14), "incident exceeds 14 days")

    def shifted(self, days: int) -> "Incident":
        back = timedelta(days=days)
        return replace(self, started_at=self.started_at - back, ended_at=self.ended_at - back)


@dataclass(frozen=True)
class ImpactConfig:
    impact_id: str
    incident: Incident
    churn_horizon_days: int = 60
    pre_period_days: int = 45
    ltv_horizon_days: int = 180
    minimum_pre_orders: int = 0
    effect_enabled: bool = True
    effect_delay_days: int = 18
    effect_censor_probability: float = 0.18
    effect_seed: int = 2026071704
    propensity_caliper: float = 0.20
    propensity_clip: float = 0.02
    bootstrap_samples: int = 200
    confidence_level: float = 0.95
    placebo_shift_days: int = 21
    random_seed: int = 2026071705
    contribution_margin_rate: float = 0.32
    support_cost_per_exposed_customer: float = 35.0
    recovery_cost_per_exposed_customer: float = 12.0

    def __post_init__(self) -> None:
        _need(7 <= self.churn_horizon_days <= 365, "churn horizon must be 7 to 365 days")
        _need(7 <= self.pre_period_days <= 365, "pre-period must be 7 to 365 days")
        _need(20 <= self.bootstrap_samples <= 5000, "bootstrap samples must be 20 to 5000")
        _need(0.5 < self.confidence_level < 1.0, "confidence level must be in (0.5, 1)")
        _need(0.0 < self.propensity_clip < 0.5, "propensity clip must be in (0, 0.5)")


@dataclass(frozen=True)
class EvidenceWindow:
    incident_id: str
    family: str
    started_at: datetime
    ended_at: datetime
    primary_service: str
    region: str | None = None
    context_before_hours: int = 24
    context_after_hours: int = 24

    @property
    def lower(self) -> datetime:
        return self.started_at - timedelta(hours=self.context_before_hours)

    @property
    def upper(self) -> datetime:
        return self.ended_at + timedelta(hours=self.context_after_hours)


@dataclass(frozen=True)
class RecoveryPolicy:
    metric_id: str
    cohort: str = "overall"
    role: str = "primary"
    healthy_direction: str = "higher_is_better"
    baseline_lookback_periods: int = 24
    minimum_baseline_periods: int = 8
    minimum_post_periods: int = 4
    sustain_periods: int = 3
    minimum_sample_size: int = 20
    equivalence_margin_relative: float = 0.05
    equivalence_margin_absolute: float = 0.0
    minimum_within_band_fraction: float = 0.8
    minimum_improvement_fraction: float = 0.5
    severe_robust_z: float = 4.0

    def __post_init__(self) -> None:
        _need(self.minimum_baseline_periods <= self.baseline_lookback_periods, "baseline minimum exceeds lookback")
        _need(self.sustain_periods <= self.minimum_post_periods, "sustain exceeds post minimum")
        _need(self.role in ("primary", "guardrail"), "role is primary or guardrail")


@dataclass(frozen=True)
class RecoveryConfig:
    recovery_id: str
    incident_id: str
    metrics: tuple[RecoveryPolicy, ...]
    alpha: float = 0.05
    scale_floor: float = 1e-9
    reopen_after_consecutive_failures: int = 2
    immediate_reopen_on_severe_guardrail: bool = True

    def __post_init__(self) -> None:
        keys = [(item.metric_id, item.cohort) for item in self.metrics]
        _need(len(set(keys)) == len(keys), "recovery policies must be unique")
        _need(any(item.role == "primary" for item in self.metrics), "a primary metric is required")


def _build(kind: Any, value: Any) -> Any:
    origin = get_origin(kind)
    if is_dataclass(kind) and isinstance(value, dict):
        hints = get_type_hints(kind)
        known = {item.name for item in fields(kind)}
        unknown = sorted(set(value) - known)
        _need(not unknown, f"unknown keys for {kind.__name__}: {', '.join(unknown)}")
        return kind(**{key: _build(hints[key], item) for key, item in value.items()})
    if origin is tuple and isinstance(value, (list, tuple)):
        inner = get_args(kind)[0]
        return tuple(_build(inner, item) for item in value)
    if kind is datetime and isinstance(value, str):
        return datetime.fromisoformat(value.replace("Z", "+00:00")).replace(tzinfo=None)
    return value


def load_config(kind: type, source: dict | str | Path) -> Any:
    """Build a config from a dict, a JSON file or (when PyYAML is present) a YAML file."""
    if isinstance(source, dict):
        return _build(kind, source)
    text = Path(source).read_text(encoding="utf-8")
    if str(source).endswith((".yaml", ".yml")):
        import yaml

        return _build(kind, yaml.safe_load(text))
    return _build(kind, json.loads(text))
