"""Stages with a hard quality gate: build, check, and only then publish."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

from tidemark.operators import checks, contribution, funnel, metrics, rules
from tidemark.operators.facts import build_facts
from tidemark.operators.registry import REGISTRY, resolve
from tidemark.plans.config import AnalyticsConfig
from tidemark.sources import io


def run_stage(build: Callable[[], dict[str, DataFrame]], quality: str, directory: str | None = None, **write) -> dict[str, DataFrame]:
    """Build a table set and raise on any blocking check before anything is written."""
    tables = build()
    checks.gate(tables[quality])
    if directory is not None:
        io.write_tables(tables, directory, **write)
    return tables


def analytics_stage(source: Mapping[str, DataFrame], config: AnalyticsConfig, directory: str | None = None, *, registry=REGISTRY, **write) -> dict[str, DataFrame]:
    """Facts, metric cube, funnel, contributions and their quality table."""
    def build() -> dict[str, DataFrame]:
        chosen = resolve(list(config.metrics), registry)
        facts = build_facts(source)
        observations = metrics.metric_observations(facts, chosen, config)
        stages = funnel.funnel_observations(facts["checkout"], config)
        parts = contribution.contribution_observations(observations, config)
        issues = rules.issues(rules.validate_source(source))
        results = checks.data_quality_results(issues, source, facts, observations, stages, parts, chosen, config)
        return {"metric_observations": observations, "funnel_observations": stages, "contribution_observations": parts, "data_quality_results": results}

    return run_stage(build, "data_quality_results", directory, **write)
