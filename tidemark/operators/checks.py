"""Declarative checks: named conditions evaluated in one aggregate per table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.columns import count_if
from tidemark.operators import facts as fx
from tidemark.operators.contribution import reconstruction
from tidemark.operators.funnel import CHECKOUT_STAGES
from tidemark.operators.metrics import supported_cohorts
from tidemark.operators.registry import MetricDef
from tidemark.plans.config import AnalyticsConfig
from tidemark.sources.contracts import ANALYTICS_SPECS, DIMENSIONS, conform

TOLERANCE = 1e-9
ADDITIVE = ("count", "sum", "ratio", "ratio_of_sums", "mean")


@dataclass(frozen=True)
class Check:
    """A measure over a table that must not exceed ``limit``."""

    name: str
    category: str
    measure: Column
    expected: str
    details: str = ""
    severity: str = "error"
    limit: float = 0.0
    otherwise: str = "fail"


def _result(name, category, severity, status, observed, expected, details, *, metric=None, grain=None, cohort=None) -> Column:
    text = lambda v: v if isinstance(v, Column) else F.lit(v).cast("string")
    return F.struct(
        text(name).alias("check_name"), text(category).alias("category"), text(severity).alias("severity"),
        text(status).alias("status"), text(metric).alias("metric_name"), text(grain).alias("time_grain"),
        F.lit(None).cast("timestamp_ntz").alias("period_start"), text(cohort).alias("cohort_name"),
        observed.cast("double").alias("observed_value"), text(expected).alias("expected"), text(details).alias("details"),
    )


def run_checks(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """Evaluate all checks over one table in a single aggregate, one row per check."""
    measured = df.agg(*(F.coalesce(c.measure.cast("double"), F.lit(0.0)).alias(f"_m{i}") for i, c in enumerate(checks)))
    rows = []
    for i, check in enumerate(checks):
        value = F.col(f"_m{i}")
        status = F.when(value <= check.limit, "pass").otherwise(check.otherwise)
        rows.append(_result(check.name, check.category, check.severity, status, value, check.expected, check.details))
    return measured.select(F.inline(F.array(*rows)))


def repeated_members(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row ``repeated``: how many rows share their key with another row."""
    return fx.repeated_keys(df, keys).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("repeated"))


def unique_check(df: DataFrame, keys: Sequence[str], name: str, category: str, details: str) -> DataFrame:
    return run_checks(repeated_members(df, keys), [
        Check(name, category, F.max("repeated"), "0 duplicate rows", details)
    ])


def required_columns(fact: str, metrics: Iterable[MetricDef]) -> set[str]:
    """Columns of a fact that the metric definitions read."""
    return {c for m in metrics if m.fact == fact for c in m.input_columns}


def fact_checks(tables: Mapping[str, DataFrame], facts: Mapping[str, DataFrame], metrics: Sequence[MetricDef]) -> DataFrame:
    """Cardinality, key uniqueness, required columns and dimension coverage per fact."""
    return reduce(DataFrame.unionByName, (build() for build in fact_check_parts(tables, facts, metrics).values()))


def fact_check_parts(tables: Mapping[str, DataFrame], facts: Mapping[str, DataFrame], metrics: Sequence[MetricDef]) -> dict[str, Callable[[], DataFrame]]:
    """The checks of each fact, so that each fact's can be planned and written on its own."""
    return {name: lambda name=name: _checks_of(name, tables, facts, metrics) for name in facts}


def fact_cardinality_check(name: str, tables: Mapping[str, DataFrame], fact: DataFrame) -> DataFrame:
    """The fact has as many rows as its source."""
    return fx.cardinalities(tables, {name: fact}).select(_result(
        F.concat(F.lit("fact."), "fact", F.lit(".cardinality")), "fact_model", "error",
        F.when(F.col("fact_rows") == F.col("source_rows"), "pass").otherwise("fail"), F.col("fact_rows"),
        F.concat(F.lit("exactly "), F.col("source_rows").cast("string"), F.lit(" rows")), F.col("fact"),
    ).alias("r")).select("r.*")


def fact_key_check(name: str, fact: DataFrame) -> DataFrame:
    """No two rows of the fact share its key."""
    return unique_check(fact, [fx.FACT_KEYS[name]], f"fact.{name}.primary_key", "fact_model", fx.FACT_KEYS[name])


def _checks_of(name: str, tables: Mapping[str, DataFrame], facts: Mapping[str, DataFrame], metrics: Sequence[MetricDef]) -> DataFrame:
    df = facts[name]
    needed = required_columns(name, metrics)
    missing = sorted(needed - set(df.columns))
    dims = sorted(set(DIMENSIONS) & needed & set(df.columns))
    nulls = reduce(lambda a, b: a + b, (count_if(F.col(d).isNull()) for d in dims), F.lit(0))
    columns = run_checks(df, [
        Check(f"fact.{name}.metric_columns", "fact_model", F.lit(len(missing)) + F.lit(0) * F.count(F.lit(1)), "no metric column is absent", ", ".join(missing)),
        Check(f"fact.{name}.dimension_coverage", "fact_model", nulls, "every dimension filled in", ", ".join(dims)),
    ])
    return fact_cardinality_check(name, tables, df).unionByName(fact_key_check(name, df)).unionByName(columns)


def definition_table(like: DataFrame, metrics: Sequence[MetricDef]) -> DataFrame:
    """Small table of the definitions (bounded by the registry, not by data)."""
    rows = [(m.name, m.fact, m.calculation, m.minimum, m.maximum) for m in metrics]
    return like.sparkSession.createDataFrame(rows, "metric_name string, fact string, calculation string, low double, high double")


def coverage_check(observations: DataFrame, metrics: Sequence[MetricDef], facts: Mapping[str, DataFrame]) -> DataFrame:
    """Metrics without observations: a failure when their fact has rows, else a warning."""
    filled = reduce(DataFrame.unionByName, (
        df.limit(1).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("fact"), "rows") for name, df in facts.items()
    ))
    seen = observations.select("metric_name").distinct()
    missing = definition_table(observations, metrics).join(seen, "metric_name", "left_anti").join(filled, "fact", "left")
    row = missing.agg(
        F.count(F.lit(1)).alias("missing"), count_if(F.coalesce("rows", F.lit(0)) > 0).alias("with_data"),
        F.concat_ws(", ", F.array_sort(F.collect_list("metric_name"))).alias("names"),
    )
    status = F.when(F.col("with_data") > 0, "fail").when(F.col("missing") > 0, "warn").otherwise("pass")
    severity = F.when(status == "warn", "warning").otherwise("error")
    return row.select(_result("metrics.coverage", "metrics", severity, status, F.col("missing"),
                              f"rows for each of {len(metrics)} metrics whose fact has rows", F.col("names")).alias("r")).select("r.*")


METRIC_KEY = ("metric_name", "time_grain", "period_start", "cohort_name", *DIMENSIONS)


def per_metric_violations(observations: DataFrame, metrics: Sequence[MetricDef]) -> DataFrame:
    """Range and arithmetic violations of every metric in one grouped pass."""
    value, top, bottom = F.col("value"), F.col("numerator"), F.col("denominator")
    rows = observations.join(definition_table(observations, metrics), "metric_name")
    outside = (value < F.col("low") - TOLERANCE) | (value > F.col("high") + TOLERANCE)
    ratio_bad = top.isNull() | bottom.isNull() | (bottom <= 0) | (F.abs(value - F.try_divide(top, bottom)) > TOLERANCE)
    total_bad = top.isNull() | (F.abs(value - top) > TOLERANCE)
    broken = (
        F.when(F.col("calculation").isin("ratio", "ratio_of_sums", "mean"), ratio_bad)
        .when(F.col("calculation").isin("count", "sum", "distinct_count"), total_bad)
    )
    return rows.groupBy("metric_name").agg(
        count_if(outside).alias("outside_range"),
        count_if(value.isNotNull() & broken).alias("broken_arithmetic"),
    )


def metric_checks(observations: DataFrame, metrics: Sequence[MetricDef], facts: Mapping[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, (build() for build in metric_check_parts(observations, metrics, facts).values()))


def metric_check_parts(observations: DataFrame, metrics: Sequence[MetricDef], facts: Mapping[str, DataFrame]) -> dict[str, Callable[[], DataFrame]]:
    """The metric checks by what they read of the cube, so that each can be planned and written on its own."""
    value = F.col("value")

    def whole() -> DataFrame:
        return run_checks(observations, [
            Check("metrics.finite_values", "metrics", count_if(F.isnan(value) | (F.abs(value) == float("inf"))), "only finite metric values"),
            Check("metrics.invalid_status", "metrics", count_if(F.col("quality_status") == "invalid"), "no row with status invalid"),
        ])

    def each() -> DataFrame:
        status = lambda c: F.when(F.col(c) == 0, "pass").otherwise("fail")
        named = lambda suffix: F.concat(F.lit("metrics."), "metric_name", F.lit(suffix))
        rows = F.array(
            _result(named(".expected_range"), "metrics", "error", status("outside_range"), F.col("outside_range"), "values inside the documented bounds", "", metric=F.col("metric_name")),
            _result(named(".arithmetic"), "metrics", "error", status("broken_arithmetic"), F.col("broken_arithmetic"), "value reconciles to numerator and denominator", "", metric=F.col("metric_name")),
        )
        return per_metric_violations(observations, metrics).select(F.inline(rows))

    return {
        "coverage": lambda: coverage_check(observations, metrics, facts),
        "key": lambda: unique_check(observations, METRIC_KEY, "metrics.primary_key", "metrics", "the metric row key"),
        "whole": whole, "each": each,
    }


def cohort_gaps(observations: DataFrame, metrics: Sequence[MetricDef], config: AnalyticsConfig) -> DataFrame:
    """Largest gap between cohort totals and overall, per metric, grain and cohort."""
    additive = [m for m in metrics if m.calculation in ADDITIVE]
    wanted = [(m.name, c.name) for m in additive for c in supported_cohorts(m, config.cohorts) if c.dimensions]
    pairs = observations.sparkSession.createDataFrame(wanted, "metric_name string, cohort_name string")
    key = ["metric_name", "time_grain", "cohort_name", "period_start"]
    overall = observations.where("cohort_name = 'overall'").select(
        "metric_name", "time_grain", "period_start", F.col("numerator").alias("all_n"), F.col("denominator").alias("all_d")
    ).join(pairs, "metric_name")
    parts = observations.join(pairs, ["metric_name", "cohort_name"]).groupBy(*key).agg(
        F.sum("numerator").alias("part_n"), F.sum("denominator").alias("part_d")
    )
    zero = F.lit(0.0)
    gap = lambda a, b: F.abs(F.coalesce(a, zero) - F.coalesce(b, zero))
    return fx.full_outer(overall, parts, key).groupBy("metric_name", "time_grain", "cohort_name").agg(
        F.max(F.greatest(gap("all_n", "part_n"), gap("all_d", "part_d"))).alias("gap"),
        F.max(F.coalesce(F.abs("all_n"), zero)).alias("scale"),
    )


def cohort_checks(observations: DataFrame, metrics: Sequence[MetricDef], config: AnalyticsConfig) -> DataFrame:
    """Cohort sums must rebuild overall; the tolerance grows with the size of the sums."""
    gaps = cohort_gaps(observations, metrics, config)
    ok = F.col("gap") <= F.greatest(F.lit(TOLERANCE), F.col("scale") * 1e-12)
    name = F.concat_ws(".", F.lit("cohort"), "metric_name", "time_grain", "cohort_name", F.lit("reconciliation"))
    return gaps.select(_result(
        name, "cohort_reconciliation", "error", F.when(ok, "pass").otherwise("fail"), F.col("gap"),
        "cohort totals reconstruct overall totals", "", metric=F.col("metric_name"), grain=F.col("time_grain"), cohort=F.col("cohort_name"),
    ).alias("r")).select("r.*")


FUNNEL_GROUP = ("time_grain", "period_start", "cohort_name", *DIMENSIONS)


def broken_layouts(funnel: DataFrame, stages: Sequence[str]) -> DataFrame:
    """Groups that do not hold exactly the expected stages in order."""
    placed = [count_if((F.col("stage_order") == i + 1) & (F.col("stage_name") == s)).alias(f"_s{i}") for i, s in enumerate(stages)]
    groups = funnel.groupBy(*FUNNEL_GROUP).agg(F.count(F.lit(1)).alias("_rows"), *placed)
    exact = F.col("_rows") == len(stages)
    for i in range(len(stages)):
        exact = exact & (F.col(f"_s{i}") == 1)
    return groups.where(~exact).select(*FUNNEL_GROUP)


def inconsistent_stages(funnel: DataFrame) -> DataFrame:
    """Funnel rows breaking monotonicity or their own arithmetic."""
    group = W.partitionBy(*FUNNEL_GROUP).orderBy("stage_order")
    rows = funnel.withColumn("_before", F.lag("stage_count").over(group)).withColumn(
        "_start", F.max(F.when(F.col("stage_order") == 1, F.col("stage_count"))).over(W.partitionBy(*FUNNEL_GROUP))
    )
    now, previous, start = F.col("stage_count"), F.col("previous_stage_count"), F.col("_start")
    far = lambda column, expected: F.col(column).isNull() | (F.abs(F.col(column) - expected) > TOLERANCE)
    expected_previous = F.when(F.col("stage_order") == 1, now).otherwise(F.col("_before"))
    rules = [
        now < 0, previous < 0, now > previous, previous != expected_previous, F.col("drop_off_count") < 0,
        F.col("drop_off_count") != previous - now,
        (previous > 0) & (far("conversion_from_previous", F.try_divide(now, previous)) | far("drop_off_rate", F.try_divide(F.col("drop_off_count"), previous))),
        (previous == 0) & (F.col("conversion_from_previous").isNotNull() | F.col("drop_off_rate").isNotNull()),
        (start > 0) & far("conversion_from_start", F.try_divide(now, start)),
        (start == 0) & F.col("conversion_from_start").isNotNull(), F.col("quality_status") == "invalid",
    ]
    return rows.where(reduce(lambda a, b: a | b, (F.coalesce(rule, F.lit(False)) for rule in rules)))


def funnel_checks(funnel: DataFrame) -> DataFrame:
    stages = [name for name, _ in CHECKOUT_STAGES]
    rows = F.count(F.lit(1))
    return reduce(DataFrame.unionByName, [
        unique_check(funnel, (*FUNNEL_GROUP, "stage_name"), "funnel.primary_key", "funnel", "canonical funnel key"),
        run_checks(broken_layouts(funnel, stages), [Check("funnel.stage_layout", "funnel", rows, "exactly the canonical stages in order")]),
        run_checks(inconsistent_stages(funnel), [Check("funnel.monotonicity_and_arithmetic", "funnel", rows, "0 inconsistent rows")]),
    ])


def contribution_checks(contributions: DataFrame) -> DataFrame:
    key = ANALYTICS_SPECS["contribution_observations"].primary_key
    measured = reconstruction(contributions).agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(F.max("difference"), F.lit(0.0)).alias("worst"))
    status = F.when(F.col("pairs") == 0, "warn").when(F.col("worst") <= TOLERANCE, "pass").otherwise("fail")
    rebuilt = measured.select(_result(
        "contribution.reconstruction", "contribution", F.when(F.col("pairs") == 0, "warning").otherwise("error"), status, F.col("worst"),
        "rate and mix effects rebuild each change", "").alias("r")).select("r.*")
    return unique_check(contributions, key, "contribution.primary_key", "contribution", "analysis, period pair and cohort value").unionByName(rebuilt)


def source_rollup(issues: DataFrame) -> DataFrame:
    """All source-rule issues as one result row."""
    row = issues.agg(count_if(F.col("severity") == "error").alias("errors"), count_if(F.col("severity") == "warning").alias("warnings"))
    return row.select(_result(
        "source.dataset_validation", "source", "error", F.when(F.col("errors") == 0, "pass").otherwise("fail"), F.col("errors"),
        "source checks without errors",
        F.concat(F.lit("source checks found "), F.col("errors").cast("string"), F.lit(" errors and "), F.col("warnings").cast("string"), F.lit(" warnings")),
    ).alias("r")).select("r.*")


def quality_parts(issues, tables, facts, observations, funnel, contributions, metrics, config: AnalyticsConfig) -> dict[str, Callable[[], DataFrame]]:
    """Every analytical check, by the table it reads; each part can be written on its own."""
    parts = {
        "source": lambda: source_rollup(issues), "facts": lambda: fact_checks(tables, facts, metrics),
        "metrics": lambda: metric_checks(observations, metrics, facts), "cohorts": lambda: cohort_checks(observations, metrics, config),
        "funnel": lambda: funnel_checks(funnel),
    }
    if config.contributions:
        parts["contributions"] = lambda: contribution_checks(contributions)
    return {name: lambda build=build: conform(build(), ANALYTICS_SPECS["data_quality_results"]) for name, build in parts.items()}


def data_quality_results(issues, tables, facts, observations, funnel, contributions, metrics, config: AnalyticsConfig) -> DataFrame:
    """Every analytical check as one table."""
    parts = quality_parts(issues, tables, facts, observations, funnel, contributions, metrics, config)
    return reduce(DataFrame.unionByName, (build() for build in parts.values()))


def quality_summary(results: DataFrame) -> DataFrame:
    """Passed / failed / warnings / total, and the number of blocking errors."""
    return results.agg(
        count_if(F.col("status") == "pass").alias("passed"), count_if(F.col("status") == "fail").alias("failed"),
        count_if(F.col("status") == "warn").alias("warnings"), F.count(F.lit(1)).alias("total"),
        count_if((F.col("severity") == "error") & (F.col("status") == "fail")).alias("errors"),
    )


def failed_details(results: DataFrame) -> DataFrame:
    """JSON of failed checks (one short row per check, bounded by the number of checks)."""
    failed = results.where("severity = 'error' AND status = 'fail'").select(F.struct("check_name", "details").alias("f"))
    return failed.agg(F.to_json(F.array_sort(F.collect_list("f"))).alias("failed"))


class QualityGateError(RuntimeError):
    """A stage produced results that fail an error-severity check."""


def gate(results: DataFrame) -> DataFrame:
    """Evaluate the result table once; raise with the failed checks if any blocks."""
    row = failed_details(results).first()
    if row["failed"] != "[]":
        raise QualityGateError(row["failed"])
    return results
