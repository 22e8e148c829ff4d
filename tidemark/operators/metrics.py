"""The metric cube: every metric x grain x cohort in one pass per fact.

All additive metrics of a fact share one ``GROUPING SETS`` aggregate covering
both time grains and every supported cohort, so the fact is scanned once and the
shuffle carries partial aggregates only.  Quantiles are computed exactly from
``(group, value) -> count`` rows, which pre-aggregate before the shuffle and are
ranked in value ranges (see ``functions.ordered``), so a group holding a large
share of all rows is never gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import period_end, period_start
from tidemark.functions.lineage import written
from tidemark.functions.ordered import ROWS_PER_PIECE, group_quantiles
from tidemark.operators.registry import MetricDef
from tidemark.plans.config import AnalyticsConfig, CohortSpec
from tidemark.sources.contracts import ANALYTICS_SPECS, DIMENSIONS, conform, empty

_BOUNDED = ("ratio", "ratio_of_sums", "mean", "quantile")


def supported_cohorts(metric: MetricDef, cohorts: Iterable[CohortSpec]) -> list[CohortSpec]:
    """Cohorts whose dimensions the metric declares."""
    return [cohort for cohort in cohorts if set(cohort.dimensions) <= set(metric.dimensions)]


class Lattice:
    """Grouping sets of grain x cohort over one fact, with labels for each set."""

    def __init__(self, fact: DataFrame, ts: str, grains: Sequence[str], cohorts: Sequence[CohortSpec]):
        used = {name for cohort in cohorts for name in cohort.dimensions}
        self.grains, self.cohorts = list(grains), list(cohorts)
        self.dims = [name for name in DIMENSIONS if name in used]
        self.periods = [f"_at_{grain}" for grain in self.grains]
        self.keys = [*self.periods, *self.dims]
        self.rows = fact.withColumns(
            {f"_at_{grain}": period_start(ts, grain) for grain in self.grains}
        ).withColumns({name: F.col(name).cast("string") for name in self.dims})

    def _label(self, grain: str, cohort: CohortSpec) -> int:
        """The value ``grouping_id`` takes for one set: a 1 bit per key left out."""
        kept = {f"_at_{grain}", *cohort.dimensions}
        return sum(1 << (len(self.keys) - 1 - i) for i, k in enumerate(self.keys) if k not in kept)

    def aggregate(self, extra_keys: Sequence[str], *aggregates: Column) -> DataFrame:
        """Aggregate over every set; result has ``_set``, ``period_start`` and the dims."""
        keys = [*self.keys, *extra_keys]
        sets = [
            [F.col(k) for k in (f"_at_{grain}", *cohort.dimensions, *extra_keys)]
            for grain in self.grains for cohort in self.cohorts
        ]
        grouped = self.rows.groupingSets(sets, *(F.col(k) for k in keys)).agg(
            F.grouping_id().alias("_gid"), *aggregates
        )
        shift = len(extra_keys)
        return (
            grouped.withColumn("_set", F.shiftright("_gid", shift) if shift else F.col("_gid"))
            .withColumn("period_start", F.coalesce(*self.periods))
            .drop("_gid", *self.periods)
        )

    def label(self) -> Column:
        """Grain, cohort name and number of dimensions of ``_set``, looked up in a constant: the plan does not grow with the number of sets."""
        return F.create_map(*(part for g in self.grains for c in self.cohorts for part in (
            F.lit(self._label(g, c)).cast("bigint"),
            F.struct(F.lit(g).alias("time_grain"), F.lit(c.name).alias("cohort_name"), F.lit(len(c.dimensions)).cast("bigint").alias("dimension_count")),
        )))[F.col("_set")]

    def describe(self, df: DataFrame) -> DataFrame:
        """Turn ``_set`` into grain, cohort, period end and the 16 dimension columns."""
        ends = reduce(lambda column, grain: column.when(F.col("_label.time_grain") == grain, period_end("period_start", grain)), self.grains, F)
        return df.withColumn("_label", self.label()).withColumns({
            "time_grain": F.col("_label.time_grain"),
            "cohort_name": F.col("_label.cohort_name"),
            "dimension_count": F.col("_label.dimension_count"),
            "period_end": ends,
            **{name: F.lit(None).cast("string") for name in DIMENSIONS if name not in self.dims},
        }).drop("_label")


def _double(column: Column) -> Column:
    return column.cast("double")


def _partials(metric: MetricDef) -> dict[str, Column]:
    """Aggregates a metric needs, named so that equal ones are shared."""
    value, n, d = metric.value, metric.numerator, metric.denominator
    if metric.calculation == "distinct_count":
        distinct = F.countDistinct(value) + F.max(F.col(value).isNull().cast("int"))
        return {f"_distinct_{value}": distinct}
    if metric.calculation in ("sum", "mean"):
        return {f"_sum_{value}": F.coalesce(F.sum(_double(F.col(value))), F.lit(0.0)), f"_nn_{value}": F.count(value)}
    if metric.calculation == "ratio":
        parts = {f"_true_{n}": F.coalesce(F.sum(F.col(n).cast("bigint")), F.lit(0))}
        if d:
            parts[f"_true_{d}"] = F.coalesce(F.sum(F.col(d).cast("bigint")), F.lit(0))
        return parts
    if metric.calculation == "ratio_of_sums":
        return {f"_sum_{c}": F.coalesce(F.sum(_double(F.col(c))), F.lit(0.0)) for c in (n, d)}
    return {}


def _measures(metric: MetricDef) -> tuple[Column, Column, Column, Column]:
    """Value, numerator, denominator and sample size over the partials."""
    none = F.lit(None).cast("double")
    rows = F.col("_rows")
    if metric.calculation == "count":
        return _double(rows), _double(rows), none, rows
    if metric.calculation == "distinct_count":
        count = _double(F.col(f"_distinct_{metric.value}"))
        return count, count, none, rows
    if metric.calculation == "sum":
        total = F.col(f"_sum_{metric.value}")
        return total, total, none, F.col(f"_nn_{metric.value}")
    if metric.calculation == "mean":
        total, count = F.col(f"_sum_{metric.value}"), F.col(f"_nn_{metric.value}")
        return F.when(count > 0, total / count), total, _double(count), count
    if metric.calculation == "ratio":
        top = _double(F.col(f"_true_{metric.numerator}"))
        bottom = F.col(f"_true_{metric.denominator}") if metric.denominator else rows
        return F.when(bottom > 0, top / bottom), top, _double(bottom), bottom
    top, bottom = F.col(f"_sum_{metric.numerator}"), F.col(f"_sum_{metric.denominator}")
    return F.when(bottom > 0, top / bottom), top, bottom, rows


def _record(place: int, measures: tuple[Column, Column, Column, Column]) -> Column:
    value, numerator, denominator, sample = measures
    return F.struct(
        F.lit(place).alias("_place"), value.alias("value"), numerator.alias("numerator"), denominator.alias("denominator"),
        sample.cast("bigint").alias("sample_size"),
    )


def _definition(metric: MetricDef) -> Column:
    return F.struct(
        F.lit(metric.name).alias("metric_name"), F.lit(metric.display_name).alias("display_name"),
        F.lit(metric.domain).alias("domain"), F.lit(metric.metric_type).alias("metric_type"),
        F.lit(metric.unit).alias("unit"),
        F.lit(metric.higher_is_better).cast("boolean").alias("higher_is_better"),
        F.lit(metric.calculation in _BOUNDED).alias("_bounded"),
    )


def quality_status(sample: Column, bounded: Column, minimum_denominator: int) -> Column:
    """``undefined`` / ``insufficient_data`` / ``ok`` for ratios, means and quantiles."""
    return (
        F.when(bounded & (sample <= 0), "undefined")
        .when(bounded & (sample < minimum_denominator), "insufficient_data")
        .otherwise("ok")
    )


def _long(lattice: Lattice, aggregated: DataFrame, records: list[tuple[MetricDef, tuple]], minimum: int) -> DataFrame:
    """One row for each group and metric; the metrics of a lattice support all its cohorts."""
    measured = F.array(*(_record(place, measures) for place, (_, measures) in enumerate(records)))
    definitions = F.array(*(_definition(metric) for metric, _ in records))
    long = lattice.describe(aggregated).withColumn("_m", F.explode(measured)).withColumn("_d", definitions[F.col("_m._place")])
    long = long.select("time_grain", "period_start", "period_end", "cohort_name", "dimension_count", *DIMENSIONS, "_d.*", "_m.*")
    long = long.withColumn("quality_status", quality_status(F.col("sample_size"), F.col("_bounded"), minimum))
    return conform(long, ANALYTICS_SPECS["metric_observations"])


def _lattices(facts: Mapping[str, DataFrame], metrics: Sequence[MetricDef], config: AnalyticsConfig) -> list[tuple[Lattice, list[MetricDef]]]:
    """The metrics by the fact, time and dimensions that they share, with the sets of each."""
    families: dict[tuple, list[MetricDef]] = {}
    for metric in metrics:
        families.setdefault((metric.fact, metric.timestamp_column, metric.dimensions), []).append(metric)
    shown = [(fact, ts, supported_cohorts(members[0], config.cohorts), members) for (fact, ts, _), members in families.items() if fact in facts]
    return [(Lattice(facts[fact], ts, config.time_grains, cohorts), members) for fact, ts, cohorts, members in shown if cohorts]


def observation_counts(facts: Mapping[str, DataFrame], metrics: Sequence[MetricDef], config: AnalyticsConfig) -> DataFrame:
    """How many observations each metric, grain and cohort has.

    A metric has one observation for each group of its fact, whatever its calculation, so
    that the groups are counted and no measure is computed.
    """
    parts = []
    for lattice, members in _lattices(facts, metrics, config):
        groups = lattice.aggregate([], F.count(F.lit(1)).alias("_rows")).groupBy("_set").agg(F.count(F.lit(1)).alias("observations"))
        parts.append(groups.withColumn("_label", lattice.label()).select(
            F.explode(F.array(*(F.lit(m.name) for m in members))).alias("metric_name"), "_label.time_grain", "_label.cohort_name", "observations"))
    return reduce(DataFrame.unionByName, parts)


def metric_observations(
    facts: Mapping[str, DataFrame],
    metrics: Sequence[MetricDef],
    config: AnalyticsConfig,
    *,
    quantile_method: str = "ranked",
    rows_per_piece: int = ROWS_PER_PIECE,
) -> DataFrame:
    """Long-form observations for all metrics, grains and supported cohorts.

    ``quantile_method``: ``ranked`` (exact, skew safe), ``hash`` (exact, Spark's
    ``percentile``: keeps each group's distinct values in one task's memory) or
    ``approx`` (``percentile_approx``).
    """
    parts: list[DataFrame] = []
    for lattice, members in _lattices(facts, metrics, config):
        quantiles = [m for m in members if m.calculation == "quantile"]
        plain = [m for m in members if m.calculation != "quantile"]
        inline = [] if quantile_method == "ranked" else quantiles
        if plain or inline:
            partials: dict[str, Column] = {}
            for metric in plain:
                partials.update(_partials(metric))
            for metric in inline:
                value = _double(F.col(metric.value))
                compute = F.percentile if quantile_method == "hash" else F.percentile_approx
                partials[f"_q_{metric.name}"] = _double(compute(value, F.lit(metric.quantile)))
                partials[f"_nn_{metric.value}"] = F.count(metric.value)
            aggregated = lattice.aggregate(
                [], F.count(F.lit(1)).alias("_rows"), *(c.alias(n) for n, c in partials.items())
            )
            records = [(m, _measures(m)) for m in plain]
            none = F.lit(None).cast("double")
            records += [(m, (F.col(f"_q_{m.name}"), none, none, F.col(f"_nn_{m.value}"))) for m in inline]
            parts.append(_long(lattice, aggregated, records, config.minimum_denominator))
        if quantile_method == "ranked":
            for column in dict.fromkeys(m.value for m in quantiles):
                same = [m for m in quantiles if m.value == column]
                parts.append(_ranked(lattice, column, same, config.minimum_denominator, rows_per_piece))
    if not parts:
        spark = next(iter(facts.values())).sparkSession if facts else SparkSession.getActiveSession()
        return empty(spark, ANALYTICS_SPECS["metric_observations"])
    return reduce(DataFrame.unionByName, parts)


def _ranked(lattice: Lattice, column: str, metrics: list[MetricDef], minimum: int, rows_per_piece: int) -> DataFrame:
    # Read by the row count, the cut points, the ranges, their offsets and the hollow groups.
    counted = written(lattice.aggregate([column], F.count(F.lit(1)).alias("_count")), "counted")
    keys = ["_set", "period_start", *lattice.dims]
    found = group_quantiles(
        counted, keys, column, "_count", {m.name: m.quantile for m in metrics}, rows_per_piece=rows_per_piece
    )
    # Groups whose values are all null still get a row (undefined, sample size 0).
    hollow = (
        counted.groupBy(*keys).agg(F.count(column).alias("_present")).where("_present = 0")
        .select(*keys, F.lit(0).cast("bigint").alias("n"), *(F.lit(None).cast("double").alias(m.name) for m in metrics))
    )
    none = F.lit(None).cast("double")
    records = [(m, (F.col(m.name), none, none, F.col("n"))) for m in metrics]
    return _long(lattice, found.unionByName(hollow), records, minimum)
