"""Recovery verification and the incident lifecycle."""

from __future__ import annotations

import sys
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import codes, micros
from tidemark.functions.ordered import cut_points, running
from tidemark.functions.tails import t_upper_tail
from tidemark.operators.detection import _middle
from tidemark.plans.config import RecoveryConfig

cloudpickle.register_pickle_by_value(sys.modules[__name__])
SERIES = ["metric_id", "cohort"]


def policy_table(spark, config: RecoveryConfig) -> DataFrame:
    """Policies as rows (bounded by the configuration)."""
    rows = [(p.metric_id, p.cohort, p.role, p.healthy_direction, p.baseline_lookback_periods, p.minimum_baseline_periods, p.minimum_post_periods, p.sustain_periods, p.minimum_sample_size,
             p.equivalence_margin_relative, p.equivalence_margin_absolute, p.minimum_within_band_fraction, p.minimum_improvement_fraction, p.severe_robust_z) for p in config.metrics]
    return spark.createDataFrame(rows, "metric_id string, cohort string, role string, healthy_direction string, lookback int, need_baseline int, need_post int, sustain int, need_sample int, "
                                 "relative double, absolute double, within double, improve double, severe_z double")


def observation_set(metrics: DataFrame, post: DataFrame, executed_at) -> DataFrame:
    """Pre-execution points at each series' coarsest grain, plus the given post points."""
    rank = F.when(F.col("time_grain") == "day", 2).when(F.col("time_grain") == "hour", 1).otherwise(0)
    rows = metrics.select(F.col("metric_name").alias("metric_id"), F.col("cohort_name").alias("cohort"), "time_grain", rank.alias("_rank"), F.col("period_start").alias("observed_at"), "value", "sample_size")
    coarsest = rows.groupBy(*SERIES).agg(F.max("_rank").alias("_rank"))
    before = rows.join(coarsest, [*SERIES, "_rank"]).where(F.col("observed_at") < F.lit(executed_at).cast("timestamp_ntz"))
    return before.select(*SERIES, "observed_at", "value", "sample_size").unionByName(post.select(*SERIES, "observed_at", "value", "sample_size"))


def observation_issues(observations: DataFrame, config: RecoveryConfig, executed_at, generated_at) -> DataFrame:
    """Repeated points, points after generation, missing sides and undeclared series."""
    at = F.lit(executed_at).cast("timestamp_ntz")
    subject = F.concat_ws("/", *SERIES)
    sides = observations.agg(F.bool_or(F.col("observed_at") < at).alias("pre"), F.bool_or(F.col("observed_at") >= at).alias("post"))
    parts = [
        observations.groupBy(*SERIES, "observed_at").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("observation.repeated").alias("code"), subject.alias("subject")),
        observations.where(F.col("observed_at") > F.lit(generated_at).cast("timestamp_ntz")).select(F.lit("observation.future").alias("code"), subject.alias("subject")),
        sides.where(~F.coalesce("pre", F.lit(False)) | ~F.coalesce("post", F.lit(False))).select(F.lit("observation.one_sided").alias("code"), F.lit("all").alias("subject")),
        observations.select(*SERIES).distinct().join(policy_table(observations.sparkSession, config).select(*SERIES), SERIES, "left_anti").select(F.lit("series.undeclared").alias("code"), subject.alias("subject")),
    ]
    return reduce(DataFrame.unionByName, parts)


def recovery_windows(observations: DataFrame, config: RecoveryConfig, executed_at, evaluated_at) -> DataFrame:
    """Mark each eligible point as baseline, post and sustain by the series policy."""
    rows = observations.join(policy_table(observations.sparkSession, config), SERIES).where(F.col("sample_size") >= F.col("need_sample"))
    at, until = F.lit(executed_at).cast("timestamp_ntz"), F.lit(evaluated_at).cast("timestamp_ntz")
    rows = rows.where(F.col("observed_at") <= F.greatest(at, until)).withColumn("_post", F.col("observed_at") >= at)
    rows = rows.where(~F.col("_post") | (F.col("observed_at") <= until))
    newest = F.row_number().over(W.partitionBy(*SERIES, "_post").orderBy(F.col("observed_at").desc()))
    return rows.withColumn("_newest", newest).withColumns({
        "in_baseline": ~F.col("_post") & (F.col("_newest") <= F.col("lookback")), "in_post": F.col("_post"), "in_sustain": F.col("_post") & (F.col("_newest") <= F.col("sustain")),
    }).drop("_newest", "_post")


def _pairs_within(y: np.ndarray, slope: float) -> int:
    """How many pairs of places have a slope of at most ``slope``: inversions of y - slope * place, ties included."""
    n = len(y)
    tilted = y - slope * np.arange(n)
    # The later of two equal values gets the smaller rank, so that it counts as an inversion.
    rank = np.empty(n, dtype=np.int64)
    rank[np.lexsort((-np.arange(n), tilted))] = np.arange(n)
    total = 0
    for bit in range(int(n - 1).bit_length()):
        # Places with equal higher bits, in their order: each 0 counts the 1s before it.
        order = np.argsort(rank >> (bit + 1), kind="stable")
        group, one = rank[order] >> (bit + 1), (rank[order] >> bit) & 1
        ones = np.cumsum(one)
        first = np.searchsorted(group, group)
        before = ones - np.where(first > 0, ones[first - 1], 0)
        total += int(before[one == 0].sum())
    return total


def median_slope(y: np.ndarray) -> float:
    """Median of the slopes of all pairs, in n log n per halving of the range of slopes and without listing pairs."""
    n = len(y)
    if n < 2:
        return 0.0
    pairs, steps = n * (n - 1) // 2, np.diff(y)

    def ranked(k: int) -> float:
        low, high = float(steps.min()), float(steps.max())  # every slope is a mean of steps
        for _ in range(128):
            middle = low + (high - low) / 2
            if middle in (low, high):
                break
            if _pairs_within(y, middle) >= k:
                high = middle
            else:
                low = middle
        return low if _pairs_within(y, low) >= k else high

    return ranked(pairs // 2 + 1) if pairs % 2 else (ranked(pairs // 2) + ranked(pairs // 2 + 1)) / 2


@F.pandas_udf(T.DoubleType())
def theil_sen(values: pd.Series) -> pd.Series:
    """Median slope over the positions of one series."""
    return values.map(lambda v: median_slope(np.asarray(v, dtype=np.float64))).astype("float64")


def adverse(value: Column, center: Column, direction: Column) -> Column:
    """Distance in the unhealthy direction."""
    zero = F.lit(0.0)
    return F.when(direction == "higher_is_better", F.greatest(zero, center - value)).when(direction == "lower_is_better", F.greatest(zero, value - center)).otherwise(F.abs(value - center))


def welch_tost(rows: DataFrame, left: str, right: str, margin: Column, alpha: float) -> DataFrame:
    """Two one-sided Welch tests between two bounded array columns."""
    def moments(c):
        n = F.size(c)
        mean = F.try_divide(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), n)
        return n, mean

    (n0, m0), (n1, m1) = moments(left), moments(right)
    rows = rows.withColumns({"_n0": n0, "_n1": n1, "_m0": m0, "_m1": m1, "_margin": margin})
    square = lambda c, m, n: F.try_divide(F.aggregate(c, F.lit(0.0), lambda a, x: a + (x - F.col(m)) * (x - F.col(m))), F.col(n) - 1) / F.greatest(F.col(n), F.lit(1))
    rows = rows.withColumns({"_v0": square(left, "_m0", "_n0"), "_v1": square(right, "_m1", "_n1")})
    variance, gap = F.col("_v0") + F.col("_v1"), F.col("_m1") - F.col("_m0")
    rows = rows.withColumns({"mean_difference": gap, "_var": variance})
    df = F.try_divide(F.col("_var") * F.col("_var"), F.try_divide(F.col("_v0") * F.col("_v0"), F.col("_n0") - 1) + F.try_divide(F.col("_v1") * F.col("_v1"), F.col("_n1") - 1))
    se = F.sqrt("_var")
    rows = rows.withColumns({"_df": F.coalesce(df, (F.least("_n0", "_n1") - 1).cast("double")), "tost_lower_t": F.try_divide(F.col("mean_difference") + F.col("_margin"), se), "tost_upper_t": F.try_divide(F.col("mean_difference") - F.col("_margin"), se)})
    p = F.greatest(t_upper_tail("tost_lower_t", "_df"), t_upper_tail(-F.col("tost_upper_t"), "_df"))
    flat = F.col("_var") <= 0
    rows = rows.withColumn("_p", p)
    rows = rows.withColumn("equivalence_pvalue", F.when(flat, F.when(F.abs("mean_difference") <= F.col("_margin"), 0.0).otherwise(1.0)).otherwise(F.least(F.greatest(F.coalesce("_p", F.lit(1.0)), F.lit(0.0)), F.lit(1.0))))
    equal = F.when(flat, F.abs("mean_difference") <= F.col("_margin")).otherwise(F.col("equivalence_pvalue") < alpha)
    return rows.withColumn("equivalent", equal).drop("_n0", "_n1", "_m0", "_m1", "_v0", "_v1", "_var", "_p", "_margin")


def evaluate_metrics(windows: DataFrame, config: RecoveryConfig) -> DataFrame:
    """Status, statistics and ordered reasons for every configured series.

    Arrays hold at most the lookback, the sustain window or the calendar periods
    since execution of one series.
    """
    floor = float(config.scale_floor)
    at = F.struct("observed_at", "value")
    series = windows.groupBy(*SERIES).agg(
        F.collect_list(F.when(F.col("in_baseline"), F.col("value"))).alias("base"), F.collect_list(F.when(F.col("in_sustain"), F.col("value"))).alias("held"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("in_post"), at))), lambda s: s["value"]).alias("post"),
    )
    none = F.array().cast("array<double>")
    rows = policy_table(windows.sparkSession, config).join(series, SERIES, "left").withColumns({c: F.coalesce(c, none) for c in ("base", "held", "post")})
    rows = rows.withColumns({"baseline_count": F.size("base").cast("bigint"), "post_count": F.size("post").cast("bigint"), "sustain_count": F.size("held").cast("bigint")})
    gaps = codes(("insufficient_baseline", F.col("baseline_count") < F.col("need_baseline")), ("insufficient_post_window", F.col("post_count") < F.col("need_post")),
                 ("insufficient_sustain_window", F.col("sustain_count") < F.col("sustain")))
    rows = rows.withColumn("_gaps", gaps).withColumn("_enough", F.size("_gaps") == 0)
    rows = rows.withColumns({"_b": F.array_sort("base"), "_h": F.array_sort("held")}).withColumns({"baseline_center": _middle("_b"), "latest_center": _middle("_h")})
    rows = rows.withColumn("_d", F.array_sort(F.transform("base", lambda x: F.abs(x - F.col("baseline_center")))))
    rows = rows.withColumns({
        "baseline_scale": F.greatest(_middle("_d") * 1.4826, F.lit(floor)),
        "equivalence_margin": F.greatest(F.abs("baseline_center") * F.col("relative"), F.col("absolute"), F.lit(floor)),
    })
    rows = welch_tost(rows, "base", "held", F.col("equivalence_margin"), config.alpha)
    center, margin, direction = F.col("baseline_center"), F.col("equivalence_margin"), F.col("healthy_direction")
    rows = rows.withColumn("_away", F.transform("post", lambda v: adverse(v, center, direction)))
    latest = adverse(F.col("latest_center"), center, direction)
    rows = rows.withColumns({
        "within_band_fraction": F.try_divide(F.size(F.filter("held", lambda v: F.abs(v - center) <= margin)), F.size("held")),
        "latest_robust_z": (F.col("latest_center") - center) / F.col("baseline_scale"), "distance_slope": theil_sen("_away"),
        "improvement_fraction": (F.get("_away", 0) - latest) / F.greatest(F.get("_away", 0), margin, F.lit(floor)), "_severe": latest > F.col("severe_z") * F.col("baseline_scale"),
    })
    rows = rows.withColumn("_worse", F.col("distance_slope") > margin / F.greatest("sustain", F.lit(1)))
    in_band = F.col("within_band_fraction") >= F.col("within")
    good = F.col("equivalent") & in_band & ~F.col("_worse") & ~F.col("_severe")
    moving = (F.col("improvement_fraction") >= F.col("improve")) & ~F.col("_severe")
    rows = rows.withColumn("status", F.when(~F.col("_enough"), "insufficient_data").when(good, "recovered").when(moving, "recovering").otherwise("failed"))
    status = F.col("status")
    listed = codes(
        ("statistically_recovered", status == "recovered"), ("not_statistically_equivalent", (status != "recovered") & ~F.col("equivalent")),
        ("sustain_window_outside_band", (status != "recovered") & ~in_band), ("adverse_distance_trend", (status != "recovered") & F.col("_worse")),
        ("severe_guardrail_breach", F.col("_severe") & (F.col("role") == "guardrail")), ("severe_primary_gap", F.col("_severe") & (F.col("role") != "guardrail")),
        ("meaningful_improvement", status == "recovering"), ("recovery_gate_failed", status == "failed"),
    )
    shown = ("baseline_center", "baseline_scale", "latest_center", "equivalence_margin", "equivalence_pvalue", "within_band_fraction", "latest_robust_z", "distance_slope", "improvement_fraction", "tost_lower_t", "tost_upper_t")
    return rows.select(
        *SERIES, "role", "healthy_direction", "status", "baseline_count", "post_count", "sustain_count", *(F.when(F.col("_enough"), F.col(c)).alias(c) for c in shown),
        (F.col("_enough") & F.col("_severe") & (F.col("role") == "guardrail")).alias("severe_breach"), F.when(F.col("_enough"), listed).otherwise(F.col("_gaps")).alias("reason_codes"),
    )


def recovery_decision(evaluations: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Failed beats insufficient beats recovered beats recovering."""
    status = F.col("status")
    rows = evaluations.groupBy(*keys).agg(
        F.coalesce(F.bool_or(F.col("severe_breach")), F.lit(False)).alias("severe_guardrail_breach"), F.bool_or(status == "failed").alias("_failed"),
        F.bool_or(status == "insufficient_data").alias("_gap"), F.bool_and(status == "recovered").alias("_all"),
    )
    choice = F.when(F.col("severe_guardrail_breach") | F.col("_failed"), "failed").when(F.col("_gap"), "insufficient_data").when(F.col("_all"), "recovered").otherwise("recovering")
    return rows.withColumn("decision", choice).drop("_failed", "_gap", "_all")


def lifecycle(reports: DataFrame, config: RecoveryConfig, *, key: str = "incident_id", at: str = "evaluated_at") -> DataFrame:
    """Status, failure counter and trigger after each report of each incident.

    The transition rules unroll to running counts (failures since the last verified
    recovery, first reopening).  They are taken in time ranges if an incident has more
    reports than a range, so that one with a large share of all reports is still split.
    """
    one = lambda c: c.cast("bigint")
    decided = F.col("decision")
    rows = reports.withColumns({"_t": micros(at), "_ok": one(decided == "recovered"), "_bad": one(~decided.isin("recovered", "insufficient_data"))}).withColumn("_one", F.lit(1).cast("bigint"))
    cuts = cut_points(rows, "_t", keys=[key])
    rows = running(rows, [key], "_t", {"generation": ("sum", "_one"), "_oks": ("sum", "_ok"), "_bads": ("sum", "_bad")}, cuts=cuts)
    rows = rows.withColumns({
        "_bads_at_ok": F.when(F.col("_ok") == 1, F.col("_bads")).otherwise(F.lit(0)),
        "_last": F.when(decided == "insufficient_data", F.lit(0)).otherwise(F.col("generation") * 2 + F.col("_ok")),
    })
    rows = running(rows, [key], "_t", {"_base": ("max", "_bads_at_ok"), "_latest": ("max", "_last")}, cuts=cuts)
    ever = (F.col("_oks") - F.col("_ok")) > 0
    failures = F.when(F.col("_oks") > 0, F.col("_bads") - F.col("_base")).otherwise(F.lit(0))
    severe = F.col("severe_guardrail_breach") & F.lit(config.immediate_reopen_on_severe_guardrail)
    worn = ever & (failures >= config.reopen_after_consecutive_failures)
    rows = rows.withColumns({"_failures": failures, "_severe": severe, "_opens": (F.col("_bad") == 1) & (severe | worn)})
    rows = rows.withColumns({"_open_at": F.when(F.col("_opens"), F.col("generation"))})
    rows = running(rows, [key], "_t", {"_opened": ("min", "_open_at")}, cuts=cuts)
    rows = rows.withColumn("_frozen_here", F.when(F.col("generation") == F.col("_opened"), F.col("_failures")))
    rows = running(rows, [key], "_t", {"_frozen": ("max", "_frozen_here")}, cuts=cuts)
    reopened, after = F.col("_opened").isNotNull(), F.col("generation") > F.col("_opened")
    held = (F.col("_latest") % 2) == 1
    status = F.when(reopened, "reopened").when(decided == "recovered", "recovered").when((decided == "insufficient_data") & held, "recovered").otherwise("monitoring")
    trigger = (
        F.when(F.coalesce(after, F.lit(False)), "incident_already_reopened").when(decided == "recovered", "recovery_verified").when(decided == "insufficient_data", "recovery_evidence_gap")
        .when(F.col("_opens") & F.col("_severe"), "severe_guardrail_regression").when(F.col("_opens"), "sustained_recovery_regression")
        .when(ever, "regression_observed").otherwise("recovery_not_yet_verified")
    )
    # A later report of a reopened incident keeps the counter of the reopening.
    return rows.withColumns({"status": status, "trigger": trigger, "consecutive_failed_evaluations": F.when(reopened, F.col("_frozen")).otherwise(F.col("_failures"))}).select(
        *reports.columns, "generation", "status", "consecutive_failed_evaluations", "trigger")


def replay_mismatches(stored: DataFrame, reports: DataFrame, config: RecoveryConfig, *, key: str = "incident_id", at: str = "evaluated_at") -> DataFrame:
    """Stored transitions that differ from replaying the reports."""
    again = lifecycle(reports, config, key=key, at=at).select(key, at, *(F.col(c).alias(f"_{c}") for c in ("generation", "status", "consecutive_failed_evaluations", "trigger")))
    joined = stored.join(again, [key, at], "full")
    differs = [F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in ("generation", "status", "consecutive_failed_evaluations", "trigger")]
    return joined.select(key, at, F.array_compact(F.array(*differs)).alias("columns")).where("size(columns) > 0")
