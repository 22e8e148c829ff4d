"""Survival analysis over (duration, event) rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import count_if
from tidemark.functions.lineage import cut
from tidemark.functions.ordered import ROWS_PER_PIECE, cut_points, running
from tidemark.functions.tails import normal_two_sided


def kaplan_meier(df: DataFrame, duration: str, event: str, group: str, confidence: float = 0.95) -> DataFrame:
    """Survival curve with Greenwood interval per group.

    Rows are first reduced to distinct times; risk sets, the survival product
    and the variance sum are running aggregates in time ranges.
    """
    z = NormalDist().inv_cdf(0.5 + confidence / 2.0)
    times = df.groupBy(F.col(group).alias("group"), F.col(duration).alias("time_days")).agg(
        F.count(F.lit(1)).alias("_n"), count_if(F.col(event)).alias("events"), count_if(~F.col(event)).alias("censored")
    )
    cuts = cut_points(times, "time_days")
    risk = running(times, ["group"], "time_days", {"at_risk": ("sum", "_n")}, descending=True, cuts=cuts)
    risk = risk.withColumns({
        "_keep": 1.0 - F.col("events") / F.col("at_risk"),
        "_g": F.when((F.col("events") > 0) & (F.col("at_risk") > F.col("events")), F.col("events") / (F.col("at_risk") * (F.col("at_risk") - F.col("events")))).otherwise(0.0),
    })
    curve = running(risk, ["group"], "time_days", {"survival_probability": ("product", "_keep"), "_greenwood": ("sum", "_g")}, cuts=cuts)
    s, error = F.col("survival_probability"), F.col("survival_probability") * F.sqrt("_greenwood")
    return curve.select(
        "group", "time_days", "at_risk", "events", "censored", "survival_probability",
        F.greatest(F.lit(0.0), s - z * error).alias("lower_ci"), F.least(F.lit(1.0), s + z * error).alias("upper_ci"),
    )


def with_overall(df: DataFrame, group: str, label: str = "overall") -> DataFrame:
    """Every row once in its own group and once in the overall group."""
    return df.withColumn(group, F.explode(F.array(F.col(group), F.lit(label))))


@dataclass(frozen=True)
class CoxFit:
    features: tuple[str, ...]
    coefficients: np.ndarray
    covariance: np.ndarray
    converged: bool
    iterations: int

    def table(self, spark, confidence: float = 0.95) -> DataFrame:
        z = NormalDist().inv_cdf(0.5 + confidence / 2.0)
        rows = []
        for name, b, variance in zip(self.features, self.coefficients, np.diag(self.covariance)):
            se = math.sqrt(max(float(variance), 1e-12))
            b = float(b)
            rows.append((name, b, se, math.exp(b), math.exp(b - z * se), math.exp(b + z * se), b / se, normal_two_sided(b / se)))
        return spark.createDataFrame(rows, "feature string, coefficient double, standard_error double, hazard_ratio double, lower_ci double, upper_ci double, z_value double, p_value double")


def linear(features: Sequence[str], beta) -> F.col:
    total = F.lit(0.0)
    for name, b in zip(features, beta):
        total = total + F.col(name) * float(b)
    return F.least(F.greatest(total, F.lit(-30.0)), F.lit(30.0))


def sums_per_time(p: int, second: bool) -> int:
    """Suffix sums that one time of a risk set carries for ``p`` features."""
    return 1 + p + second * p * (p + 1) // 2


def _risk_cuts(df: DataFrame, duration: str, p: int, second: bool) -> list[float]:
    """Time ranges of the risk sets; a task holds whole ranges, so wide rows get shorter ones."""
    return cut_points(df, duration, max(ROWS_PER_PIECE // sums_per_time(p, second), 1))


def _risk_sets(df: DataFrame, features: Sequence[str], beta, duration: str, event: str, cuts, second: bool) -> DataFrame:
    """Per distinct time: event counts, event sums and suffix sums over the risk set."""
    p = len(features)
    xs = [F.col(name) for name in features]
    weighted = df.withColumn("_r", F.exp(linear(features, beta)))
    sums = {"_s0": F.col("_r"), **{f"_s1_{i}": F.col("_r") * xs[i] for i in range(p)}}
    if second:
        sums |= {f"_s2_{i}_{j}": F.col("_r") * xs[i] * xs[j] for i in range(p) for j in range(i, p)}
    happened = F.col(event).cast("double")
    times = weighted.groupBy(F.col(duration).alias("_t")).agg(
        F.sum(happened).alias("_d"), F.sum(happened * linear(features, beta)).alias("_dl"),
        *(F.sum(happened * x).alias(f"_x_{i}") for i, x in enumerate(xs)), *(F.sum(c).alias(n) for n, c in sums.items()),
    )
    return running(times, [], "_t", {f"{n}_c": ("sum", n) for n in sums}, descending=True, cuts=cuts).where("_d > 0")


def fit_cox(df: DataFrame, features: Sequence[str], duration: str, event: str, *, l2: float = 1e-3, iterations: int = 25, tolerance: float = 1e-7) -> CoxFit:
    """Ridge Cox model with Breslow ties by Newton steps.

    Each step is one distributed pass; the driver receives one row of
    ``1 + p + p(p+1)/2`` sums, whatever the number of customers.
    """
    p = len(features)
    data = cut(df.select(duration, event, *(F.col(f).cast("double").alias(f) for f in features)))
    cuts = _risk_cuts(data, duration, p, True)
    beta, converged, step_no = np.zeros(p), False, 0
    information = np.eye(p)
    for step_no in range(1, iterations + 1):
        sets = _risk_sets(data, features, beta, duration, event, cuts, True)
        mean = [F.col(f"_s1_{i}_c") / F.col("_s0_c") for i in range(p)]
        row = sets.agg(
            *(F.sum(F.col(f"_x_{i}") - F.col("_d") * mean[i]).alias(f"g{i}") for i in range(p)),
            *(F.sum(F.col("_d") * (F.col(f"_s2_{i}_{j}_c") / F.col("_s0_c") - mean[i] * mean[j])).alias(f"h{i}_{j}") for i in range(p) for j in range(i, p)),
        ).first()
        gradient = np.array([row[f"g{i}"] or 0.0 for i in range(p)]) - l2 * beta
        information = np.eye(p) * l2
        for i in range(p):
            for j in range(i, p):
                information[i, j] += row[f"h{i}_{j}"] or 0.0
                if i != j:
                    information[j, i] = information[i, j]
        move = np.linalg.solve(information, gradient)
        beta = beta + np.clip(move, -2.0, 2.0)
        if float(np.abs(move).max()) < tolerance:
            converged = True
            break
    return CoxFit(tuple(features), beta, np.linalg.inv(information), converged, step_no)


def baseline_hazard(df: DataFrame, fit: CoxFit, duration: str, event: str) -> DataFrame:
    """Breslow cumulative baseline hazard at every event time."""
    cuts = _risk_cuts(df, duration, len(fit.features), False)
    sets = _risk_sets(df, fit.features, fit.coefficients, duration, event, cuts, False)
    steps = sets.select(F.col("_t").alias("time_days"), (F.col("_d") / F.col("_s0_c")).alias("hazard"))
    return running(steps, [], "time_days", {"cumulative_hazard": ("sum", "hazard")}, cuts=cuts)


def survival_at(df: DataFrame, fit: CoxFit, hazard: DataFrame, horizon: float, column: str = "survival") -> DataFrame:
    """Predicted survival of every row at a horizon (one hazard number is looked up)."""
    row = hazard.where(F.col("time_days") <= horizon).agg(F.max("cumulative_hazard").alias("h")).first()
    return df.withColumn(column, F.exp(-float(row["h"] or 0.0) * F.exp(linear(fit.features, fit.coefficients))))


def concordance(df: DataFrame, duration: str, event: str, risk: str) -> DataFrame:
    """Harrell's concordance, exact, in n log n rows instead of n squared pairs.

    A pair with different risk ranks differs first at exactly one bit of the
    rank.  Per bit, rows sharing the higher bits are ordered by time and each
    event with bit 1 adds the later rows with bit 0.
    """
    cells = df.groupBy(F.col(duration).cast("double").alias("t"), F.col(risk).cast("double").alias("risk")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(event).cast("bigint")).alias("e")
    )
    ranks = running(cells.select("risk").distinct().withColumn("_one", F.lit(1).cast("bigint")), [], "risk", {"_rank": ("sum", "_one")})
    cells = cut(cells.join(ranks.select("risk", (F.col("_rank") - 1).alias("rank")), "risk"))
    most = cells.agg(F.max("rank")).first()[0] or 0
    levels = max(int(most).bit_length(), 1)
    cuts = cut_points(cells, "t")

    def pairs(rows: DataFrame, keys: list[str], early: str, late: str):
        """Sum over rows of ``early`` times the ``late`` weight at strictly later times."""
        summed = rows.groupBy(*keys, "t").agg(F.sum(early).alias("early"), F.sum(late).alias("late"))
        ahead = running(summed, keys, "t", {"_from": ("sum", "late")}, descending=True, cuts=cuts)
        return ahead.agg(F.coalesce(F.sum(F.col("early") * (F.col("_from") - F.col("late")).cast("double")), F.lit(0.0)).alias("pairs"))

    by_bit = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).withColumns({
        "prefix": F.expr("shiftright(rank, level + 1)"), "bit": F.expr("shiftright(rank, level) & 1"),
    }).withColumns({"high": F.when(F.col("bit") == 1, F.col("e")).otherwise(0), "low": F.when(F.col("bit") == 0, F.col("n")).otherwise(0)})
    parts = [
        pairs(by_bit, ["level", "prefix"], "high", "low").select(F.col("pairs").alias("concordant")),
        pairs(cells, ["rank"], "e", "n").select(F.col("pairs").alias("tied")),
        pairs(cells.withColumn("all", F.lit(0)), ["all"], "e", "n").select(F.col("pairs").alias("comparable")),
    ]
    stacked = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    row = stacked.agg(*(F.max(c).alias(c) for c in ("concordant", "tied", "comparable")))
    return row.select("comparable", F.try_divide(F.col("concordant") + 0.5 * F.col("tied"), F.col("comparable")).alias("c_index"))


def brier(df: DataFrame, outcome: str, probability: str) -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(outcome).cast("double") - F.col(probability), 2)).alias("brier_score"))
