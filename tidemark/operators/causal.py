"""Exposure models and effect estimates."""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import count_if
from tidemark.functions.lineage import cut
from tidemark.functions.ordered import ROWS_PER_PIECE, cut_points, with_piece
from tidemark.operators.impact import weighted_ate

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ESTIMATE_DDL = "estimator string, estimand string, estimate double, standard_error double, lower_ci double, upper_ci double, sample_size bigint, treated_count bigint, control_count bigint, placebo boolean"


def standardize(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Centre and scale columns (population deviation; constant columns keep scale 1).

    The moments are one aggregated row, brought back as literals.
    """
    row = df.agg(*(F.avg(F.col(f).cast("double")).alias(f"m_{f}") for f in features), *(F.stddev_pop(F.col(f).cast("double")).alias(f"s_{f}") for f in features)).first()
    scaled = {}
    for f in features:
        mean, scale = float(row[f"m_{f}"] or 0.0), float(row[f"s_{f}"] or 0.0)
        scaled[f] = (F.col(f).cast("double") - mean) / (scale if scale >= 1e-9 else 1.0)
    return df.withColumns(scaled)


def propensity(df: DataFrame, features: Sequence[str], exposed: str = "exposed", *, l2: float = 1e-4, column: str = "propensity_score") -> tuple[DataFrame, bool]:
    """Ridge logistic exposure probability for every row, and whether it converged."""
    n = df.count()
    assembled = VectorAssembler(inputCols=list(features), outputCol="_x").transform(df.withColumn("_label", F.col(exposed).cast("double")))
    model = LogisticRegression(featuresCol="_x", labelCol="_label", probabilityCol="_prob", predictionCol="_pred", rawPredictionCol="_raw",
                               standardization=False, regParam=l2 / n, elasticNetParam=0.0, maxIter=500, tol=1e-10).fit(assembled)
    scored = model.transform(assembled).withColumn(column, F.least(F.greatest(vector_to_array("_prob")[1], F.lit(1e-6)), F.lit(1.0 - 1e-6)))
    return scored.drop("_x", "_label", "_prob", "_pred", "_raw"), model.summary.totalIterations < 500


def iptw(df: DataFrame, clip: float, *, score: str = "propensity_score", exposed: str = "exposed", column: str = "stabilized_weight") -> DataFrame:
    """Stabilised inverse-probability weights with clipped scores."""
    prevalence = float(df.agg(F.avg(F.col(exposed).cast("double"))).first()[0] or 0.0)
    bounded = F.least(F.greatest(F.col(score), F.lit(clip)), F.lit(1.0 - clip))
    return df.withColumn(column, F.when(F.col(exposed), prevalence / bounded).otherwise((1.0 - prevalence) / (1.0 - bounded)))


def greedy_pairs(frame: pd.DataFrame, limit: float) -> pd.DataFrame:
    """Serial nearest-control matching over one bounded slice of the score line.

    Controls of equal score form one slot; emptied slots are skipped by path
    compression, so the slice costs about n log n.
    """

    treated = frame[frame.exposed].sort_values(["x", "id"])
    slots = frame[~frame.exposed].sort_values(["x", "id"]).groupby("x", sort=True)["id"].apply(list)
    xs = slots.index.to_numpy()
    queues = [ids[::-1] for ids in slots]
    left, right = list(range(len(xs) + 1)), list(range(len(xs) + 1))

    def find(parent: list[int], i: int) -> int:
        root = i
        while parent[root] != root:
            root = parent[root]
        while parent[i] != root:
            parent[i], i = root, parent[i]
        return root

    out = []
    for x, key in zip(treated.x.to_numpy(), treated.id):
        at = int(np.searchsorted(xs, x, side="right"))
        # ``left`` is shifted by one: index 0 means nothing is left on that side.
        low, high = find(left, at) - 1, find(right, at)
        options = [(abs(x - xs[i]), queues[i][-1], i) for i in (low, high) if 0 <= i < len(xs)]
        if not options:
            continue
        distance, control, slot = min(options)
        if distance > limit:
            continue
        queues[slot].pop()
        out.append((key, control))
        if not queues[slot]:
            left[slot + 1], right[slot] = slot, slot + 1
    return pd.DataFrame(out, columns=["treated_id", "control_id"])


def match_nearest(
    df: DataFrame, caliper: float, *, key: str = "customer_id", score: str = "propensity_score", exposed: str = "exposed", rows_per_wave: int = ROWS_PER_PIECE
) -> DataFrame:
    """Greedy 1:1 matching without replacement, treated taken in (score, key) order.

    The serial result only depends on what earlier treated left over, so the score
    line is worked in waves of bounded size.  A wave of T treated can use at most
    the controls inside its range plus the T nearest free ones on either side;
    nothing more is sent to its task.  Used controls are removed and the state is
    checkpointed between waves.
    """
    spark = df.sparkSession
    units = df.select(F.col(key).cast("string").alias("id"), F.col(exposed).alias("exposed"), F.log(F.col(score) / (1.0 - F.col(score))).alias("x"))
    units = cut(units)
    scale = float(units.agg(F.stddev_pop("x")).first()[0] or 0.0) or 1.0
    limit = caliper * scale
    cuts = cut_points(units, "x", rows_per_wave, least=1)
    units = with_piece(units, "x", cuts, "wave")
    sizes = {row["wave"]: row["n"] for row in units.where("exposed").groupBy("wave").agg(F.count(F.lit(1)).alias("n")).collect()}
    free = units.where("NOT exposed")
    waves: list[DataFrame] = []

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        return greedy_pairs(frame, limit)

    for wave in sorted(sizes):
        size = sizes[wave]
        lowest = (F.col("x"), F.col("id"))
        inside = free.where(F.col("wave") == wave)
        # Equal scores are used in key order, so the first ``size`` per side suffice.
        below = free.where((F.col("wave") < wave)).orderBy(F.col("x").desc(), F.col("id")).limit(size)
        above = free.where((F.col("wave") > wave)).orderBy(*lowest).limit(size)
        rows = units.where(F.col("exposed") & (F.col("wave") == wave)).unionByName(inside).unionByName(below).unionByName(above)
        pairs = cut(rows.select("id", "exposed", "x").groupBy(F.lit(wave).alias("wave")).applyInPandas(solve, "treated_id string, control_id string"))
        waves.append(pairs)
        if len(sizes) > 1:
            free = cut(free.join(pairs.select(F.col("control_id").alias("id")), "id", "left_anti").select(*units.columns))
    if not waves:
        return spark.createDataFrame([], "treated_id string, control_id string")
    return reduce(DataFrame.unionByName, waves)


def attach_matches(df: DataFrame, pairs: DataFrame, key: str = "customer_id") -> DataFrame:
    """Partner id and matched flag on both sides of every pair."""
    both = pairs.select(F.col("treated_id").alias(key), F.col("control_id").alias("matched_customer_id")).unionByName(
        pairs.select(F.col("control_id").alias(key), F.col("treated_id").alias("matched_customer_id")))
    return df.join(both, key, "left").withColumn("matched", F.col("matched_customer_id").isNotNull())


def smd(df: DataFrame, features: Sequence[str], weight: str | None = None, exposed: str = "exposed") -> DataFrame:
    """Standardised mean difference per feature from weighted sums in one aggregate."""
    w = F.col(weight) if weight else F.lit(1.0)
    arm = F.col(exposed)
    sums = []
    for i, f in enumerate(features):
        x = F.col(f).cast("double")
        for tag, side in (("t", arm), ("c", ~arm)):
            sums += [F.sum(F.when(side, w)).alias(f"w{tag}{i}"), F.sum(F.when(side, w * x)).alias(f"x{tag}{i}"), F.sum(F.when(side, w * x * x)).alias(f"q{tag}{i}")]
    row = df.agg(*sums)
    mean = lambda tag, i: F.col(f"x{tag}{i}") / F.col(f"w{tag}{i}")
    var = lambda tag, i: F.greatest(F.col(f"q{tag}{i}") / F.col(f"w{tag}{i}") - mean(tag, i) * mean(tag, i), F.lit(0.0))
    rows = F.array(*(
        F.struct(F.lit(f).alias("feature"), ((mean("t", i) - mean("c", i)) / F.sqrt(F.greatest((var("t", i) + var("c", i)) / 2.0, F.lit(1e-12)))).alias("smd"))
        for i, f in enumerate(features)))
    return row.select(F.inline(rows))


PRIME = (1 << 31) - 1


def poisson_limits() -> list[int]:
    """Upper ends of 0, 1, 2, ... draws of Poisson(1) on the numbers below PRIME, up to the last one that they can tell."""
    limits, term, total, k = [], math.exp(-1.0), 0.0, 0
    while True:
        total += term
        k += 1
        limits.append(int(total * PRIME))
        term /= k
        if int((total + term) * PRIME) == limits[-1]:
            return limits


def replicate_factor(replicate: int, seed: int) -> int:
    """The factor of a replicate in the hash of its rows."""
    return (replicate * 1_103_515_245 + seed * 12_345 + 1) % PRIME


def replicate_sums(df: DataFrame, key: str, samples: int, seed: int, sums: dict[str, Column]) -> DataFrame:
    """Poisson bootstrap: (replicate, one weighted sum per entry of ``sums``) without multiplying rows.

    Two 32-bit halves a and b of the key's MD5 give a row the number (a * factor + b) mod PRIME in each
    replicate, and the Poisson law its weight.  Every task adds a batch times its weight matrix to one
    array per sum and gives one row per replicate, so as many rows are read as there are.
    """
    digest = F.md5(F.col(key).cast("string").cast("binary"))
    half = lambda i: F.conv(F.substring(digest, i, 8), 16, 10).cast("long")
    names, limits = list(sums), np.array(poisson_limits(), dtype=np.int64)
    factors = np.array([replicate_factor(r, seed) for r in range(1, samples + 1)], dtype=np.int64)

    def add(batches):
        totals = np.zeros((len(names), samples))
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.iloc[at : at + 4096]
                a, b = part["_a"].to_numpy()[:, None] % PRIME, part["_b"].to_numpy()[:, None] % PRIME
                values = part[names].to_numpy(dtype=np.float64, na_value=0.0).T
                for first in range(0, samples, 256):
                    drawn = (a * factors[first : first + 256] + b) % PRIME
                    totals[:, first : first + 256] += values @ np.searchsorted(limits, drawn, side="right")
        yield pd.DataFrame({"replicate": np.arange(1, samples + 1), **dict(zip(names, totals, strict=True))})

    rows = df.select(half(1).alias("_a"), half(9).alias("_b"), *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in sums.items()])
    return rows.mapInPandas(add, "replicate int, " + ", ".join(f"{n} double" for n in names)).groupBy("replicate").agg(*[F.sum(n).alias(n) for n in names])


def interval(reps: DataFrame, column: str, confidence: float) -> tuple[float | None, float | None, float | None]:
    """Standard error and percentile interval over replicate estimates (bounded rows)."""
    tail = (1.0 - confidence) / 2.0
    row = reps.agg(F.stddev_samp(column).alias("se"), F.percentile(column, F.lit(tail)).alias("lo"), F.percentile(column, F.lit(1.0 - tail)).alias("hi")).first()
    return row["se"], row["lo"], row["hi"]


def difference_in_differences(features: DataFrame) -> DataFrame:
    arm = F.col("exposed")
    mean = lambda c, side: F.coalesce(F.avg(F.when(side, F.col(c))), F.lit(0.0))
    return features.agg((mean("post_purchase_rate", arm) - mean("pre_purchase_rate", arm) - mean("post_purchase_rate", ~arm) + mean("pre_purchase_rate", ~arm)).alias("estimate"))


def mean_difference(df: DataFrame, outcome: str, exposed: str = "exposed") -> DataFrame:
    y, arm = F.col(outcome).cast("double"), F.col(exposed)
    return df.agg((F.avg(F.when(arm, y)) - F.avg(F.when(~arm, y))).alias("estimate"))


def matched_differences(df: DataFrame, pairs: DataFrame, outcome: str, key: str = "customer_id") -> DataFrame:
    """Outcome difference of every matched pair."""
    y = df.select(F.col(key).cast("string").alias("_id"), F.col(outcome).cast("double").alias("_y"))
    left = pairs.join(y.select(F.col("_id").alias("treated_id"), F.col("_y").alias("yt")), "treated_id")
    return left.join(y.select(F.col("_id").alias("control_id"), F.col("_y").alias("yc")), "control_id").select("treated_id", (F.col("yt") - F.col("yc")).alias("difference"))


def causal_estimates(scored: DataFrame, pairs: DataFrame, placebo: float | None, config) -> tuple[DataFrame, DataFrame]:
    """Estimate table and the weighted-effect replicates for the money interval."""
    y, w, arm = F.col("churned").cast("double"), F.col("stabilized_weight"), F.col("exposed")

    sums = {}
    for name, extra in (("naive", F.lit(1.0)), ("effect", w)):
        for side, inside in (("t", arm), ("c", ~arm)):
            sums |= {f"{name}_{side}_y": F.when(inside, y * extra), f"{name}_{side}_n": F.when(inside, extra)}
    gap = lambda n: F.try_divide(F.col(f"{n}_t_y"), F.col(f"{n}_t_n")) - F.try_divide(F.col(f"{n}_c_y"), F.col(f"{n}_c_n"))
    reps = replicate_sums(scored, "customer_id", config.bootstrap_samples, config.random_seed, sums)
    reps = cut(reps.select("replicate", gap("naive").alias("naive"), gap("effect").alias("effect")))
    differences = cut(matched_differences(scored, pairs, "churned"))
    matched_reps = replicate_sums(differences, "treated_id", config.bootstrap_samples, config.random_seed + 1, {"d": F.col("difference"), "n": F.when(F.col("difference").isNotNull(), 1.0)})
    matched_reps = cut(matched_reps.select("replicate", F.try_divide("d", "n").alias("matched")))
    arms = scored.agg(count_if(arm).alias("t"), count_if(~arm).alias("c"), weighted_ate("churned", "stabilized_weight").alias("iptw"),
                      (F.avg(F.when(arm, y)) - F.avg(F.when(~arm, y))).alias("naive")).first()
    matched = differences.agg(F.avg("difference").alias("m"), F.count(F.lit(1)).alias("n")).first()
    did = difference_in_differences(scored).first()["estimate"]
    total, treated, control = arms["t"] + arms["c"], arms["t"], arms["c"]
    rows = []
    for name, point, frame, column, size in (
        ("naive", arms["naive"], reps, "naive", total), ("propensity_matched", matched["m"], matched_reps, "matched", 2 * matched["n"]),
        ("stabilized_iptw", arms["iptw"], reps, "effect", total),
    ):
        rows.append((name, "incremental_churn_rate", point, *interval(frame, column, config.confidence_level), size, treated, control, False))
    rows.append(("difference_in_differences", "daily_purchase_rate_change", did, None, None, None, total, treated, control, False))
    rows.append(("naive_placebo", "incremental_churn_rate", placebo, None, None, None, total, treated, control, True))
    return scored.sparkSession.createDataFrame(rows, ESTIMATE_DDL), reps.select("replicate", "effect")

