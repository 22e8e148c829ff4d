"""Range-split running aggregates equal single-window ones on skewed groups."""

from functools import partial
from unittest import mock

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.catalog.verdicts import RECOVERY
from tidemark.functions.ordered import cut_points, group_quantiles, running
from tidemark.operators import recovery
from tidemark.operators.causal import match_nearest
from tidemark.operators.detection import bh_fdr
from tidemark.operators.recovery import lifecycle
from tidemark.operators import survival
from tidemark.operators.survival import concordance, fit_cox, kaplan_meier


@pytest.fixture(scope="module")
def skewed(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 40).cast("string"))).alias("g"),
        ((F.col("id") * 7919) % 1009).cast("double").alias("v"), F.lit(1).cast("bigint").alias("one"))
    return rows.groupBy("g", "v").agg(F.sum("one").alias("n")).persist()


@pytest.mark.parametrize("descending", [False, True])
def test_running_sum_min(skewed, descending):
    got = running(skewed, ["g"], "v", {"s": ("sum", "n"), "m": ("min", "n")}, descending=descending, totals=["s"], rows_per_piece=100)
    order = F.col("v").desc() if descending else F.col("v").asc()
    w = W.partitionBy("g").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    want = skewed.withColumns({"s": F.sum("n").over(w), "m": F.min("n").over(w), "s_total": F.sum("n").over(W.partitionBy("g"))})
    columns = ["g", "v", "n", "s", "m", "s_total"]
    assert got.select(columns).exceptAll(want.select(columns)).isEmpty() and got.count() == want.count()


def test_groups_smaller_than_a_range_are_not_cut(spark):
    at = F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id)")
    decision = F.expr("element_at(array('recovered', 'failed', 'insufficient_data'), cast(pmod(hash(id), 3) + 1 as int))")
    reports = spark.range(2000).select((F.col("id") % 40).alias("incident_id"), at.alias("evaluated_at"), decision.alias("decision"), (F.col("id") % 97 == 0).alias("severe_guardrail_breach"))
    whole = lifecycle(reports, RECOVERY)
    rows = {}
    for size in (49, 50):  # every incident has 50 reports
        with mock.patch.object(recovery, "cut_points", partial(cut_points, rows_per_piece=size)):
            rows[size] = lifecycle(reports, RECOVERY)
        assert rows[size].exceptAll(whole).isEmpty() and whole.exceptAll(rows[size]).isEmpty()
    joins = {size: df._jdf.queryExecution().optimizedPlan().toString().count("Join") for size, df in rows.items()}
    assert joins[49] > 0 and joins[50] == 0, joins


def test_group_quantiles(skewed):
    got = group_quantiles(skewed, ["g"], "v", "n", {"a": 0.5, "b": 0.95}, rows_per_piece=100)
    plain = skewed.withColumn("v2", F.explode(F.array_repeat("v", F.col("n").cast("int")))).groupBy("g").agg(F.percentile("v2", 0.5).alias("x"), F.percentile("v2", 0.95).alias("y"))
    worst = got.join(plain, "g").agg(F.max(F.abs(F.col("a") - F.col("x")) + F.abs(F.col("b") - F.col("y"))), F.count("*")).first()
    assert worst[0] < 1e-9 and worst[1] == plain.count()


def test_bh_golden(spark):
    p = [0.01, 0.04, 0.03, 0.20, float("nan"), -1.0, 2.0]
    rows = spark.createDataFrame([("f", i, x) for i, x in enumerate(p)], "f string, i int, p double")
    got = {r["i"]: r["q_value"] for r in bh_fdr(rows, ["f"], "p").collect()}
    clean = [min(max(x, 0.0), 1.0) if x == x else 1.0 for x in p]
    order = sorted(range(7), key=lambda i: (clean[i], i))
    q, low = {}, 1.0
    for rank in range(7, 0, -1):
        low = min(low, clean[order[rank - 1]] * 7 / rank)
        q[order[rank - 1]] = max(low, clean[order[rank - 1]])
    assert got == pytest.approx(q)


def test_kaplan_meier_golden(spark):
    rows = spark.createDataFrame([("a", 1.0, True), ("a", 2.0, True), ("a", 2.0, False), ("a", 3.0, True)], "g string, t double, e boolean")
    got = kaplan_meier(rows, "t", "e", "g").orderBy("time_days").collect()
    assert got[0]["at_risk"] == 4 and got[0]["survival_probability"] == pytest.approx(0.75) and got[-1]["survival_probability"] == 0.0


def test_cox_and_concordance_golden(spark):
    rows = spark.createDataFrame([(0.5 * i, 5.0 - i, True) for i in range(5)], "x double, t double, e boolean")
    assert fit_cox(rows, ["x"], "t", "e").coefficients[0] > 0
    assert concordance(rows, "t", "e", "x").first()["c_index"] == 1.0


def test_cox_gradient_vanishes(spark):
    rng = np.random.default_rng(5)
    x, t, e = rng.normal(size=60), rng.integers(1, 12, 60).astype(float), rng.random(60) < 0.7
    rows = spark.createDataFrame([(float(a), float(b), bool(c)) for a, b, c in zip(x, t, e)], "x double, t double, e boolean")
    fit = fit_cox(rows, ["x"], "t", "e")
    beta, gradient = fit.coefficients[0], 0.0
    for time in np.unique(t[e]):
        risk = t >= time
        w = np.exp(beta * x[risk])
        d = (t == time) & e
        gradient += x[d].sum() - d.sum() * (w * x[risk]).sum() / w.sum()
    assert fit.converged and abs(gradient - 1e-3 * beta) < 1e-5


def test_matching_waves_equal_one_wave(spark):
    rng = np.random.default_rng(9)
    rows = [(f"u{i:03d}", bool(rng.random() < 0.4), float(round(rng.uniform(0.1, 0.9), 2))) for i in range(150)]
    df = spark.createDataFrame(rows, "customer_id string, exposed boolean, propensity_score double")
    one = {tuple(r) for r in match_nearest(df, 0.2).collect()}
    many = {tuple(r) for r in match_nearest(df, 0.2, rows_per_wave=40).collect()}
    assert one == many and len({c for _, c in one}) == len(one)


def test_wide_risk_sets_get_shorter_ranges(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(float(a), float(b), float(c), bool(e)) for a, b, c, e in zip(rng.normal(size=80), rng.normal(size=80), rng.uniform(1, 9, 80), rng.random(80) < 0.7)]
    df = spark.createDataFrame(rows, "x double, y double, t double, e boolean")
    whole = fit_cox(df, ["x", "y"], "t", "e")
    monkeypatch.setattr(survival, "ROWS_PER_PIECE", 80)
    assert survival.sums_per_time(13, True) == 105 and len(survival._risk_cuts(df, "t", 2, True)) > 3
    assert np.allclose(fit_cox(df, ["x", "y"], "t", "e").coefficients, whole.coefficients, atol=1e-9)
