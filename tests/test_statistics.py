"""Tail probabilities against hand values and plain recomputation."""

import hashlib
import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidemark.functions import tails
from tidemark.operators import causal, recovery


def one(run, *values):
    return float(run(*(np.array([v], dtype=float) for v in values))[0])


def test_student_t_known_values():
    assert one(tails.t_two_sided, 2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert one(tails.t_two_sided, 0.0, 5) == pytest.approx(1.0)
    assert one(tails.t_two_sided, float("nan"), 5) == 1.0
    assert one(tails.t_upper, -1.0, 3) == pytest.approx(1 - one(tails.t_upper, 1.0, 3))
    assert one(tails.t_upper, float("inf"), 3) == 0.0
    # One degree of freedom is the Cauchy law.
    assert one(tails.t_two_sided, 3.0, 1) == pytest.approx(2 * (0.5 - math.atan(3.0) / math.pi), abs=1e-12)


def direct(logs, k):
    mass = [math.exp(x) for x in logs]
    return min(1.0, sum(x for x in mass if x <= mass[k] * (1 + 1e-10) + 1e-15))


@pytest.mark.parametrize(("n", "k", "p", "a", "b"), [(1, 0, 0.3, 1.0, 1.0), (20, 11, 0.3, 0.5, 1.5), (300, 20, 0.1, 3.0, 40.0), (2000, 900, 0.4, 80.0, 120.0), (3000, 3000, 0.9, 1.5, 0.5)])
def test_discrete_tails_match_direct_sums(n, k, p, a, b):
    lg = math.lgamma
    choose = [lg(n + 1) - lg(j + 1) - lg(n - j + 1) for j in range(n + 1)]
    assert one(tails.binomial_two_sided, k, n, p) == pytest.approx(direct([c + j * math.log(p) + (n - j) * math.log1p(-p) for j, c in enumerate(choose)], k), abs=1e-8)
    logs = [c + lg(j + a) + lg(n - j + b) - lg(n + a + b) + lg(a + b) - lg(a) - lg(b) for j, c in enumerate(choose)]
    assert one(tails.beta_binomial_two_sided, k, n, a, b) == pytest.approx(direct(logs, k), abs=1e-8)
    mean, shape, support = n * p / 3, a, range(60 * n + 400)
    assert one(tails.count_two_sided, k, mean, float("nan")) == pytest.approx(direct([j * math.log(mean) - mean - lg(j + 1) for j in support], k), abs=1e-8)
    logs = [lg(j + shape) - lg(shape) - lg(j + 1) + shape * math.log(shape / (shape + mean)) + j * math.log(mean / (shape + mean)) for j in support]
    assert one(tails.count_two_sided, k, mean, shape) == pytest.approx(direct(logs, k), abs=2e-7)


def test_unusable_counts_give_one():
    assert one(tails.binomial_two_sided, 3, 0, 0.5) == one(tails.binomial_two_sided, 5, 4, 0.5) == one(tails.beta_binomial_two_sided, 1, 2, float("nan"), 1.0) == 1.0
    assert one(tails.count_two_sided, 1, 0.0, float("nan")) == 0.0 and one(tails.count_two_sided, 0, 0.0, float("nan")) == 1.0


def test_large_counts_agree_with_the_normal_law():
    n, p = 1e9, 0.4
    for z in (0.5, 2.0, 5.0):
        k = round(n * p + z * math.sqrt(n * p * (1 - p)))
        assert one(tails.binomial_two_sided, k, n, p) == pytest.approx(math.erfc(z / math.sqrt(2)), rel=2e-3)
    # A beta-binomial of a billion trials is its beta prior.
    assert one(tails.beta_binomial_two_sided, 5e8, 1e9, 1.0, 2.0) == pytest.approx(0.25, abs=1e-6)
    assert one(tails.incomplete_beta, 30.0, 90.0, 0.25) == pytest.approx(0.5, abs=0.02)


def test_column_priors_and_laws(spark):
    from tidemark.operators import detection as det

    rows = spark.createDataFrame([(8.0, 10.0, [5.0] * 10, [5.0] * 10, 20.0, [10.0, 11.0, 9.0, 10.0, 10.0, 9.0, 11.0]), (1.0, 2.0, [], [], 20.0, [2.0, 20.0, 3.0, 19.0, 4.0, 18.0, 5.0]), (1.0, 2.0, [1.0, 9.0], [0.0, 5.0], 1.0, [0.0] * 3), (1.0, 2.0, None, None, 1.0, [])], "k double, n double, hk array<double>, hn array<double>, x double, h array<double>")
    rows = det.log_t_p_value(det.count_law(det.beta_prior(rows, "hk", "hn", "a", "b"), "h", "m", "s"), rows["x"], "h", "log_p")
    from pyspark.sql import functions as F

    got = rows.select("a", det.count_family(F.col("x"), "m", "s").alias("family"), det.count_p_value(F.col("x"), "m", "s").alias("p"), tails.beta_binomial_p("k", "n", "a", "b").alias("bp"), "log_p").collect()
    assert [r["family"] for r in got] == ["poisson", "negative-binomial", "degenerate-count", "count-unavailable"]
    assert got[0]["p"] < 0.01 and got[2]["p"] == 0.0 and got[3]["p"] == 1.0
    assert one(tails.binomial_two_sided, 8, 10, 0.99) < got[0]["bp"] < 0.05 and got[1]["a"] is None and got[1]["bp"] == 1.0
    assert got[0]["log_p"] < 0.01 and got[3]["log_p"] == 1.0


def test_greedy_pairs_equal_the_serial_rule():
    import pandas as pd

    from tidemark.operators.causal import greedy_pairs

    rng = random.Random(3)
    for _ in range(60):
        rows = [(f"c{i:03d}", rng.random() < 0.4, round(rng.gauss(0, 1), 1)) for i in range(rng.randint(4, 60))]
        limit = 0.5
        free, expected = {r[0]: r[2] for r in rows if not r[1]}, {}
        for key, _, x in sorted((r for r in rows if r[1]), key=lambda r: (r[2], r[0])):
            if not free:
                break
            best = min(free, key=lambda c: (abs(x - free[c]), c))
            if abs(x - free[best]) <= limit:
                expected[key] = best
                del free[best]
        got = greedy_pairs(pd.DataFrame(rows, columns=["id", "exposed", "x"]), limit) if expected or free else pd.DataFrame(columns=["treated_id", "control_id"])
        assert dict(zip(got.treated_id, got.control_id)) == expected


def test_normal_tail():
    assert tails.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert np.isfinite(tails.normal_two_sided(8.0))


def _all_slopes(y):
    i, j = np.triu_indices(len(y), 1)
    return (y[j] - y[i]) / (j - i)


def test_median_slope_matches_all_pairs():
    rng = np.random.default_rng(3)
    for n in (2, 3, 4, 7, 30, 61, 200):
        for y in (rng.normal(size=n), rng.integers(0, 3, n).astype(float), np.zeros(n), np.arange(n) * 0.25, np.where(np.arange(n) == 1, 1e9, rng.normal(size=n))):
            assert recovery.median_slope(y) == pytest.approx(np.median(_all_slopes(y)), rel=1e-9, abs=1e-9)
    assert recovery.median_slope(np.array([])) == 0.0 and recovery.median_slope(np.array([5.0])) == 0.0


def test_median_slope_of_a_year_of_hours():
    y = np.random.default_rng(1).normal(size=8760) + 0.01 * np.arange(8760)
    assert recovery.median_slope(y) == pytest.approx(0.01, abs=1e-4)


def test_replicate_sums_match_brute_force(spark):
    rows = [(f"k{i}", float(i % 7), i % 3 == 0) for i in range(300)] + [("k1", None, True)]
    df = spark.createDataFrame(rows, "key string, x double, arm boolean")
    got = {r["replicate"]: (r["x"], r["n"]) for r in causal.replicate_sums(df, "key", 300, 5, {"x": F.when(F.col("arm"), F.col("x")), "n": F.lit(1.0)}).collect()}
    limits, want = causal.poisson_limits(), {}
    for r in range(1, 301):
        x = n = 0.0
        for key, value, arm in rows:
            digest = hashlib.md5(key.encode()).hexdigest()
            number = (int(digest[:8], 16) % causal.PRIME * causal.replicate_factor(r, 5) + int(digest[8:16], 16) % causal.PRIME) % causal.PRIME
            weight = sum(limit <= number for limit in limits)
            x, n = x + weight * (value or 0.0) * arm, n + weight
        want[r] = (x, n)
    assert got == want
    assert len(limits) > 11 and np.mean([n for _, n in want.values()]) == pytest.approx(301, rel=0.02) and np.std([n for _, n in want.values()]) == pytest.approx(301**0.5, rel=0.15)
