"""Queries for section H (anomaly detection)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.catalog.common import Catalog, base, r, rounded, shared
from tidemark.catalog.cube import cube_sql, materialized, selected_cube
from tidemark.catalog.sources_facts import fact_prelude
from tidemark.functions import tails
from tidemark.functions.columns import period_start
from tidemark.operators import detection as det
from tidemark.operators.registry import REGISTRY
from tidemark.plans.config import AnalyticsConfig, CohortSpec, DetectionConfig, MetricOverride, Scenario, Selector

C = Catalog()
METRICS = ("checkout_sessions", "checkout_conversion_rate", "payment_approval_rate", "payment_decline_rate", "payment_latency_p95_ms",
           "completed_orders", "gross_order_value", "on_time_delivery_rate")
COHORTS = AnalyticsConfig(cohorts=(CohortSpec("overall"), CohortSpec("region", ("region",))), funnel_cohorts=("overall",), contributions=())
HOURLY = ("checkout_sessions", "checkout_conversion_rate", "payment_approval_rate")
DAILY_METRICS = ("completed_orders", "gross_order_value", "payment_decline_rate", "payment_latency_p95_ms", "on_time_delivery_rate")
CONFIG = DetectionConfig(
    selectors=tuple(Selector(m, ("hour",), ("overall", "region") if m == "checkout_conversion_rate" else ("overall",)) for m in HOURLY)
    + tuple(Selector(m, ("day",), ("overall", "region")) for m in DAILY_METRICS),
    metric_overrides=(
        MetricOverride("checkout_conversion_rate", minimum_relative_effect=0.35, minimum_sample_size=5),
        MetricOverride("payment_approval_rate", minimum_relative_effect=0.30, minimum_sample_size=5),
        MetricOverride("completed_orders", robust_z_threshold=2.5, minimum_relative_effect=0.25, minimum_sample_size=1),
        MetricOverride("gross_order_value", robust_z_threshold=2.5, minimum_relative_effect=0.45, minimum_sample_size=1),
        MetricOverride("checkout_sessions", minimum_relative_effect=0.25, minimum_sample_size=1),
    ),
    benchmark_scenarios=(
        Scenario("orders-drop", "completed_orders", "day", "overall", datetime(2024, 2, 5), 2, "level_shift", -0.6, "decrease"),
        Scenario("value-spike", "gross_order_value", "day", "overall", datetime(2024, 2, 10), 2, "spike", 1.2, "increase"),
        Scenario("sessions-drift", "checkout_sessions", "hour", "overall", datetime(2024, 2, 3, 6), 12, "drift", 1.5, "increase"),
        Scenario("approval-drop", "payment_approval_rate", "hour", "overall", datetime(2024, 2, 6, 6), 10, "level_shift", -0.7, "decrease"),
        Scenario("late-asia", "on_time_delivery_rate", "day", "region", datetime(2024, 2, 12), 3, "level_shift", -0.6, "decrease", {"region": "ASIA"}),
    ),
)


def observations(spark, sf):
    wanted = [(s.metric, grain, cohort) for s in CONFIG.selectors for grain in s.time_grains for cohort in s.cohorts]
    return selected_cube(spark, sf, "cube-detect", wanted, COHORTS)


def series(spark, sf):
    return det.select_series(observations(spark, sf), CONFIG)


def injected(spark, sf):
    return shared(spark, sf, "injected", lambda: det.inject_scenarios(series(spark, sf), CONFIG.benchmark_scenarios)[0])


def truth(spark, sf):
    return det.inject_scenarios(series(spark, sf), CONFIG.benchmark_scenarios)[1]


def detected(spark, sf):
    return shared(spark, sf, "detected", lambda: det.score_series(injected(spark, sf), CONFIG))


def scored(spark, sf):
    """Baselines and change scores of the unperturbed series (no p-values needed)."""
    keep = ["metric_name", "time_grain", "cohort_name", "region", "period_start", "expected_value", "expected_lower", "expected_upper", "robust_scale",
            "residual", "absolute_change", "relative_change", "robust_z", "baseline_points", "seasonal_points", "baseline_method", "baseline_last_period",
            "is_eligible", "history_gate_passed", "sample_size_gate_passed", "cusum_score", "change_detected", "estimated_change_start",
            "sequential_log_likelihood", "sequential_alert", "value", "series_id", "sample_size"]
    return shared(spark, sf, "scored", lambda: det.add_change_scores(det.baselines(series(spark, sf), CONFIG), CONFIG).select(*keep))


_USED = list(dict.fromkeys(REGISTRY[m].fact for m in METRICS))
_WANTED = " OR ".join(
    f"(metric_name = '{s.metric}' AND time_grain IN ({', '.join(map(repr, s.time_grains))}) AND cohort_name IN ({', '.join(map(repr, s.cohorts))}))" for s in CONFIG.selectors)
_SAMPLE = "CASE metric_name " + " ".join(f"WHEN '{o.metric}' THEN {o.minimum_sample_size}" for o in CONFIG.metric_overrides if o.minimum_sample_size is not None) + " ELSE 10 END"


def _bounds(attribute: str) -> str:
    pairs = [(m, getattr(REGISTRY[m], attribute)) for m in METRICS if getattr(REGISTRY[m], attribute) is not None]
    return "CASE metric_name " + " ".join(f"WHEN '{m}' THEN {v}::DOUBLE" for m, v in pairs) + " END"


SERIES_SQL = materialized(fact_prelude(*_USED)) + f""", cells AS MATERIALIZED ({cube_sql(METRICS, COHORTS)}),
ser AS MATERIALIZED (SELECT *, concat_ws('|', metric_name, time_grain, cohort_name, COALESCE(region, '-')) AS sid FROM cells WHERE {_WANTED})
"""
# Independent form: rank usable points, self-join to the previous N, aggregate twice.
SCORE_SQL = SERIES_SQL + f""", pol AS (SELECT * FROM (VALUES ('hour', 168, 72, 24 * 3600, 3), ('day', 14, 7, 7 * 86400, 2)) AS t(time_grain, n, need, cyc, seas)),
ranked AS MATERIALIZED (SELECT ser.*, pol.n, pol.need, pol.cyc, pol.seas, value IS NOT NULL AND quality_status <> 'invalid' AS usable,
  COALESCE(sum((value IS NOT NULL AND quality_status <> 'invalid')::INT) OVER (PARTITION BY sid ORDER BY period_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM ser JOIN pol USING (time_grain)),
pairs AS MATERIALIZED (SELECT a.sid, a.period_start, b.value AS v, b.period_start AS seen_at,
  date_diff('second', b.period_start, a.period_start) >= a.cyc AND date_diff('second', b.period_start, a.period_start) % a.cyc = 0 AS seasonal
  FROM ranked a JOIN ranked b ON a.sid = b.sid AND b.usable AND b.before >= a.before - a.n AND b.before < a.before AND b.period_start < a.period_start),
counts AS (SELECT sid, period_start, count(*) AS points, count(*) FILTER (seasonal) AS seasonal_points, max(seen_at) AS last_at FROM pairs GROUP BY 1, 2),
flagged AS (SELECT r.*, COALESCE(points, 0) AS points, COALESCE(seasonal_points, 0) AS seasonal_points, last_at, COALESCE(seasonal_points, 0) >= seas AS use_seasonal
  FROM ranked r LEFT JOIN counts c USING (sid, period_start)),
bvals AS MATERIALIZED (SELECT p.sid, p.period_start, p.v FROM pairs p JOIN flagged f USING (sid, period_start) WHERE NOT f.use_seasonal OR p.seasonal),
loc AS (SELECT sid, period_start, median(v) AS loc, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr, stddev_samp(v) AS sd, count(*) AS cnt FROM bvals GROUP BY 1, 2),
dev AS (SELECT sid, period_start, 1.4826::DOUBLE * median(abs(v - loc)) AS mad FROM bvals JOIN loc USING (sid, period_start) GROUP BY 1, 2),
sc AS (SELECT f.*, CASE WHEN value IS NOT NULL THEN loc END AS expected_value,
  CASE WHEN value IS NOT NULL AND loc IS NOT NULL THEN greatest(CASE WHEN mad > 1e-12 THEN mad WHEN cnt >= 4 AND iqr / 1.349::DOUBLE > 1e-12 THEN iqr / 1.349::DOUBLE WHEN cnt >= 2 THEN sd ELSE mad END, 1e-6::DOUBLE, abs(loc) * 0.01::DOUBLE) END AS robust_scale
  FROM flagged f LEFT JOIN loc USING (sid, period_start) LEFT JOIN dev USING (sid, period_start)),
sz AS (SELECT *, value - expected_value AS residual, (value - expected_value) / robust_scale AS robust_z,
  CASE WHEN abs(expected_value) > 1e-6 THEN (value - expected_value) / abs(expected_value) END AS relative_change,
  CASE WHEN expected_value IS NOT NULL THEN greatest(expected_value - 2.5::DOUBLE * robust_scale, {_bounds('minimum')}) END AS expected_lower, CASE WHEN expected_value IS NOT NULL THEN least(expected_value + 2.5::DOUBLE * robust_scale, {_bounds('maximum')}) END AS expected_upper,
  value IS NOT NULL AND quality_status IN ('ok', 'insufficient_data') AND sample_size >= {_SAMPLE} AND points >= need AS is_eligible FROM sc),
m_scored AS MATERIALIZED (SELECT * FROM sz)
"""
_KEY = "metric_name, time_grain, cohort_name, region, period_start"
_KEYS = ["metric_name", "time_grain", "cohort_name", "region", "period_start"]


@C.add("h1_select_series", SERIES_SQL + f"SELECT {_KEY}, {r('value')}, sample_size FROM ser")
def h1(spark, sf):
    return rounded(series(spark, sf).select(*_KEYS, "value", "sample_size"))


@C.add("h2_stable_ids")
def h2(spark, sf):
    return detected(spark, sf).select("series_id", "observation_id", *_KEYS)


@C.add("h3_inject_scenarios", SERIES_SQL + f"""
SELECT metric_name, time_grain, cohort_name, region, period_start, scenario_id, {r('v', 6, 'value')} FROM (SELECT *, CASE
 WHEN scenario_id = 'orders-drop' THEN round_even(value * 0.4, 0) WHEN scenario_id = 'value-spike' THEN value * 2.2
 WHEN scenario_id = 'sessions-drift' THEN round_even(value * (1 + 1.5::DOUBLE * (date_diff('hour', TIMESTAMP '2024-02-03 06:00:00', period_start) + 1) / 12), 0)
 ELSE greatest(round_even(value * (CASE scenario_id WHEN 'approval-drop' THEN 0.3::DOUBLE ELSE 0.4::DOUBLE END) * denominator, 0), 0) / denominator END AS v
 FROM (SELECT *, CASE
 WHEN metric_name = 'completed_orders' AND time_grain = 'day' AND cohort_name = 'overall' AND period_start >= '2024-02-05' AND period_start < '2024-02-07' THEN 'orders-drop'
 WHEN metric_name = 'gross_order_value' AND time_grain = 'day' AND cohort_name = 'overall' AND period_start >= '2024-02-10' AND period_start < '2024-02-12' THEN 'value-spike'
 WHEN metric_name = 'checkout_sessions' AND time_grain = 'hour' AND period_start >= '2024-02-03 06:00:00' AND period_start < '2024-02-03 18:00:00' THEN 'sessions-drift'
 WHEN metric_name = 'payment_approval_rate' AND time_grain = 'hour' AND period_start >= '2024-02-06 06:00:00' AND period_start < '2024-02-06 16:00:00' THEN 'approval-drop'
 WHEN metric_name = 'on_time_delivery_rate' AND region = 'ASIA' AND period_start >= '2024-02-12' AND period_start < '2024-02-15' THEN 'late-asia' END AS scenario_id FROM ser)
 WHERE scenario_id IS NOT NULL)""")
def h3(spark, sf):
    return rounded(injected(spark, sf).where("scenario_id IS NOT NULL").select(*_KEYS, "scenario_id", "value"))


@C.add("h4_rolling_history", SCORE_SQL + f"SELECT {_KEY}, points AS baseline_points, last_at AS baseline_last_period FROM m_scored")
def h4(spark, sf):
    return scored(spark, sf).select(*_KEYS, "baseline_points", "baseline_last_period")


@C.add("h5_seasonal_subset", SCORE_SQL + f"SELECT {_KEY}, seasonal_points, CASE WHEN use_seasonal THEN 'seasonal-median-mad' ELSE 'rolling-median-mad' END AS baseline_method FROM m_scored")
def h5(spark, sf):
    return scored(spark, sf).select(*_KEYS, "seasonal_points", "baseline_method")


@C.add("h6_h7_robust_baseline", SCORE_SQL + f"SELECT {_KEY}, {r('expected_value', 4)}, {r('robust_scale', 4)}, {r('expected_lower', 4)}, {r('expected_upper', 4)} FROM m_scored")
def h6(spark, sf):
    return rounded(scored(spark, sf).select(*_KEYS, "expected_value", "robust_scale", "expected_lower", "expected_upper"), 4)


@C.add("h8_residuals", SCORE_SQL + f"SELECT {_KEY}, {r('residual', 4)}, {r('abs(residual)', 4, 'absolute_change')}, {r('relative_change', 4)}, {r('robust_z', 4)} FROM m_scored")
def h8(spark, sf):
    return rounded(scored(spark, sf).select(*_KEYS, "residual", "absolute_change", "relative_change", "robust_z"), 4)


@C.add("h9_student_t_p")
def h9(spark, sf):
    rows = scored(spark, sf).where("robust_z IS NOT NULL")
    return rows.select(*_KEYS, tails.t_two_sided_p("robust_z", F.greatest(F.col("baseline_points") - 1, F.lit(1)).cast("double")).alias("p_value"))


_LOG_BINOMIAL = "lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(p) + (n - j) * ln(1 - p)"


@C.add("h10_exact_binomial", f"""
WITH d AS (SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, count(*) FILTER (value > 50) AS k, 0.37::DOUBLE AS p FROM events GROUP BY 1, 2),
g AS (SELECT day, event_type, k, n, p, unnest(range(0, n + 1)) AS j FROM d),
m AS (SELECT *, exp({_LOG_BINOMIAL}) AS pmf FROM g),
o AS (SELECT day, event_type, pmf AS ap FROM m WHERE j = k)
SELECT day, event_type, {r('least(sum(pmf) FILTER (pmf <= ap + 1e-12), 1.0)', 6, 'p_value')} FROM m JOIN o USING (day, event_type) GROUP BY 1, 2""")
def h10(spark, sf):
    days = base(spark, sf, "events").groupBy(period_start("ts", "day").alias("day"), "event_type").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum((F.col("value") > 50).cast("double")).alias("k"))
    return rounded(days.select("day", "event_type", tails.binomial_p("k", "n", F.lit(0.37)).alias("p_value")))


@C.add("h11_beta_binomial", f"""
WITH d AS (SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, count(*) FILTER (value > 50) AS k FROM events GROUP BY 1, 2),
h AS (SELECT day, event_type, n, k, sum(k) OVER w AS hk, sum(n) OVER w AS hn, list({{'k': k, 'n': n}}) OVER w AS hist FROM d
 WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)),
a AS (SELECT *, least(greatest((hk + 0.5::DOUBLE) / (hn + 1), 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS mu FROM h WHERE hn > 0),
b AS (SELECT *, list_sum(list_transform(hist, lambda x: x.n / hn * (x.k / x.n - mu) ** 2)) AS seen, list_sum(list_transform(hist, lambda x: x.n / hn * mu * (1 - mu) / x.n)) AS samp FROM a),
c AS (SELECT *, least(greatest(CASE WHEN greatest(seen - samp, 0) > 1e-12 THEN 1 / least(greatest((seen - samp) / (mu * (1 - mu)), 1e-6), 0.5) - 1 ELSE hn + 1 END, 2), 200)::DOUBLE AS con FROM b),
e AS (SELECT day, event_type, k, n, greatest(mu * con, 0.5) AS al, greatest((1 - mu) * con, 0.5) AS be, unnest(range(0, n + 1)) AS j FROM c),
m AS (SELECT *, exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + lgamma(j + al) + lgamma(n - j + be) - lgamma(n + al + be) + lgamma(al + be) - lgamma(al) - lgamma(be)) AS pmf FROM e),
o AS (SELECT day, event_type, pmf AS ap FROM m WHERE j = k)
SELECT day, event_type, {r('least(sum(pmf) FILTER (pmf <= ap + 1e-12), 1.0)', 5, 'p_value')} FROM m JOIN o USING (day, event_type) GROUP BY 1, 2""")
def h11(spark, sf):
    days = _daily_events(spark, sf)
    past = W.partitionBy("event_type").orderBy("day").rowsBetween(-14, -1)
    rows = days.withColumns({"hk": F.collect_list("k").over(past), "hn": F.collect_list("n").over(past)}).where("size(hk) > 0")
    rows = det.beta_prior(rows, "hk", "hn", "a", "b")
    return rounded(rows.select("day", "event_type", tails.beta_binomial_p("k", "n", "a", "b").alias("p_value")), 5)


def _daily_events(spark, sf):
    return base(spark, sf, "events").groupBy(period_start("ts", "day").alias("day"), "event_type").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum((F.col("value") > 50).cast("double")).alias("k"))


@C.add("h12_count_predictive", f"""
WITH d AS (SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2),
h AS (SELECT day, event_type, n, avg(n) OVER w AS mu, var_samp(n) OVER w AS va, count(*) OVER w AS c FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)),
a AS (SELECT *, CASE WHEN c < 2 THEN mu ELSE va END AS v FROM h WHERE c > 0),
b AS (SELECT *, v > mu + greatest(1e-9, 0.05 * mu) AS over, mu * mu / nullif(v - mu, 0) AS sh FROM a),
e AS (SELECT *, unnest(range(0, CAST(greatest(n, ceil(mu + 10 * sqrt(CASE WHEN over THEN v ELSE mu END))) AS BIGINT) + 1)) AS j FROM b),
m AS (SELECT *, exp(CASE WHEN over THEN lgamma(j + sh) - lgamma(sh) - lgamma(j + 1) + sh * ln(sh / (sh + mu)) + j * ln(1 - sh / (sh + mu)) ELSE j * ln(mu) - mu - lgamma(j + 1) END) AS pmf FROM e),
o AS (SELECT day, event_type, pmf AS ap FROM m WHERE j = n)
SELECT day, event_type, CASE WHEN bool_or(over) THEN 'negative-binomial' ELSE 'poisson' END AS distribution_name, {r('least(sum(pmf) FILTER (pmf <= ap + 1e-12), 1.0)', 5, 'p_value')} FROM m JOIN o USING (day, event_type) GROUP BY 1, 2""")
def h12(spark, sf):
    past = W.partitionBy("event_type").orderBy("day").rowsBetween(-14, -1)
    rows = _daily_events(spark, sf).withColumn("h", F.collect_list("n").over(past)).where("size(h) > 0")
    rows = det.count_law(rows, "h", "mean", "shape")
    return rounded(rows.select("day", "event_type", det.count_family(F.col("n"), "mean", "shape").alias("distribution_name"), det.count_p_value(F.col("n"), "mean", "shape").alias("p_value")), 5)


@C.add("h13_log_student_t")
def h13(spark, sf):
    days = base(spark, sf, "events").groupBy(period_start("ts", "day").alias("day"), "event_type").agg(F.sum("value").alias("v"))
    past = W.partitionBy("event_type").orderBy("day").rowsBetween(-14, -1)
    rows = days.withColumn("h", F.collect_list("v").over(past)).where("size(h) > 0")
    return det.log_t_p_value(rows, F.col("v"), "h", "p_value").select("day", "event_type", "p_value")


@C.add("h14_distribution_router", SCORE_SQL + """
SELECT metric_name, CASE WHEN NOT is_eligible THEN 'unavailable' WHEN metric_type = 'ratio' AND numerator IS NOT NULL AND denominator IS NOT NULL THEN 'empirical-beta-binomial'
 WHEN metric_type = 'count' THEN 'count' WHEN metric_type IN ('currency', 'duration') THEN 'robust-log-student-t' ELSE 'robust-student-t' END AS family, count(*) AS n FROM m_scored GROUP BY 1, 2""")
def h14(spark, sf):
    rows = det.predictive(det.baselines(series(spark, sf), CONFIG))
    family = F.when(F.col("distribution_name").isin("poisson", "negative-binomial", "degenerate-count"), "count").otherwise(F.col("distribution_name"))
    return rows.groupBy("metric_name", family.alias("family")).agg(F.count(F.lit(1)).alias("n"))


@C.add("h15_h16_eligibility", SCORE_SQL + f"SELECT {_KEY}, is_eligible, points >= need AS history_gate_passed, sample_size >= {_SAMPLE} AS sample_size_gate_passed FROM m_scored")
def h15(spark, sf):
    return scored(spark, sf).select(*_KEYS, "is_eligible", "history_gate_passed", "sample_size_gate_passed")


# Step recursion in SQL: one row at a time along each series.
CUSUM_SQL = SCORE_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """,
el AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY period_start) AS i FROM m_scored WHERE is_eligible),
walk AS (SELECT sid, i, period_start, greatest(0, robust_z - 0.5) AS cp, greatest(0, -robust_z - 0.5) AS cn, greatest(0, 1.5 * robust_z - 1.125) AS sp, greatest(0, -1.5 * robust_z - 1.125) AS sn,
  period_start AS bp, period_start AS bn FROM el WHERE i = 1
 UNION ALL SELECT e.sid, e.i, e.period_start, greatest(0, w.cp + e.robust_z - 0.5), greatest(0, w.cn - e.robust_z - 0.5), greatest(0, w.sp + 1.5 * e.robust_z - 1.125), greatest(0, w.sn - 1.5 * e.robust_z - 1.125),
  CASE WHEN w.cp <= 0 THEN e.period_start ELSE w.bp END, CASE WHEN w.cn <= 0 THEN e.period_start ELSE w.bn END
  FROM walk w JOIN el e ON e.sid = w.sid AND e.i = w.i + 1),
m_walk AS (SELECT *, greatest(cp, cn) AS c, greatest(sp, sn) AS s, COALESCE(lag(greatest(cp, cn) >= 4.5) OVER q, FALSE) AS pc, COALESCE(lag(greatest(sp, sn) >= ln(99)) OVER q, FALSE) AS ps
 FROM walk WINDOW q AS (PARTITION BY sid ORDER BY i))
"""


@C.add("h17_cusum", CUSUM_SQL + f"""
SELECT {', '.join('f.' + k for k in _KEYS)}, {r('COALESCE(c, 0)', 4, 'cusum_score')}, COALESCE(c >= 4.5 AND NOT pc, FALSE) AS change_detected,
 CASE WHEN c >= 4.5 THEN CASE WHEN cp >= cn THEN bp ELSE bn END END AS estimated_change_start FROM m_scored f LEFT JOIN m_walk w ON w.sid = f.sid AND w.period_start = f.period_start""")
def h17(spark, sf):
    return rounded(scored(spark, sf).select(*_KEYS, "cusum_score", "change_detected", "estimated_change_start"), 4)


@C.add("h18_sequential", CUSUM_SQL + f"""
SELECT {', '.join('f.' + k for k in _KEYS)}, {r('COALESCE(s, 0)', 4, 'sequential_log_likelihood')}, COALESCE(s >= ln(99) AND NOT ps, FALSE) AS sequential_alert
FROM m_scored f LEFT JOIN m_walk w ON w.sid = f.sid AND w.period_start = f.period_start""")
def h18(spark, sf):
    return rounded(scored(spark, sf).select(*_KEYS, "sequential_log_likelihood", "sequential_alert"), 4)


@C.add("h19_bh_fdr", f"""
WITH x AS (SELECT o_orderkey, o_orderpriority, (o_totalprice / 5e5) ** 3 AS p FROM orders),
y AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY p, o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS m FROM x)
SELECT o_orderkey, {r('least(1, greatest(p, min(p * m / k) OVER (PARTITION BY o_orderpriority ORDER BY p, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)))', 6, 'q_value')} FROM y""")
def h19(spark, sf):
    rows = base(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.pow(F.col("o_totalprice") / F.lit(5e5), F.lit(3.0)).alias("p"))
    return rounded(det.bh_fdr(rows, ["o_orderpriority"], "p").select("o_orderkey", "q_value"))


@C.add("h20_h24_alerts")
def h20(spark, sf):
    return detected(spark, sf)


# Events from any flagged points: days where a type is above 1.15 times its mean.
_FLAG_SQL = """WITH d AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS period_start, date_trunc('hour', ts) + INTERVAL '1' HOUR AS period_end, count(*) AS n FROM events GROUP BY 1, 2),
f AS (SELECT * FROM d WHERE n >= 4),
g AS (SELECT *, sum(CASE WHEN prev IS NULL OR period_start > prev THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY period_start) AS island FROM (SELECT *, lag(period_end) OVER (PARTITION BY series_id ORDER BY period_start) AS prev FROM f))
"""


def _flagged(spark, sf):
    at = period_start("ts", "hour")
    hours = base(spark, sf, "events").groupBy(F.col("event_type").alias("series_id"), at.alias("period_start")).agg(F.count(F.lit(1)).alias("n"))
    return hours.where("n >= 4").withColumn("period_end", F.col("period_start") + F.expr("INTERVAL '1' HOUR"))


@C.add("h25_event_islands", _FLAG_SQL + "SELECT series_id, CAST(island AS BIGINT) AS island, min(period_start) AS started_at, max(period_end) AS ended_at, count(*) AS points FROM g GROUP BY 1, 2")
def h25(spark, sf):
    return det.islands(_flagged(spark, sf)).groupBy("series_id", "island").agg(
        F.min("period_start").alias("started_at"), F.max("period_end").alias("ended_at"), F.count(F.lit(1)).alias("points"))


@C.add("h26_event_peaks", _FLAG_SQL + "SELECT series_id, min(period_start) AS started_at, arg_max(period_start, (n, -epoch(period_start))) AS peak_at, max(n) AS peak FROM g GROUP BY series_id, island")
def h26(spark, sf):
    from tidemark.functions.columns import micros

    rows = det.islands(_flagged(spark, sf))
    return rows.groupBy("series_id", "island").agg(
        F.min("period_start").alias("started_at"), F.max_by("period_start", F.struct(F.col("n"), -micros("period_start"))).alias("peak_at"), F.max("n").alias("peak")).drop("island")


@C.add("h26_anomaly_events")
def h26b(spark, sf):
    return det.anomaly_events(detected(spark, sf)).orderBy("started_at", "event_id")


@C.add("h27_change_points", CUSUM_SQL + f"""
SELECT metric_name, cohort_name, region, w.period_start + CASE time_grain WHEN 'hour' THEN INTERVAL '1' HOUR ELSE INTERVAL '1' DAY END AS detected_at, {r('c', 4, 'cusum_score')}
FROM m_walk w JOIN m_scored f USING (sid, period_start) WHERE c >= 4.5 AND NOT pc""")
def h27(spark, sf):
    rows = scored(spark, sf).withColumns({
        "period_end": F.when(F.col("time_grain") == "hour", F.col("period_start") + F.expr("INTERVAL '1' HOUR")).otherwise(F.col("period_start") + F.expr("INTERVAL '1' DAY")),
        "direction": det.direction(F.col("residual")), "scenario_id": F.lit(None).cast("string"),
        **{d: F.lit(None).cast("string") for d in det.DIMENSIONS if d != "region"},
    })
    return rounded(det.change_points(rows).select("metric_name", "cohort_name", "region", "detected_at", "cusum_score"), 4)


def _events(spark, sf):
    return shared(spark, sf, "events", lambda: det.anomaly_events(detected(spark, sf)))


@C.add("h28_benchmark_results")
def h28(spark, sf):
    return det.benchmark_results(truth(spark, sf), detected(spark, sf), _events(spark, sf))


def benchmark(spark, sf):
    return shared(spark, sf, "benchmark", lambda: det.benchmark_results(truth(spark, sf), detected(spark, sf), _events(spark, sf)))


@C.add("h29_benchmark_summary")
def h29(spark, sf):
    return det.benchmark_summary(benchmark(spark, sf), detected(spark, sf))


def detection_checks(spark, sf):
    def build():
        zero = detected(spark, sf).agg((F.count(F.lit(1)) * 0).alias("errors"))
        results = benchmark(spark, sf)
        return det.detection_quality(detected(spark, sf), _events(spark, sf), truth(spark, sf), results, det.benchmark_summary(results, detected(spark, sf)), zero)

    return shared(spark, sf, "detection-checks", build)


@C.add("h30_detection_quality", """SELECT unnest(['source.analytics_quality', 'observations.primary_key', 'observations.probability_bounds', 'baseline.no_lookahead', 'alerts.policy_invariants',
 'events.temporal_integrity', 'benchmark.ground_truth', 'benchmark.results', 'benchmark.summary', 'observations.finite_values']) AS check_name, 'pass' AS status""")
def h30(spark, sf):
    return detection_checks(spark, sf).select("check_name", "status")


@C.add("h31_explanation_mismatches")
def h31(spark, sf):
    found = det.explanation_mismatches(detected(spark, sf), CONFIG)
    return detected(spark, sf).join(found, "observation_id", "left").groupBy("metric_name").agg(
        F.count(F.lit(1)).alias("observations"), F.sum(F.col("columns").isNotNull().cast("bigint")).alias("mismatches"))
