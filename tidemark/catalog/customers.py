"""Queries for section I (customer impact, survival, causal estimates)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.catalog.common import Catalog, base, oracle_prelude, r, rounded, shared, tables_of
from tidemark.functions.columns import keyed_uniform
from tidemark.operators import causal, impact, survival
from tidemark.plans.config import ImpactConfig, Incident

C = Catalog()
CONFIG = ImpactConfig(
    "checkout-outage-impact",
    Incident("checkout-outage", "checkout_failure", datetime(2024, 1, 20), datetime(2024, 1, 23), region="ASIA"),
    pre_period_days=19, churn_horizon_days=35, effect_delay_days=9, bootstrap_samples=100, placebo_shift_days=8,
)
LO, T0, T1, HI = "TIMESTAMP '2024-01-01'", "TIMESTAMP '2024-01-20'", "TIMESTAMP '2024-01-23'", "TIMESTAMP '2024-02-27'"


def features(spark, sf):
    return shared(spark, sf, "customer-features", lambda: impact.customer_features(tables_of(spark, sf), CONFIG))


FEATURE_SQL = oracle_prelude("customers", "orders", "checkout_sessions", "payment_attempts", "shipments", "returns", "refunds", "order_items", "products") + f""",
ex AS (SELECT customer_id, count(*) AS n FROM s_checkout_sessions WHERE started_at >= {T0} AND started_at < {T1} AND region = 'ASIA' GROUP BY 1),
pre AS (SELECT customer_id, count(*) AS n, sum(total_amount) AS spend, avg(total_amount) AS aov, sum(discount_amount) AS disc, sum(subtotal) AS sub, max(ordered_at) AS last FROM s_orders WHERE ordered_at >= {LO} AND ordered_at < {T0} GROUP BY 1),
post AS (SELECT customer_id, count(*) AS n, min(ordered_at) AS nxt FROM s_orders WHERE ordered_at >= {T1} AND ordered_at < {HI} GROUP BY 1),
fc AS (SELECT customer_id, count(*) AS n FROM s_checkout_sessions WHERE started_at >= {LO} AND started_at < {T0} AND completed_at IS NULL GROUP BY 1),
dc AS (SELECT customer_id, count(*) AS n FROM s_payment_attempts WHERE attempted_at >= {LO} AND attempted_at < {T0} AND NOT approved GROUP BY 1),
lt AS (SELECT customer_id, count(*) AS n FROM s_shipments JOIN s_orders USING (order_id) WHERE promised_delivery_at < {T0} AND late GROUP BY 1),
rt AS (SELECT customer_id, count(*) AS n FROM s_returns WHERE requested_at < {T0} GROUP BY 1),
rf AS (SELECT r.customer_id, count(*) AS n FROM s_refunds f JOIN s_returns r USING (return_id) WHERE f.initiated_at < {T0} GROUP BY 1),
dv AS (SELECT o.customer_id, count(DISTINCT p.category) AS n FROM s_order_items i JOIN s_orders o USING (order_id) JOIN s_products p ON p.product_id = i.product_id WHERE o.ordered_at >= {LO} AND o.ordered_at < {T0} GROUP BY 1),
b AS (SELECT c.customer_id, {T1} AS index_at, home_region, customer_segment, COALESCE(ex.n, 0) >= 1 AS exposed, COALESCE(ex.n, 0) AS exposure_interactions,
 greatest(0, epoch({T0} - created_at) / 86400.0::DOUBLE) AS tenure_days, COALESCE(epoch({T0} - pre.last) / 86400.0::DOUBLE, 19) AS recency_days,
 COALESCE(pre.n, 0) AS pre_orders, COALESCE(post.n, 0) AS post_orders, COALESCE(spend, 0) AS pre_spend, COALESCE(aov, 0) AS average_order_value,
 COALESCE(pre.n, 0) / 19.0::DOUBLE * 30 AS order_frequency_30d, COALESCE(pre.n, 0) / 19.0::DOUBLE AS pre_purchase_rate, COALESCE(post.n, 0) / 35.0::DOUBLE AS post_purchase_rate,
 COALESCE(fc.n, 0) AS failed_checkout_count, COALESCE(dc.n, 0) AS payment_decline_count, COALESCE(lt.n, 0) AS late_delivery_count, COALESCE(rt.n, 0) AS return_count, COALESCE(rf.n, 0) AS refund_count,
 CASE WHEN sub > 0 THEN disc / sub ELSE 0 END AS discount_share, COALESCE(dv.n, 0) AS category_diversity, COALESCE(spend, 0) / 19 * 180 AS baseline_ltv,
 least(COALESCE(epoch(nxt - {T1}) / 86400.0::DOUBLE, 35), 35) AS control_event_days, nxt IS NULL AS control_churned,
 CAST('0x' || substr(sha256('{CONFIG.effect_seed}:' || c.customer_id), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
 FROM s_customers c LEFT JOIN ex USING (customer_id) LEFT JOIN pre USING (customer_id) LEFT JOIN post USING (customer_id) LEFT JOIN fc USING (customer_id) LEFT JOIN dc USING (customer_id)
 LEFT JOIN lt USING (customer_id) LEFT JOIN rt USING (customer_id) LEFT JOIN rf USING (customer_id) LEFT JOIN dv USING (customer_id)),
d AS (SELECT *, CASE WHEN exposed AND u < 0.18 THEN 35 WHEN exposed AND NOT control_churned THEN least(35, control_event_days + 9) ELSE control_event_days END AS treated_event_days FROM b),
m_features AS MATERIALIZED (SELECT * EXCLUDE (u), CASE WHEN exposed AND u < 0.18 THEN TRUE WHEN exposed AND NOT control_churned THEN treated_event_days >= 35 ELSE control_churned END AS treated_churned,
 treated_event_days AS observed_event_days, exposed AS benchmark_effect_applied,
 CASE WHEN exposed AND u < 0.18 THEN TRUE WHEN exposed AND NOT control_churned THEN treated_event_days >= 35 ELSE control_churned END AS churned,
 NOT CASE WHEN exposed AND u < 0.18 THEN TRUE WHEN exposed AND NOT control_churned THEN treated_event_days >= 35 ELSE control_churned END AS event_observed FROM d)
"""
_DOUBLES = ("tenure_days", "recency_days", "pre_spend", "average_order_value", "order_frequency_30d", "pre_purchase_rate", "post_purchase_rate", "discount_share",
            "baseline_ltv", "control_event_days", "treated_event_days", "observed_event_days")


@C.add("i1_exposure", FEATURE_SQL + f"""
SELECT 'checkout_failure' AS family, count(*) FILTER (completed_at IS NULL) AS failures, {r('sum(expected_amount) FILTER (completed_at IS NULL)', 2, 'loss')} FROM s_checkout_sessions WHERE started_at >= {T0} AND started_at < {T1} AND region = 'ASIA'
UNION ALL SELECT 'payment_decline', count(*) FILTER (NOT approved), {r('sum(amount) FILTER (NOT approved)', 2, 'loss')} FROM s_payment_attempts WHERE attempted_at >= {T0} AND attempted_at < {T1}
UNION ALL SELECT 'late_delivery', count(*) FILTER (late), {r('sum(total_amount) FILTER (late)', 2, 'loss')} FROM s_shipments JOIN s_orders USING (order_id) WHERE promised_delivery_at >= {T0} AND promised_delivery_at < {T1}
UNION ALL SELECT 'refund_delay', count(*) FILTER (completed_at IS NULL), {r('COALESCE(sum(amount) FILTER (completed_at IS NULL), 0)', 2, 'loss')} FROM s_refunds WHERE initiated_at >= {T0} AND initiated_at < {T1}""")
def i1(spark, sf):
    from dataclasses import replace
    from functools import reduce

    tables = tables_of(spark, sf)
    parts = []
    for family in ("checkout_failure", "payment_decline", "late_delivery", "refund_delay"):
        incident = replace(CONFIG.incident, family=family)
        parts.append(impact.immediate_loss(tables, incident).select(F.lit(family).alias("family"), "failures", "loss"))
    return rounded(reduce(lambda a, b: a.unionByName(b), parts), 2)


@C.add("i2_i9_customer_features", FEATURE_SQL + f"SELECT * REPLACE ({', '.join(r(c, 4) for c in _DOUBLES)}) FROM m_features")
def i2(spark, sf):
    return rounded(features(spark, sf), 4)


@C.add("i8_keyed_uniform", """SELECT doc_id, CAST('0x' || substr(sha256('7:' || doc_id), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM labels""")
def i8(spark, sf):
    return base(spark, sf, "labels").select("doc_id", keyed_uniform("doc_id", 7).alias("u"))


_STD = ("tenure_days", "pre_spend", "return_count")


@C.add("i10_standardize", FEATURE_SQL + "SELECT customer_id, " + ", ".join(r(f"({c} - (SELECT avg({c}) FROM m_features)) / (SELECT stddev_pop({c}) FROM m_features)", 5, c) for c in _STD) + " FROM m_features")
def i10(spark, sf):
    return rounded(causal.standardize(features(spark, sf).select("customer_id", *_STD), _STD), 5)


@C.add("i11_kaplan_meier", FEATURE_SQL + f""", g AS (SELECT CASE WHEN exposed THEN 'exposed' ELSE 'control' END AS grp, observed_event_days AS t, event_observed AS e FROM m_features UNION ALL SELECT 'overall', observed_event_days, event_observed FROM m_features),
n AS (SELECT grp, t, count(*) AS n, count(*) FILTER (e) AS d FROM g GROUP BY 1, 2),
k AS (SELECT *, sum(n) OVER (PARTITION BY grp ORDER BY t DESC) AS at_risk FROM n),
s AS (SELECT *, product(1 - d / at_risk) OVER w AS surv, sum(CASE WHEN d > 0 AND at_risk > d THEN d / (at_risk * (at_risk - d)) ELSE 0 END) OVER w AS gw FROM k WINDOW w AS (PARTITION BY grp ORDER BY t))
SELECT grp AS "group", {r('t', 6, 'time_days')}, CAST(at_risk AS BIGINT) AS at_risk, CAST(d AS BIGINT) AS events, CAST(n - d AS BIGINT) AS censored, {r('surv', 6, 'survival_probability')},
 {r('greatest(0, surv - 1.959963984540054::DOUBLE * surv * sqrt(gw))', 6, 'lower_ci')}, {r('least(1, surv + 1.959963984540054::DOUBLE * surv * sqrt(gw))', 6, 'upper_ci')} FROM s""")
def i11(spark, sf):
    rows = features(spark, sf).withColumn("arm", F.when(F.col("exposed"), "exposed").otherwise("control"))
    rows = survival.with_overall(rows.select("arm", "observed_event_days", "event_observed"), "arm")
    return rounded(survival.kaplan_meier(rows, "observed_event_days", "event_observed", "arm", CONFIG.confidence_level))


def scored(spark, sf):
    def build():
        standard = causal.standardize(features(spark, sf), impact.PROPENSITY_FEATURES)
        with_score, converged = causal.propensity(standard, impact.PROPENSITY_FEATURES)
        weighted = causal.iptw(with_score.select("customer_id", "propensity_score"
                               ).join(features(spark, sf), "customer_id"), CONFIG.propensity_clip)
        return weighted.withColumn("propensity_converged", F.lit(float(converged)))

    return shared(spark, sf, "scored-customers", build)


@C.add("i12_propensity")
def i12(spark, sf):
    return scored(spark, sf).select("customer_id", "exposed", "propensity_score")


_SCORE = "(0.05::DOUBLE + 0.9::DOUBLE * (tenure_days / 400))"
_W = f"CASE WHEN exposed THEN (SELECT avg(exposed::INT) FROM m_features) / least(greatest({_SCORE}, 0.02), 0.98) ELSE (1 - (SELECT avg(exposed::INT) FROM m_features)) / (1 - least(greatest({_SCORE}, 0.02), 0.98)) END"


def _hand_weighted(spark, sf):
    """Weights from a score that plain SQL can repeat."""
    return causal.iptw(features(spark, sf).withColumn("propensity_score", 0.05 + 0.9 * (F.col("tenure_days") / 400)), 0.02)


@C.add("i13_iptw", FEATURE_SQL + f"SELECT customer_id, {r(_W, 6, 'stabilized_weight')} FROM m_features")
def i13(spark, sf):
    return rounded(_hand_weighted(spark, sf).select("customer_id", "stabilized_weight"))


def pairs(spark, sf):
    return shared(spark, sf, "matched-pairs", lambda: causal.match_nearest(scored(spark, sf), CONFIG.propensity_caliper))


@C.add("i14_nearest_matching")
def i14(spark, sf):
    return causal.attach_matches(scored(spark, sf).select("customer_id", "exposed", "propensity_score", "stabilized_weight"), pairs(spark, sf))


def _smd_sql(c: str) -> str:
    mean = lambda side: f"(sum({c} * w) FILTER ({side}) / sum(w) FILTER ({side}))"
    var = lambda side: f"(sum({c} * {c} * w) FILTER ({side}) / sum(w) FILTER ({side}) - {mean(side)} ** 2)"
    return f"SELECT '{c}' AS feature, " + r(f"({mean('exposed')} - {mean('NOT exposed')}) / sqrt(({var('exposed')} + {var('NOT exposed')}) / 2)", 5, "smd") + " FROM wt"


@C.add("i15_smd", FEATURE_SQL + f", wt AS (SELECT *, {_W} AS w FROM m_features) " + " UNION ALL ".join(_smd_sql(c) for c in ("tenure_days", "pre_orders", "average_order_value")))
def i15(spark, sf):
    return rounded(causal.smd(_hand_weighted(spark, sf), ["tenure_days", "pre_orders", "average_order_value"], "stabilized_weight"), 5)


@C.add("i16_i17_effects", FEATURE_SQL + f""", wt AS (SELECT *, {_W} AS w, churned::INT AS y FROM m_features)
SELECT {r('sum(y * w) FILTER (exposed) / sum(w) FILTER (exposed) - sum(y * w) FILTER (NOT exposed) / sum(w) FILTER (NOT exposed)', 6, 'weighted_ate')},
 {r('avg(y) FILTER (exposed) - avg(y) FILTER (NOT exposed)', 6, 'naive')} FROM wt""")
def i16(spark, sf):
    y, arm = F.col("churned").cast("double"), F.col("exposed")
    return rounded(_hand_weighted(spark, sf).agg(impact.weighted_ate("churned", "stabilized_weight").alias("weighted_ate"),
                                                 (F.avg(F.when(arm, y)) - F.avg(F.when(~arm, y))).alias("naive")))


@C.add("i18_difference_in_differences", FEATURE_SQL + f"SELECT {r('avg(post_purchase_rate - pre_purchase_rate) FILTER (exposed) - avg(post_purchase_rate - pre_purchase_rate) FILTER (NOT exposed)', 6, 'estimate')} FROM m_features")
def i18(spark, sf):
    return rounded(causal.difference_in_differences(features(spark, sf)))


def _estimates(spark, sf):
    table, reps = causal.causal_estimates(scored(spark, sf), pairs(spark, sf), placebo(spark, sf), CONFIG)
    return table, reps


@C.add("i19_causal_estimates")
def i19(spark, sf):
    return estimates(spark, sf)


def estimates(spark, sf):
    return shared(spark, sf, "causal-estimates", lambda: _estimates(spark, sf)[0])


def replicates(spark, sf):
    return shared(spark, sf, "effect-replicates", lambda: _estimates(spark, sf)[1])


def _placebo_frame(spark, sf):
    exposure = impact.exposure(tables_of(spark, sf), CONFIG.incident.shifted(CONFIG.placebo_shift_days))
    rows = features(spark, sf).select("customer_id", "control_churned").join(exposure, "customer_id", "left")
    return causal.mean_difference(rows.withColumn("touched", F.coalesce(F.col("exposure_interactions") >= 1, F.lit(False))), "control_churned", "touched")


def placebo(spark, sf):
    return _placebo_frame(spark, sf).first()["estimate"]


@C.add("i20_placebo", FEATURE_SQL + f""", px AS (SELECT DISTINCT customer_id FROM s_checkout_sessions WHERE started_at >= {T0} - INTERVAL 8 DAY AND started_at < {T1} - INTERVAL 8 DAY AND region = 'ASIA')
SELECT {r('avg(control_churned::INT) FILTER (px.customer_id IS NOT NULL) - avg(control_churned::INT) FILTER (px.customer_id IS NULL)', 6, 'estimate')} FROM m_features f LEFT JOIN px USING (customer_id)""")
def i20(spark, sf):
    return rounded(_placebo_frame(spark, sf))


_FIT: dict = {}


def cox(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FIT:
        data = causal.standardize(features(spark, sf), impact.COX_FEATURES)
        _FIT[key] = (data, survival.fit_cox(data, impact.COX_FEATURES, "observed_event_days", "event_observed"))
    return _FIT[key]


@C.add("i21_cox_coefficients")
def i21(spark, sf):
    return cox(spark, sf)[1].table(spark, CONFIG.confidence_level)


@C.add("i22_baseline_hazard")
def i22(spark, sf):
    data, fit = cox(spark, sf)
    return survival.baseline_hazard(data, fit, "observed_event_days", "event_observed")


@C.add("i23_concordance", FEATURE_SQL + f"""
SELECT CAST(count(*) AS DOUBLE) AS comparable, {r('avg(CASE WHEN a.recency_days > b.recency_days THEN 1.0 WHEN a.recency_days = b.recency_days THEN 0.5 ELSE 0.0 END)', 6, 'c_index')}
FROM m_features a JOIN m_features b ON a.event_observed AND a.observed_event_days < b.observed_event_days""")
def i23(spark, sf):
    return rounded(survival.concordance(features(spark, sf), "observed_event_days", "event_observed", "recency_days"))


@C.add("i24_brier", FEATURE_SQL + f"SELECT {r('avg((churned::INT - pre_purchase_rate) ** 2)', 6, 'brier_score')} FROM m_features")
def i24(spark, sf):
    return rounded(survival.brier(features(spark, sf), "churned", "pre_purchase_rate"))


@C.add("i25_segment_impact", FEATURE_SQL + f""", wt AS (SELECT *, {_W} AS w, churned::INT AS y FROM m_features),
u AS (SELECT 'home_region' AS segment_name, home_region AS segment_value, * FROM wt UNION ALL SELECT 'customer_segment', customer_segment, * FROM wt),
g AS (SELECT segment_name, segment_value, count(*) AS customers, count(*) FILTER (exposed) AS exposed_customers, avg(y) AS observed_churn_rate,
 COALESCE(sum(y * w) FILTER (exposed) / sum(w) FILTER (exposed) - sum(y * w) FILTER (NOT exposed) / sum(w) FILTER (NOT exposed), 0) AS weighted_incremental_churn,
 COALESCE(avg(baseline_ltv) FILTER (exposed), 0) AS ltv FROM u GROUP BY 1, 2)
SELECT segment_name, segment_value, customers, exposed_customers, {r('observed_churn_rate', 5)}, {r('weighted_incremental_churn', 5)}, {r('greatest(weighted_incremental_churn, 0) * exposed_customers * ltv', 2, 'revenue_at_risk')} FROM g""")
def i25(spark, sf):
    weighted = _hand_weighted(spark, sf)
    out = impact.segment_impact(features(spark, sf), weighted)
    return rounded(rounded(out, 5, ("observed_churn_rate", "weighted_incremental_churn")), 2, ("revenue_at_risk",))


def financial(spark, sf):
    def build():
        effect = estimates(spark, sf).where("estimator = 'stabilized_iptw'").first()["estimate"]
        loss = impact.immediate_loss(tables_of(spark, sf), CONFIG.incident)
        return impact.financial_impact(features(spark, sf), loss, effect, replicates(spark, sf), CONFIG)

    return shared(spark, sf, "financial", build)


@C.add("i26_financial_impact")
def i26(spark, sf):
    return financial(spark, sf)


@C.add("i27_true_att", FEATURE_SQL + f"SELECT {r('avg(treated_churned::INT - control_churned::INT) FILTER (exposed)', 6, 'true_att')} FROM m_features")
def i27(spark, sf):
    return rounded(impact.true_att(features(spark, sf)))


def model_metrics(spark, sf):
    def build():
        data, fit = cox(spark, sf)
        hazard = survival.baseline_hazard(data, fit, "observed_event_days", "event_observed")
        predicted = survival.survival_at(data.withColumn("risk", survival.linear(fit.features, fit.coefficients)), fit, hazard, float(CONFIG.churn_horizon_days), "p")
        c_index = survival.concordance(predicted, "observed_event_days", "event_observed", "risk").first()["c_index"]
        brier = survival.brier(predicted, "churned", "p").first()["brier_score"]
        rows = scored(spark, sf)
        after = causal.smd(rows, impact.PROPENSITY_FEATURES, "stabilized_weight").agg(F.max(F.abs("smd"))).first()[0]
        before = causal.smd(rows, impact.PROPENSITY_FEATURES).agg(F.max(F.abs("smd"))).first()[0]
        att = impact.true_att(rows).first()["true_att"]
        arms = rows.where("exposed").count()
        est = estimates(spark, sf).where("estimator = 'stabilized_iptw'").first()["estimate"]
        listed = [("cox_ph", "c_index", c_index), ("cox_ph", "brier_score", brier), ("cox_ph", "converged", float(fit.converged)), ("propensity", "converged", rows.agg(F.min("propensity_converged")).first()[0]),
                  ("propensity", "max_abs_smd_before", before), ("propensity", "max_abs_smd_after", after), ("propensity", "matched_exposure_share", pairs(spark, sf).count() / max(arms, 1)),
                  ("benchmark", "true_att", att), ("sensitivity", "bias_to_null", abs(est)), ("placebo", "absolute_estimate", abs(placebo(spark, sf) or 0.0))]
        return spark.createDataFrame(listed, "model string, metric string, value double")

    return shared(spark, sf, "model-metrics", build)


@C.add("i28_impact_quality")
def i28(spark, sf):
    return impact_checks(spark, sf)


def impact_checks(spark, sf):
    return shared(spark, sf, "impact-checks", lambda: impact.impact_quality(features(spark, sf), estimates(spark, sf), financial(spark, sf), model_metrics(spark, sf), CONFIG))


@C.add("i29_coverage_guard", FEATURE_SQL + "SELECT count(*) FILTER (exposed) AS treated, count(*) FILTER (NOT exposed) AS control FROM m_features")
def i29(spark, sf):
    impact.require_coverage(tables_of(spark, sf), features(spark, sf), CONFIG)
    return features(spark, sf).agg(F.sum(F.col("exposed").cast("bigint")).alias("treated"), F.sum((~F.col("exposed")).cast("bigint")).alias("control"))
