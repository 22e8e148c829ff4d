"""Queries for sections L (hypotheses), M (recovery) and N (prediction evaluation)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.catalog.common import Catalog, base, r, rounded, shared
from tidemark.catalog.cube import contribution_cube
from tidemark.functions.columns import period_start
from tidemark.operators import evaluation as ev
from tidemark.operators import hypotheses as hy
from tidemark.operators import recovery as rc
from tidemark.operators.causal import PRIME, poisson_limits
from tidemark.plans.config import RecoveryConfig, RecoveryPolicy

C = Catalog()

# ---------------------------------------------------------------------- L


def investigation(spark, sf):
    """Customers as investigations, order priorities as hypotheses, orders as evidence."""
    o = base(spark, sf, "orders")
    key = [F.col("o_custkey").cast("string").alias("investigation_id"), F.col("o_orderpriority").alias("hypothesis_id")]
    total = o.groupBy(key[0]).agg(F.count(F.lit(1)).alias("t"))
    hypotheses = o.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).join(total, "investigation_id").select("investigation_id", "hypothesis_id", (F.col("n") / F.col("t")).alias("prior_probability"))
    ratio = F.when(F.col("o_orderstatus") == "F", 2.0).when(F.col("o_orderstatus") == "O", 0.5).otherwise(1.5)
    evidence = o.select(*key, F.col("o_orderkey").cast("string").alias("evidence_record_id"), ratio.alias("likelihood_ratio"), F.when(F.col("o_orderstatus") == "O", "contradict").otherwise("support").alias("direction"))
    return hypotheses, evidence


L_SQL = """WITH e AS (SELECT CAST(o_custkey AS VARCHAR) AS investigation_id, o_orderpriority AS hypothesis_id, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 2.0 WHEN 'O' THEN 0.5 ELSE 1.5 END::DOUBLE AS lr, o_orderstatus = 'O' AS con FROM orders),
h AS (SELECT investigation_id, hypothesis_id, ln(count(*) / sum(count(*)) OVER (PARTITION BY investigation_id)) + sum(ln(lr)) AS score, count(*) FILTER (NOT con) AS sup, count(*) FILTER (con) AS con, count(*) AS refs FROM e GROUP BY 1, 2),
p AS (SELECT *, exp(score) / sum(exp(score)) OVER (PARTITION BY investigation_id) AS post FROM h),
k AS (SELECT *, row_number() OVER (PARTITION BY investigation_id ORDER BY round(post, 12) DESC, hypothesis_id) AS rk FROM p)
"""


def posteriors(spark, sf):
    h, e = investigation(spark, sf)
    return shared(spark, sf, "posteriors", lambda: hy.posteriors(h, e))


@C.add("l1_posteriors", L_SQL + f"SELECT investigation_id, hypothesis_id, {r('score', 6, 'log_evidence_score')}, {r('post', 6, 'posterior_probability')} FROM k")
def l1(spark, sf):
    return rounded(posteriors(spark, sf).select("investigation_id", "hypothesis_id", "log_evidence_score", "posterior_probability"))


# The same posteriors for investigations of any size: the softmax is shifted by the greatest score, evidence counts once by its id.
_DECISION_SQL = (
    L_SQL.replace("count(*) AS refs", "count(DISTINCT o_orderkey) AS refs")
    .replace("exp(score) / sum(exp(score)) OVER (PARTITION BY investigation_id)", "w / sum(w) OVER (PARTITION BY investigation_id)")
    .replace("AS post FROM h)", "AS post FROM (SELECT *, exp(score - max(score) OVER (PARTITION BY investigation_id)) AS w FROM h))")
)


@C.add("l2_l3_decisions", _DECISION_SQL + f""", d AS (SELECT investigation_id, CASE WHEN count(*) > 1 THEN COALESCE(-sum(post * ln(post)) FILTER (post > 0), 0) / ln(count(*)) ELSE 0 END AS ent, max(post) FILTER (rk = 1) AS top, COALESCE(max(post) FILTER (rk = 2), 0) AS second, max(refs) FILTER (rk = 1) AS refs FROM k GROUP BY 1)
SELECT investigation_id, {r('ent', 6, 'normalized_entropy')}, {r('top - second', 6, 'posterior_margin')}, {r('greatest(0, least(1, top * (1 - ent)))', 6, 'confidence')},
 CASE WHEN round(top, 12) >= 0.7::DOUBLE AND round(top - second, 12) >= 0.2::DOUBLE AND refs >= 2 AND round(ent, 12) <= 0.75::DOUBLE THEN 'concluded' ELSE 'abstained' END AS status FROM d""")
def l2(spark, sf):
    return rounded(hy.decide(posteriors(spark, sf)).select("investigation_id", "normalized_entropy", "posterior_margin", "confidence", "status"))


@C.add("l4_evidence_lists", L_SQL + "SELECT investigation_id, hypothesis_id, sup AS supporting, con AS contradicting FROM k")
def l4(spark, sf):
    rows = posteriors(spark, sf)
    return rows.select("investigation_id", "hypothesis_id", F.size("supporting_evidence_ids").cast("bigint").alias("supporting"), F.size("contradicting_evidence_ids").cast("bigint").alias("contradicting"))


@C.add("l5_proposal_issues", "SELECT 'evidence.unobserved' AS code, count(*) AS n FROM orders WHERE o_totalprice < 5000 UNION ALL SELECT 'ratio.bounds', count(*) FROM orders WHERE o_orderstatus = 'F'")
def l5(spark, sf):
    h, e = investigation(spark, sf)
    observed = base(spark, sf, "orders").where("NOT (o_totalprice < 5000)").select(F.col("o_orderkey").cast("string").alias("evidence_record_id"))
    found = hy.proposal_issues(h, e, observed, hy.DecisionPolicy(likelihood_ratio_max=1.9))
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@C.add("l6_report_metrics", L_SQL + f""", a AS (SELECT CAST(c_custkey AS VARCHAR) AS investigation_id, '1-URGENT' AS truth FROM customer),
c AS (SELECT k.investigation_id, COALESCE(min(rk) FILTER (hypothesis_id = truth), 0) AS place, sum((post - (hypothesis_id = truth)::INT) ** 2) + CASE WHEN bool_or(hypothesis_id = truth) THEN 0 ELSE 1 END AS brier FROM k JOIN a USING (investigation_id) GROUP BY 1)
SELECT count(*) AS case_count, {r('avg((place = 1)::INT)', 6, 'top1_accuracy')}, {r('avg((place BETWEEN 1 AND 3)::INT)', 6, 'top3_accuracy')}, {r('avg(brier)', 6, 'mean_brier_score')} FROM c""")
def l6(spark, sf):
    answers = base(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("investigation_id"), F.lit("1-URGENT").alias("true_hypothesis_id"), F.lit(True).alias("should_abstain"))
    _, e = investigation(spark, sf)
    rows = posteriors(spark, sf)
    return rounded(hy.report_metrics(rows, hy.decide(rows), answers, e).select("case_count", "top1_accuracy", "top3_accuracy", "mean_brier_score"))


# ---------------------------------------------------------------------- M

TYPES = ("error", "view", "signup", "purchase", "click")
EXECUTED, EVALUATED = datetime(2024, 1, 20), datetime(2024, 1, 31)
RECOVERY = RecoveryConfig("recovery", "checkout-outage", tuple(
    RecoveryPolicy(t, role="guardrail" if t == "view" else "primary", healthy_direction="lower_is_better" if t == "error" else "higher_is_better", baseline_lookback_periods=14, minimum_sample_size=1,
                   equivalence_margin_relative=0.15) for t in TYPES))


def points(spark, sf):
    days = base(spark, sf, "events").groupBy(F.col("event_type").alias("metric_id"), period_start("ts", "day").alias("observed_at")).agg(F.count(F.lit(1)).alias("sample_size"))
    return days.select("metric_id", F.lit("overall").alias("cohort"), "observed_at", F.col("sample_size").cast("double").alias("value"), "sample_size")


M_SQL = """WITH d AS (SELECT event_type AS metric_id, date_trunc('day', ts) AS at_, CAST(count(*) AS DOUBLE) AS v, date_trunc('day', ts) >= TIMESTAMP '2024-01-20' AS post FROM events GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY metric_id, post ORDER BY at_ DESC) AS k, row_number() OVER (PARTITION BY metric_id, post ORDER BY at_) AS i FROM d),
b AS (SELECT metric_id, median(v) AS c, avg(v) AS m, var_samp(v) AS s2, count(*) AS cnt FROM n WHERE NOT post AND k <= 14 GROUP BY 1),
mad AS (SELECT metric_id, greatest(1.4826::DOUBLE * median(abs(v - c)), 1e-9) AS scale FROM n JOIN b USING (metric_id) WHERE NOT post AND k <= 14 GROUP BY 1),
s AS (SELECT metric_id, median(v) AS latest, avg(v) AS m, var_samp(v) AS s2, count(*) AS cnt FROM n WHERE post AND k <= 3 GROUP BY 1),
x AS (SELECT b.metric_id, b.c, mad.scale, s.latest, greatest(abs(b.c) * 0.15, 1e-9) AS margin, s.m - b.m AS diff, sqrt(b.s2 / b.cnt + s.s2 / s.cnt) AS se FROM b JOIN mad USING (metric_id) JOIN s USING (metric_id))
"""


@C.add("m1_observation_set")
def m1(spark, sf):
    post = points(spark, sf).where(F.col("observed_at") >= F.lit(EXECUTED).cast("timestamp_ntz"))
    return rc.observation_set(contribution_cube(spark, sf).where("cohort_name = 'overall'"), post, EXECUTED)


@C.add("m2_m12_observation_rules", "SELECT 'observation.future' AS code, count(DISTINCT date_trunc('day', ts)) AS n FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-26' UNION ALL SELECT 'series.undeclared', 1")
def m2(spark, sf):
    rows = points(spark, sf).where("metric_id IN ('click')")
    extra = RecoveryConfig("r", "i", (RecoveryPolicy("view"),))
    return rc.observation_issues(rows, extra, EXECUTED, datetime(2024, 1, 25)).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def windows(spark, sf):
    return rc.recovery_windows(points(spark, sf), RECOVERY, EXECUTED, EVALUATED)


@C.add("m3_windows", M_SQL + "SELECT metric_id, count(*) FILTER (NOT post AND k <= 14) AS baseline, count(*) FILTER (post) AS post, count(*) FILTER (post AND k <= 3) AS sustain FROM n GROUP BY 1")
def m3(spark, sf):
    one = lambda c: F.sum(F.col(c).cast("bigint"))
    return windows(spark, sf).groupBy("metric_id").agg(one("in_baseline").alias("baseline"), one("in_post").alias("post"), one("in_sustain").alias("sustain"))


def evaluations(spark, sf):
    return shared(spark, sf, "recovery", lambda: rc.evaluate_metrics(windows(spark, sf), RECOVERY))


@C.add("m5_m8_centres_and_margins", M_SQL + f"""SELECT metric_id, {r('c', 6, 'baseline_center')}, {r('scale', 6, 'baseline_scale')}, {r('latest', 6, 'latest_center')}, {r('margin', 6, 'equivalence_margin')}, {r('(latest - c) / scale', 6, 'latest_robust_z')} FROM x""")
def m5(spark, sf):
    return rounded(evaluations(spark, sf).select("metric_id", "baseline_center", "baseline_scale", "latest_center", "equivalence_margin", "latest_robust_z"))


@C.add("m7_tost_statistics", M_SQL + f"SELECT metric_id, {r('(diff + margin) / se', 5, 'tost_lower_t')}, {r('(diff - margin) / se', 5, 'tost_upper_t')} FROM x")
def m7(spark, sf):
    return rounded(evaluations(spark, sf).select("metric_id", "tost_lower_t", "tost_upper_t"), 5)


@C.add("m9_theil_sen", M_SQL + f""", a AS (SELECT metric_id, i, CASE WHEN metric_id = 'error' THEN greatest(0, v - c) ELSE greatest(0, c - v) END AS y FROM n JOIN b USING (metric_id) WHERE post)
SELECT p.metric_id, {r('median((q.y - p.y) / (q.i - p.i))', 6, 'distance_slope')} FROM a p JOIN a q ON p.metric_id = q.metric_id AND p.i < q.i GROUP BY 1""")
def m9(spark, sf):
    return rounded(evaluations(spark, sf).select("metric_id", "distance_slope"))


@C.add("m4_m10_evaluations")
def m10(spark, sf):
    return evaluations(spark, sf)


@C.add("m11_decision")
def m11(spark, sf):
    return rc.recovery_decision(evaluations(spark, sf))


def reports(spark, sf):
    decision = F.when(F.col("o_orderstatus") == "F", "recovered").when(F.col("o_orderstatus") == "O", "failed").when(F.col("o_orderkey") % 2 == 1, "insufficient_data").otherwise("recovering")
    return base(spark, sf, "orders").select(
        F.col("o_custkey").alias("incident_id"), (F.col("o_orderdate") + F.make_dt_interval(secs=F.col("o_orderkey"))).alias("evaluated_at"), decision.alias("decision"), (F.col("o_totalprice") > 490000).alias("severe_guardrail_breach"))


LIFECYCLE_SQL = """WITH RECURSIVE x AS (SELECT o_custkey AS incident_id, o_orderdate + o_orderkey * INTERVAL '1' SECOND AS evaluated_at, CASE WHEN o_orderstatus = 'F' THEN 'recovered' WHEN o_orderstatus = 'O' THEN 'failed' WHEN o_orderkey % 2 = 1 THEN 'insufficient_data' ELSE 'recovering' END AS d, o_totalprice > 490000 AS sev FROM orders),
y AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY evaluated_at) AS g FROM x),
w AS (SELECT incident_id, evaluated_at, g, d, CASE WHEN d = 'recovered' THEN 'recovered' WHEN d = 'insufficient_data' THEN 'monitoring' WHEN sev THEN 'reopened' ELSE 'monitoring' END AS status, 0 AS fails, d = 'recovered' AS ever,
  CASE WHEN d = 'recovered' THEN 'recovery_verified' WHEN d = 'insufficient_data' THEN 'recovery_evidence_gap' WHEN sev THEN 'severe_guardrail_regression' ELSE 'recovery_not_yet_verified' END AS trig FROM y WHERE g = 1
 UNION ALL SELECT y.incident_id, y.evaluated_at, y.g, y.d,
  CASE WHEN w.status = 'reopened' THEN 'reopened' WHEN y.d = 'recovered' THEN 'recovered' WHEN y.d = 'insufficient_data' THEN CASE WHEN w.status = 'recovered' THEN 'recovered' ELSE 'monitoring' END WHEN y.sev OR (w.ever AND w.fails + 1 >= 2) THEN 'reopened' ELSE 'monitoring' END,
  CASE WHEN w.status = 'reopened' THEN w.fails WHEN y.d = 'recovered' THEN 0 WHEN y.d = 'insufficient_data' THEN w.fails WHEN w.ever THEN w.fails + 1 ELSE 0 END, w.ever OR y.d = 'recovered',
  CASE WHEN w.status = 'reopened' THEN 'incident_already_reopened' WHEN y.d = 'recovered' THEN 'recovery_verified' WHEN y.d = 'insufficient_data' THEN 'recovery_evidence_gap' WHEN y.sev THEN 'severe_guardrail_regression'
   WHEN w.ever AND w.fails + 1 >= 2 THEN 'sustained_recovery_regression' WHEN w.ever THEN 'regression_observed' ELSE 'recovery_not_yet_verified' END
  FROM w JOIN y ON y.incident_id = w.incident_id AND y.g = w.g + 1)
"""


def lifecycle(spark, sf):
    return shared(spark, sf, "lifecycle", lambda: rc.lifecycle(reports(spark, sf), RECOVERY))


@C.add("m13_lifecycle", LIFECYCLE_SQL + "SELECT incident_id, evaluated_at, g AS generation, status, CAST(fails AS BIGINT) AS consecutive_failed_evaluations, trig AS trigger FROM w")
def m13(spark, sf):
    return lifecycle(spark, sf).select("incident_id", "evaluated_at", "generation", "status", "consecutive_failed_evaluations", "trigger")


@C.add("m14_replay", "SELECT 'trigger' AS changed, count(*) AS n FROM orders WHERE o_totalprice > 490000")
def m14(spark, sf):
    stored = lifecycle(spark, sf).withColumn("trigger", F.when(F.col("severe_guardrail_breach"), "edited").otherwise(F.col("trigger")))
    bad = rc.replay_mismatches(stored, reports(spark, sf), RECOVERY)
    return bad.groupBy(F.array_join("columns", ",").alias("changed")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------- N

LABELS = tuple(f"H{i}" for i in range(5))


def run(spark, sf, salt: int = 0):
    """Cases, answers and predictions with one row per order."""
    o = base(spark, sf, "orders")
    k = F.col("o_orderkey")
    case = F.concat(F.lit("case-"), k.cast("string"))
    weights = [(1 + (k * (j + 3 + salt)) % 7).cast("double") for j in range(5)]
    total = sum(weights[1:], weights[0])
    scored = F.array(*(F.struct((-(w / total)).alias("p"), F.lit(label).alias("h")) for w, label in zip(weights, LABELS)))
    texts = lambda *c: F.array(*c).cast("array<string>")
    cases = o.select(case.alias("case_id"), F.concat(F.lit("Priority "), F.col("o_orderpriority"), F.lit(" Historical lineage notes")).alias("incident_input"),
                     texts(F.concat(F.lit("e"), (k % 3).cast("string")), F.lit("lineage-1")).alias("evidence_ids"), texts(F.lit("sql.query"), F.lit("historical_incidents.search")).alias("allowed_tools"))
    answers = o.select(case.alias("case_id"), F.concat(F.lit("H"), (F.col("o_custkey") % 5).cast("string")).alias("root_cause_id"), texts(F.when(k % 4 == 0, "H1").otherwise("none")).alias("acceptable_alternates"),
                       texts(F.lit("e1")).alias("required_evidence_ids"), texts(F.lit("bad-claim")).alias("prohibited_claims"), (k % 10 == 0).alias("should_abstain"), texts(F.lit("rollback"), F.lit("restart")).alias("allowed_remediation_classes"),
                       texts(F.lit("delete")).alias("prohibited_remediation_classes"), F.lit("recovered").alias("expected_recovery"), F.when(k % 2 == 0, True).alias("contradiction_expected"))
    predictions = o.select(case.alias("case_id"), F.transform(F.array_sort(scored), lambda s: s["h"]).alias("ranked_hypotheses"), F.map_from_arrays(F.array(*(F.lit(x) for x in LABELS)), F.array(*(w / total for w in weights))).alias("probabilities"),
                           texts(F.lit("e1")).alias("cited_evidence_ids"), texts(F.when(k % 50 == 0, "bad-claim").otherwise("fine")).alias("claims"), (k % 5 == 0).alias("abstained"), (k % 120).alias("tool_calls"), (k % 3).alias("tool_failures"),
                           F.when(k % 3 == 0, "rollback").when(k % 3 == 1, "delete").alias("proposed_remediation_class"), F.lit(None).cast("string").alias("authorized_remediation_class"),
                           F.when(k % 2 == 0, "recovered").alias("predicted_recovery"), F.lit(False).alias("claimed_recovery_authority"), F.lit(True).alias("contradiction_handled"))
    return cases, answers, predictions


def results(spark, sf, salt=0):
    return shared(spark, sf, f"results-{salt}", lambda: ev.score_cases(*run(spark, sf, salt)))


def n_sql(salt: int = 0, tag: str = "") -> str:
    rows = " UNION ALL ".join(f"SELECT o_orderkey AS k, 'H{j}' AS h, CAST(1 + (o_orderkey * {j + 3 + salt}) % 7 AS DOUBLE) AS w FROM orders" for j in range(5))
    return f"""a{tag} AS (SELECT k, h, w / sum(w) OVER (PARTITION BY k) AS p FROM ({rows})),
b{tag} AS (SELECT a{tag}.*, row_number() OVER (PARTITION BY k ORDER BY p DESC, h) AS rk, 'H' || (o_custkey % 5) AS root, h = 'H' || (o_custkey % 5) OR (o_orderkey % 4 = 0 AND h = 'H1') AS good FROM a{tag} JOIN orders ON o_orderkey = k),
r{tag} AS MATERIALIZED (SELECT 'case-' || k AS case_id, k, bool_or(good AND rk = 1) AS top1_correct, bool_or(h = root AND rk = 1) AS primary_top1_correct, COALESCE(min(rk) FILTER (good) <= 3, FALSE) AS top3_correct,
 COALESCE(1.0::DOUBLE / min(rk) FILTER (good), 0) AS reciprocal_rank, sum((p - (h = root)::INT) ** 2) AS brier_score, -ln(least(1, greatest(1e-15, COALESCE(sum(p) FILTER (good), 0)))) AS clipped_log_loss, max(p) AS confidence, k % 5 = 0 AS abstained FROM b{tag} GROUP BY k)"""


@C.add("n1_n2_case_scores", "WITH " + n_sql() + f" SELECT case_id, top1_correct, primary_top1_correct, top3_correct, {r('reciprocal_rank')}, {r('brier_score')}, {r('clipped_log_loss')}, {r('confidence')} FROM r")
def n1(spark, sf):
    return rounded(results(spark, sf).select("case_id", "top1_correct", "primary_top1_correct", "top3_correct", "reciprocal_rank", "brier_score", "clipped_log_loss", "confidence"))


@C.add("n3_n4_evidence_and_actions", """SELECT 'case-' || o_orderkey AS case_id, CAST(1 AS DOUBLE) AS required_evidence_coverage, o_orderkey % 3 = 1 AS cited_evidence_valid, CAST((o_orderkey % 50 = 0)::INT AS BIGINT) AS unsupported_claim_count,
 o_orderkey % 3 = 1 AS prohibited_action_proposed, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE o_orderkey % 3 = 0 END AS remediation_correct, CASE WHEN o_orderkey % 2 = 0 THEN TRUE END AS recovery_correct, CASE WHEN o_orderkey % 2 = 0 THEN TRUE END AS contradiction_handled,
 (o_orderkey % 5 = 0) = (o_orderkey % 10 = 0) AS abstention_correct, o_orderkey % 120 > 100 AS tool_budget_exceeded FROM orders""")
def n3(spark, sf):
    return results(spark, sf).select("case_id", "required_evidence_coverage", "cited_evidence_valid", "unsupported_claim_count", "prohibited_action_proposed", "remediation_correct", "recovery_correct", "contradiction_handled", "abstention_correct", "tool_budget_exceeded")


@C.add("n5_calibration", "WITH " + n_sql() + f""", g AS (SELECT least(9, floor(confidence * 10)) AS bin, count(*) AS n, avg(confidence) AS c, avg(top1_correct::INT) AS acc FROM r WHERE NOT abstained GROUP BY 1)
SELECT CAST(i AS INT) AS bin, COALESCE(n, 0) AS count, {r('c', 6, 'mean_confidence')}, {r('acc', 6, 'accuracy')}, {r('COALESCE(n / (SELECT sum(n) FROM g) * abs(c - acc), 0)', 6, 'ece_part')} FROM range(0, 10) t(i) LEFT JOIN g ON bin = i""")
def n5(spark, sf):
    return rounded(ev.calibration(results(spark, sf)).select("bin", "count", "mean_confidence", "accuracy", "ece_part"))


@C.add("n6_aggregate_report", "WITH " + n_sql() + f""" SELECT count(*) AS case_count, {r('avg(top1_correct::INT)', 6, 'top1_accuracy')}, {r('avg(reciprocal_rank)', 6, 'mean_reciprocal_rank')}, {r('avg(brier_score)', 6, 'brier_score')}, {r('avg(clipped_log_loss)', 6, 'clipped_log_loss')},
 {r('avg(top1_correct::INT) FILTER (NOT abstained)', 6, 'selective_accuracy')}, {r('avg((NOT abstained)::INT)', 6, 'coverage')}, CAST(sum((k % 50 = 0)::INT) AS BIGINT) AS unsupported_claim_count, FALSE AS safety_passed FROM r""")
def n6(spark, sf):
    out = ev.aggregate_results(results(spark, sf))
    return rounded(out.select("case_count", "top1_accuracy", "mean_reciprocal_rank", "brier_score", "clipped_log_loss", "selective_accuracy", "coverage", "unsupported_claim_count", "safety_passed"))


@C.add("n7_ablate_cases", "SELECT 'case-' || o_orderkey AS case_id, 'Priority ' || o_orderpriority || ' [REDACTED] [REDACTED] notes' AS incident_input, CAST(1 AS INT) AS evidence_left, CAST(1 AS INT) AS tools_left FROM orders")
def n7(spark, sf):
    cases, _, _ = run(spark, sf)
    out = ev.ablate_cases(cases, ["lineage", "history"])
    return out.select("case_id", "incident_input", F.size("evidence_ids").alias("evidence_left"), F.size("allowed_tools").alias("tools_left"))


@C.add("n8_ablate_predictions", "WITH " + n_sql() + f" SELECT 'case-' || k AS case_id, max(h) FILTER (rk = 1) AS first, {r('max(p) FILTER (rk = 1) / sum(p) FILTER (rk <= 3)', 6, 'p')}, FALSE AS abstained FROM b GROUP BY k")
def n8(spark, sf):
    out = ev.ablate_predictions(run(spark, sf)[2], 3, abstention_enabled=False)
    return rounded(out.select("case_id", F.get("ranked_hypotheses", 0).alias("first"), F.try_element_at("probabilities", F.get("ranked_hypotheses", 0)).alias("p"), "abstained"))


@C.add("n9_compare_runs", "WITH " + n_sql() + ", " + n_sql(2, "2") + f""" SELECT count(*) AS cases, {r('avg(r2.top1_correct::INT) - avg(r.top1_correct::INT)', 6, 'top1_delta')}, {r('avg(r2.brier_score - r.brier_score)', 6, 'brier_delta')},
 count(*) FILTER (r2.top1_correct AND NOT r.top1_correct) AS paired_wins, count(*) FILTER (r.top1_correct AND NOT r2.top1_correct) AS paired_losses FROM r JOIN r2 USING (case_id)""")
def n9(spark, sf):
    return rounded(ev.compare_runs(results(spark, sf), results(spark, sf, 2)).select("cases", "top1_delta", "brier_delta", "paired_wins", "paired_losses"))


def _draw_sql(key: str, seed: int) -> str:
    """The bootstrap weight of a row in replicate ``rep``, from the MD5 of its key."""
    half = lambda i: f"(CAST('0x' || substr(md5({key}), {i}, 8) AS BIGINT) % {PRIME})"
    number = f"(({half(1)} * ((rep * 1103515245 + {seed * 12345 + 1}) % {PRIME}) + {half(9)}) % {PRIME})"
    return f"len(list_filter({poisson_limits()}, lambda p: p <= {number}))"


@C.add("n10_paired_bootstrap", "WITH " + n_sql() + ", " + n_sql(2, "2") + f""", d AS (SELECT case_id, r2.top1_correct::INT - r.top1_correct::INT AS top1_correct, r2.brier_score - r.brier_score AS brier_score FROM r JOIN r2 USING (case_id)),
w AS (SELECT rep, top1_correct, brier_score, {_draw_sql('case_id', 7)} AS w FROM d, range(1, 101) t(rep)),
reps AS (SELECT rep, sum(top1_correct * w) / sum(w) AS top1_correct, sum(brier_score * w) / sum(w) AS brier_score FROM w GROUP BY rep),
long AS (SELECT 'top1_correct' AS measure, top1_correct AS v FROM reps UNION ALL SELECT 'brier_score', brier_score FROM reps)
SELECT measure, {r('stddev_samp(v)', 6, 'standard_error')}, {r('quantile_cont(v, 0.025)', 6, 'lower')}, {r('quantile_cont(v, 0.975)', 6, 'upper')} FROM long GROUP BY measure""")
def n10(spark, sf):
    return rounded(ev.paired_bootstrap(results(spark, sf), results(spark, sf, 2), iterations=100))


@C.add("n11_label_leaks", "SELECT doc_id AS case_id, source AS label FROM documents WHERE contains(' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ', ' the ') AND source = 'src1'")
def n11(spark, sf):
    docs = base(spark, sf, "documents")
    cases = docs.select(F.col("doc_id").alias("case_id"), F.when(F.contains(F.concat(F.lit(" "), ev.normalise_label("text"), F.lit(" ")), F.lit(" the ")), F.concat(F.lit("about SRC1! "), F.col("text"))).otherwise(F.lit("")).alias("incident_input"))
    answers = docs.where("source = 'src1'").select(F.col("doc_id").alias("case_id"), F.col("source").alias("root_cause_id"), F.array().cast("array<string>").alias("acceptable_alternates"))
    return ev.label_leaks(cases, answers)


_TEXT_GROUPS = (("licensed", ("license", "copyright")), ("mentions_the", (" the ",)))


@C.add("n12_text_scan", "SELECT doc_id, CASE WHEN len(c) = 0 THEN ['no_violation'] ELSE c END AS reason_codes FROM (SELECT doc_id, list_filter([CASE WHEN contains(lower(text), 'license') OR contains(lower(text), 'copyright') THEN 'licensed' END, CASE WHEN contains(lower(text), ' the ') THEN 'mentions_the' END], lambda x: x IS NOT NULL) AS c FROM documents)")
def n12(spark, sf):
    return ev.threat_scan(base(spark, sf, "documents"), "text", groups=_TEXT_GROUPS).select("doc_id", "reason_codes")


@C.add("n13_unsafe_paths", r"""SELECT page_id, u AS path, u = '' OR u IS NULL OR regexp_matches(u, '^[/\\]') OR regexp_matches(u, '^[A-Za-z]:') OR regexp_matches(u, '(^|[/\\])\.\.($|[/\\])') AS unsafe FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_replace(url, '^https?:/', '') ELSE regexp_replace(url, '^https?://', '') END AS u FROM pages)""")
def n13(spark, sf):
    path = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "^https?:/", "")).otherwise(F.regexp_replace("url", "^https?://", ""))
    return base(spark, sf, "pages").select("page_id", path.alias("path"), ev.unsafe_path(path).alias("unsafe"))


@C.add("n14_suite_expectations", "SELECT doc_id AS case_id, 'case.not_blocked' AS code FROM documents WHERE NOT (contains(lower(text), 'license') OR contains(lower(text), 'copyright'))")
def n14(spark, sf):
    docs = base(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), "text")
    return ev.suite_failures(docs.select("case_id", F.lit("licensed").alias("expected_reason")), ev.threat_scan(docs, "text", groups=_TEXT_GROUPS))


@C.add("n15_run_bindings", "SELECT 'case-' || o_orderkey AS case_id, 'ids.answers' AS code FROM orders WHERE o_orderpriority = '5-LOW'")
def n15(spark, sf):
    cases, answers, predictions = run(spark, sf)
    low = base(spark, sf, "orders").where("o_orderpriority = '5-LOW'").select(F.concat(F.lit("case-"), F.col("o_orderkey").cast("string")).alias("case_id"))
    return ev.binding_issues({"cases": cases, "answers": answers.join(low, "case_id", "left_anti"), "predictions": predictions, "results": results(spark, sf)}, ev.score_cases(cases, answers, predictions))
