"""Queries for sections O (summaries) and Q (streaming)."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from tidemark.catalog import anomalies, customers, operations, quality
from tidemark.catalog.common import Catalog, base, oracle_prelude, r, rounded, tables_of
from tidemark.catalog.cube import SLIM, contributions, daily_cube, daily_prelude, funnel, funnel_sql, materialized
from tidemark.catalog.sources_facts import fact_prelude
from tidemark.plans import summaries
from tidemark.sources import io
from tidemark.streaming import live

C = Catalog()


@C.add("o1_dataset_profile", oracle_prelude("checkout_sessions", "payment_attempts", "orders", "shipments", "returns", "warehouse_scan_events") + f""",
q AS (SELECT list(ingestion_lag_seconds ORDER BY ingestion_lag_seconds) AS l, count(*) AS n FROM s_warehouse_scan_events),
v AS (SELECT unnest([{{'name': 'checkout_sessions', 'value': (SELECT count(*) FROM s_checkout_sessions)::DOUBLE}}, {{'name': 'orders', 'value': (SELECT count(*) FROM s_orders)::DOUBLE}},
 {{'name': 'gross_order_value', 'value': (SELECT sum(total_amount) FROM s_orders)}}, {{'name': 'payment_attempts', 'value': (SELECT count(*) FROM s_payment_attempts)::DOUBLE}},
 {{'name': 'checkout_conversion_rate', 'value': (SELECT count(*) FROM s_orders) / (SELECT count(*) FROM s_checkout_sessions)}}, {{'name': 'payment_approval_rate', 'value': (SELECT avg(approved::INT) FROM s_payment_attempts)}},
 {{'name': 'delivered_shipments', 'value': (SELECT count(*) FROM s_shipments WHERE status = 'delivered')::DOUBLE}}, {{'name': 'late_delivery_rate', 'value': (SELECT avg(late::INT) FROM s_shipments WHERE status = 'delivered')}},
 {{'name': 'return_rate_per_order', 'value': (SELECT count(*) FROM s_returns) / (SELECT count(*) FROM s_orders)}}, {{'name': 'warehouse_scan_events', 'value': (SELECT count(*) FROM s_warehouse_scan_events)::DOUBLE}},
 {{'name': 'p95_scan_ingestion_lag_seconds', 'value': (SELECT l[CAST(round(0.95 * (n - 1)) AS BIGINT) + 1] FROM q)::DOUBLE}}]) AS s)
SELECT s.name AS name, {r('s.value', 4, 'value')} FROM v""")
def o1(spark, sf):
    # The exact middle of an even count is a rank tie, so the median is left to the tests.
    return rounded(summaries.dataset_profile(tables_of(spark, sf)).where("name <> 'median_scan_ingestion_lag_seconds'"), 4)


@C.add("o1_cohort_counts", oracle_prelude("checkout_sessions") + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS n FROM s_checkout_sessions GROUP BY 2" for c in ("region", "device", "customer_type", "channel")))
def o1b(spark, sf):
    return summaries.counts_by(tables_of(spark, sf)["checkout_sessions"], ["region", "device", "customer_type", "channel"])


@C.add("o2_latest_metrics", daily_prelude() + f"SELECT metric_name, {r('value', 4)}, unit, sample_size, quality_status FROM m_daily WHERE cohort_name = 'overall' AND period_start = (SELECT max(period_start) FROM m_daily WHERE cohort_name = 'overall')")
def o2(spark, sf):
    return rounded(summaries.latest_snapshot(daily_cube(spark, sf), ["metric_name", "value", "unit", "sample_size", "quality_status"]), 4)


@C.add("o2_latest_funnel", materialized(fact_prelude("checkout")) + f", x AS MATERIALIZED ({funnel_sql(SLIM)}) SELECT stage_order, stage_name, stage_count, drop_off_count FROM x WHERE time_grain = 'day' AND cohort_name = 'overall' AND period_start = (SELECT max(period_start) FROM x WHERE time_grain = 'day')")
def o2b(spark, sf):
    return summaries.latest_snapshot(funnel(spark, sf), ["stage_order", "stage_name", "stage_count", "drop_off_count"])


@C.add("o3_analytics_summary")
def o3(spark, sf):
    return summaries.analytics_summary({"metric_observations": daily_cube(spark, sf), "funnel_observations": funnel(spark, sf), "contribution_observations": contributions(spark, sf), "data_quality_results": quality.quality_table(spark, sf)})


@C.add("o4_detection_summary")
def o4(spark, sf):
    return summaries.detection_summary(anomalies.detected(spark, sf), anomalies._events(spark, sf), anomalies.detection_checks(spark, sf))[0]


@C.add("o4_newest_events")
def o4b(spark, sf):
    return summaries.detection_summary(anomalies.detected(spark, sf), anomalies._events(spark, sf), anomalies.detection_checks(spark, sf))[1]


@C.add("o5_impact_summary")
def o5(spark, sf):
    return summaries.impact_summary(customers.features(spark, sf), customers.estimates(spark, sf), customers.model_metrics(spark, sf), customers.impact_checks(spark, sf))


@C.add("o6_evidence_summary")
def o6(spark, sf):
    return summaries.evidence_summary(operations.records(spark, sf), operations.health(spark, sf))


@C.add("o7_gated_stage")
def o7(spark, sf):
    """Gate a stage on its checks, publish it and count what was written."""
    from tidemark.plans.stages import run_stage

    where = io.scratch_dir(spark, "o7")
    built = run_stage(lambda: {"anomaly_events": anomalies._events(spark, sf), "detection_quality_results": anomalies.detection_checks(spark, sf)}, "detection_quality_results", where)
    return io.union_all([spark.read.parquet(f"{where}/{n}.parquet").agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n in built])


# ---------------------------------------------------------------------- Q

def event_stream(spark, sf):
    """The events file as a bounded stream, followed by one far-future row that moves the watermark past all data."""
    source = io.scratch_dir(spark, "stream-in")
    rows = base(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    rows.write.parquet(source)
    last = rows.agg(F.max("ts")).first()[0]
    closing = spark.createDataFrame([(-1, last + timedelta(days=30), -1, "_closing", 0.0)], rows.schema)
    closing.write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    return live.as_instant(stream, "ts")


def _drained(spark, name, stream):
    where = io.scratch_dir(spark, name)
    return live.drain(stream, f"{where}/out", f"{where}/checkpoint")


@C.add("q1_stream_metrics", f"SELECT event_type, date_trunc('day', ts) AS period_start, count(*) AS n, {r('sum(value)', 4, 'total')} FROM events GROUP BY 1, 2")
def q1(spark, sf):
    out = _drained(spark, "q1", live.stream_metrics(event_stream(spark, sf), "ts", "day", "2 days", ["event_type"], [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")]))
    out = out.where("event_type <> '_closing'").select("event_type", live.wall_time("period_start").alias("period_start"), "n", "total")
    return rounded(out, 4)


CUSUM_SQL = """WITH RECURSIVE x AS MATERIALIZED (SELECT event_id, event_type AS s, (value - 50) / 50 AS z, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT s, i, event_id, greatest(0, z - 0.5) AS cp, greatest(0, -z - 0.5) AS cn FROM x WHERE i = 1
 UNION ALL SELECT x.s, x.i, x.event_id, greatest(0, w.cp + x.z - 0.5), greatest(0, w.cn - x.z - 0.5) FROM w JOIN x ON x.s = w.s AND x.i = w.i + 1)
"""


@C.add("q2_stream_cusum", CUSUM_SQL + f"SELECT s AS series, count(*) AS points, {r('max(greatest(cp, cn))', 4, 'peak')} FROM w GROUP BY 1")
def q2(spark, sf):
    z = ((F.col("value") - 50) / 50).alias("z")
    stream = event_stream(spark, sf).where("event_type <> '_closing'").select(F.col("event_type").alias("series"), F.col("ts").alias("at"), z)
    out = _drained(spark, "q2", live.stream_cusum(stream))
    return rounded(out.groupBy("series").agg(F.count(F.lit(1)).alias("points"), F.max("cusum_score").alias("peak")), 4)


@C.add("q3_stream_lifecycle", """
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS incident, ts AS t, CASE event_type WHEN 'purchase' THEN 'recovered' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'insufficient_data' ELSE 'recovering' END AS decision, COALESCE(value > 300, false) AS severe FROM events),
n AS (SELECT *, decision NOT IN ('recovered', 'insufficient_data') AS bad, row_number() OVER w AS generation, sum((decision = 'recovered')::INT) OVER w AS goods, sum((decision NOT IN ('recovered', 'insufficient_data'))::INT) OVER w AS bads
 FROM e WINDOW w AS (PARTITION BY incident ORDER BY t, decision, severe ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, max(CASE WHEN decision = 'recovered' THEN bads ELSE 0 END) OVER g AS settled, last_value(CASE WHEN decision <> 'insufficient_data' THEN decision = 'recovered' END IGNORE NULLS) OVER g AS held FROM n WINDOW g AS (PARTITION BY incident ORDER BY generation ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, CASE WHEN goods > 0 THEN bads - settled ELSE 0 END AS failed FROM b),
o AS (SELECT *, bad AND (severe OR (goods > 0 AND failed >= 2)) AS opens FROM f),
p AS (SELECT *, min(generation) FILTER (opens) OVER (PARTITION BY incident) AS opened FROM o),
z AS (SELECT *, max(failed) FILTER (generation = opened) OVER (PARTITION BY incident) AS frozen FROM p)
SELECT incident, t AS "at", generation, CASE WHEN generation >= opened THEN 'reopened' WHEN decision = 'recovered' OR (decision = 'insufficient_data' AND held) THEN 'recovered' ELSE 'monitoring' END AS status,
 CAST(CASE WHEN generation >= opened THEN frozen ELSE failed END AS BIGINT) AS failures,
 CASE WHEN generation > opened THEN 'incident_already_reopened' WHEN decision = 'recovered' THEN 'recovery_verified' WHEN decision = 'insufficient_data' THEN 'recovery_evidence_gap'
  WHEN opens AND severe THEN 'severe_guardrail_regression' WHEN opens THEN 'sustained_recovery_regression' WHEN goods > 0 THEN 'regression_observed' ELSE 'recovery_not_yet_verified' END AS "trigger" FROM z""")
def q3(spark, sf):
    decision = F.when(F.col("event_type") == "purchase", "recovered").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "insufficient_data").otherwise("recovering")
    stream = event_stream(spark, sf).where("event_type <> '_closing'").select(F.col("user_id").cast("string").alias("incident"), F.col("ts").alias("at"), decision.alias("decision"), (F.col("value") > 300).alias("severe"))
    return _drained(spark, "q3", live.stream_lifecycle(stream)).select("incident", live.wall_time("at").alias("at"), "generation", "status", "failures", "trigger")


@C.add("q4_stream_islands", """
WITH g AS (SELECT event_type, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '10' MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
i AS (SELECT *, sum(b) OVER (PARTITION BY event_type ORDER BY ts) AS n FROM g)
SELECT event_type, min(ts) AS started_at, count(*) AS points FROM i GROUP BY event_type, n""")
def q4(spark, sf):
    out = _drained(spark, "q4", live.stream_islands(event_stream(spark, sf), "ts", "10 minutes", ["event_type"], "1 day"))
    return out.where("event_type <> '_closing'").select("event_type", live.wall_time("started_at").alias("started_at"), "points")


@C.add("q5_stream_dedupe", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def q5(spark, sf):
    once = event_stream(spark, sf).where("event_type <> '_closing'")
    twice = once.unionByName(event_stream(spark, sf).where("event_type <> '_closing'"))
    out = _drained(spark, "q5", live.stream_dedupe(twice, ["event_id"], "ts", "40 days"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"))
