"""Queries for sections J (evidence, lineage) and K (query and search surface)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.catalog import anomalies, customers
from tidemark.catalog.common import Catalog, base, oracle_prelude, r, rounded, shared, tables_of
from tidemark.operators import evidence as ev
from tidemark.operators import graph, search
from tidemark.plans.config import EvidenceWindow
from tidemark.sources import io
from tidemark.sources.contracts import SOURCE_SPECS

C = Catalog()
WINDOW = EvidenceWindow("checkout-outage", "checkout_failure", datetime(2024, 1, 20), datetime(2024, 1, 23), "checkout-service", "ASIA")
_IN = "BETWEEN TIMESTAMP '2024-01-19' AND TIMESTAMP '2024-01-24'"
_STATUS = "CASE WHEN error_rate >= 0.20 OR saturation >= 0.95 THEN 'critical' WHEN error_rate >= 0.10 OR saturation >= 0.85 THEN 'degraded' WHEN error_rate >= 0.04 OR saturation >= 0.75 THEN 'warning' ELSE 'healthy' END"


def _health_sql(source: str, at: str, region: str, error: str, latency: str, capacity: str, requests: str = "count(*)", group: str = "1, 2") -> str:
    return f"""SELECT region, observed_at, CAST(request_count AS BIGINT) AS request_count, CAST(error_count AS BIGINT) AS error_count, {r('error_rate', 6)}, {r('p50_latency_ms', 4)}, {r('p95_latency_ms', 4)}, {r('saturation', 6)}, {_STATUS} AS status
FROM (SELECT *, error_count / request_count AS error_rate, least(1.0::DOUBLE, request_count / {capacity}) AS saturation FROM (
 SELECT {region} AS region, {at} AS observed_at, {requests} AS request_count, {error} AS error_count, quantile_cont(CAST({latency} AS DOUBLE), 0.5) AS p50_latency_ms, quantile_cont(CAST({latency} AS DOUBLE), 0.95) AS p95_latency_ms FROM {source} GROUP BY {group}))"""


def _shown(df):
    out = df.withColumn("status", ev.health_status(F.col("error_rate"), F.col("saturation"))).drop("window_minutes")
    return rounded(rounded(out, 6, ("error_rate", "saturation")), 4, ("p50_latency_ms", "p95_latency_ms"))


@C.add("j1_checkout_health", oracle_prelude("checkout_sessions") + _health_sql("s_checkout_sessions", "date_trunc('hour', started_at)", "region", "count(*) FILTER (completed_at IS NULL)",
       "COALESCE(date_diff('millisecond', started_at, completed_at), date_diff('millisecond', started_at, payment_started_at), 0)", "80.0::DOUBLE"))
def j1(spark, sf):
    return _shown(ev.checkout_health(tables_of(spark, sf)))


@C.add("j1_payment_health", oracle_prelude("checkout_sessions", "payment_attempts") + _health_sql("s_payment_attempts p JOIN s_checkout_sessions s USING (session_id)", "date_trunc('hour', attempted_at)", "s.region", "count(*) FILTER (NOT approved)", "latency_ms", "65.0::DOUBLE"))
def j1b(spark, sf):
    return _shown(ev.payment_health(tables_of(spark, sf)))


@C.add("j2_flow_run_health", oracle_prelude("pipeline_runs") + f"""
SELECT started_at AS observed_at, input_rows AS request_count, input_rows - output_rows AS error_count, {r('(input_rows - output_rows) / input_rows', 6, 'error_rate')},
 {r("date_diff('second', started_at, completed_at) * 1000.0::DOUBLE", 4, 'p95_latency_ms')}, {r('least(1.0::DOUBLE, input_rows / 100000.0::DOUBLE)', 6, 'saturation')} FROM s_pipeline_runs""")
def j2(spark, sf):
    rows = ev.flow_health(tables_of(spark, sf)).select("observed_at", "request_count", "error_count", "error_rate", "p95_latency_ms", "saturation")
    return rounded(rounded(rows, 6, ("error_rate", "saturation")), 4, ("p95_latency_ms",))


@C.add("j3_fulfilment_health", oracle_prelude("shipments") + _health_sql("s_shipments", "date_trunc('day', promised_delivery_at)", "'global'", "count(*) FILTER (late)", "COALESCE(date_diff('millisecond', shipped_at, delivered_at), 0)", "750.0::DOUBLE"))
def j3(spark, sf):
    return _shown(ev.fulfilment_health(tables_of(spark, sf)))


@C.add("j3_seller_feed_health", oracle_prelude("seller_feed_runs") + _health_sql("s_seller_feed_runs", "date_trunc('day', started_at)", "'global'", "sum(records_rejected)", "latency_seconds * 1000.0", "1000000.0::DOUBLE", "sum(records_received)"))
def j3b(spark, sf):
    return _shown(ev.seller_feed_health(tables_of(spark, sf)))


_SERVICES = (("checkout", "checkout-service", "checkout-api", "checkout_sessions"), ("payments", "payment-service", "payment-orchestrator", "payment_attempts"), ("pipeline", "data-platform", "commerce-flow", "pipeline_runs"))


def _health_pair(spark, sf):
    pairs = [ev.service_health(tables_of(spark, sf), kind, service, component, source, WINDOW) for kind, service, component, source in _SERVICES]
    return io.union_all([p[0] for p in pairs]), io.union_all([p[1] for p in pairs])


def health(spark, sf):
    return shared(spark, sf, "health", lambda: _health_pair(spark, sf)[0])


def health_records(spark, sf):
    return shared(spark, sf, "health-records", lambda: _health_pair(spark, sf)[1])


@C.add("j4_j5_health_in_context", oracle_prelude("checkout_sessions") + f"SELECT status, count(*) AS windows FROM ({_health_sql('s_checkout_sessions', chr(100) + 'ate_trunc(' + repr('hour') + ', started_at)', 'region', 'count(*) FILTER (completed_at IS NULL)', '0', '80.0::DOUBLE')}) WHERE observed_at {_IN} GROUP BY 1")
def j4(spark, sf):
    return health(spark, sf).where("service = 'checkout-service'").groupBy("status").agg(F.count(F.lit(1)).alias("windows"))


@C.add("j6_evidence_records")
def j6(spark, sf):
    return health_records(spark, sf)


def typed(spark, sf):
    """Typed evidence built from the given tables."""
    events, parts = base(spark, sf, "events"), base(spark, sf, "part")
    flagged = events.where("event_type = 'error' AND value > 200")
    changes = flagged.select(
        F.concat(F.lit("CH"), F.col("event_id").cast("string")).alias("change_id"), F.lit("configuration").alias("change_type"),
        F.when(F.col("user_id") % 2 == 0, "checkout-service").otherwise("payment-service").alias("service"), F.get_json_object("props", "$.k").alias("key"), F.lit("a").alias("old_value"), F.lit("b").alias("new_value"),
        F.lit("global").alias("region_scope"), F.col("ts").alias("changed_at"), F.lit("bot").alias("actor"), F.lit(True).alias("approved"), (F.col("event_id") % 2 == 0).alias("rollback_available"),
        F.lit("context").alias("evidence_role"), F.concat(F.lit("change of user "), F.col("user_id").cast("string")).alias("description"))
    flags = events.where("event_type = 'signup' AND value > 200").select(
        F.concat(F.lit("FL"), F.col("event_id").cast("string")).alias("flag_state_id"), F.concat(F.lit("flag-"), (F.col("user_id") % 5).cast("string")).alias("flag_key"), F.lit("on").alias("value"),
        F.when(F.col("user_id") % 2 == 0, "checkout-service").otherwise("payment-service").alias("service"), F.lit("ASIA").alias("region_scope"), F.col("ts").alias("valid_from"),
        (F.col("ts") + F.expr("INTERVAL '2' HOUR")).alias("valid_to"), F.lit("bot").alias("changed_by"), F.lit("supporting").alias("evidence_role"), F.lit("flag rollout").alias("description"))
    a, ra = ev.attach_records(changes, "config_changes", "config_change", "change_id", "changed_at", "key", "description", WINDOW)
    b, rb = ev.attach_records(flags, "feature_flag_states", "feature_flag", "flag_state_id", "valid_from", "flag_key", "description", WINDOW)
    return {"config_changes": a, "feature_flag_states": b}, ra.unionByName(rb)


_CHANGES = "SELECT 'configuration' AS record_kind, concat('CH', event_id) AS id, ts AS happened_at, CASE WHEN user_id % 2 = 0 THEN 'checkout-service' ELSE 'payment-service' END AS service, concat('change of user ', user_id) AS description FROM events WHERE event_type = 'error' AND value > 200"
_FLAGS = "SELECT 'feature_flag', concat('FL', event_id), ts, CASE WHEN user_id % 2 = 0 THEN 'checkout-service' ELSE 'payment-service' END, 'flag rollout' FROM events WHERE event_type = 'signup' AND value > 200"


@C.add("j7_typed_evidence", f"SELECT record_kind, service, count(*) AS n FROM ({_CHANGES} UNION ALL {_FLAGS}) GROUP BY 1, 2")
def j7(spark, sf):
    tables, _ = typed(spark, sf)
    both = tables["config_changes"].select(F.lit("configuration").alias("record_kind"), "service").unionByName(tables["feature_flag_states"].select(F.lit("feature_flag").alias("record_kind"), "service"))
    return both.groupBy("record_kind", "service").agg(F.count(F.lit(1)).alias("n"))


@C.add("j8_deployment_roles", oracle_prelude("deployments") + f"""
SELECT deployment_id AS source_ref, CASE WHEN service = 'checkout-service' AND deployed_at {_IN} AND region_scope IN ('all', 'global', 'ASIA') AND status = 'success' THEN 'supporting' ELSE 'context' END AS evidence_role FROM s_deployments""")
def j8(spark, sf):
    return ev.deployment_evidence(tables_of(spark, sf)["deployments"], WINDOW).select("source_ref", "evidence_role")


def lineage(spark, sf):
    """region -> nation -> customer -> order nodes and edges."""
    n, c, o = base(spark, sf, "nation"), base(spark, sf, "customer"), base(spark, sf, "orders")
    name = lambda prefix, column: F.concat(F.lit(prefix), F.col(column).cast("string"))
    edges = io.union_all([
        n.select(name("R", "n_regionkey").alias("upstream_node_id"), name("N", "n_nationkey").alias("downstream_node_id")),
        c.select(name("N", "c_nationkey").alias("upstream_node_id"), name("C", "c_custkey").alias("downstream_node_id")),
        o.select(name("C", "o_custkey").alias("upstream_node_id"), name("O", "o_orderkey").alias("downstream_node_id")),
    ]).withColumn("edge_id", F.concat_ws(">", "upstream_node_id", "downstream_node_id"))
    nodes = io.union_all([
        base(spark, sf, "region").select(name("R", "r_regionkey").alias("node_id"), F.lit("source").alias("node_type")),
        n.select(name("N", "n_nationkey").alias("node_id"), F.lit("dataset").alias("node_type")), c.select(name("C", "c_custkey").alias("node_id"), F.lit("dataset").alias("node_type")),
        o.select(name("O", "o_orderkey").alias("node_id"), F.lit("metric").alias("node_type")),
    ])
    return nodes, edges


EDGES_SQL = """e AS (SELECT 'R' || n_regionkey AS u, 'N' || n_nationkey AS d FROM nation UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer UNION ALL SELECT 'C' || o_custkey, 'O' || o_orderkey FROM orders)"""


@C.add("j9_lineage_tables", f"WITH {EDGES_SQL} SELECT substr(u, 1, 1) || substr(d, 1, 1) AS kind, count(*) AS edges FROM e GROUP BY 1")
def j9(spark, sf):
    _, edges = lineage(spark, sf)
    return edges.groupBy(F.concat(F.substring("upstream_node_id", 1, 1), F.substring("downstream_node_id", 1, 1)).alias("kind")).agg(F.count(F.lit(1)).alias("edges"))


@C.add("j10_cycle_detection", f"""WITH {EDGES_SQL}
SELECT node_id FROM (SELECT 'R0' AS node_id UNION SELECT 'N' || n_nationkey FROM nation WHERE n_regionkey = 0 UNION SELECT 'C' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0
 UNION SELECT 'O' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0)""")
def j10(spark, sf):
    nodes, edges = lineage(spark, sf)
    # Close a loop from the nations of region 0 back to it: everything behind it stays.
    back = base(spark, sf, "nation").where("n_regionkey = 0").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("upstream_node_id"), F.lit("R0").alias("downstream_node_id"))
    return graph.cyclic_nodes(nodes, edges.select("upstream_node_id", "downstream_node_id").unionByName(back))


@C.add("j11_reachability", f"WITH RECURSIVE {EDGES_SQL}, w AS (SELECT 'R1' AS node_id, 0 AS depth UNION SELECT d, depth + 1 FROM w JOIN e ON u = node_id) SELECT node_id, min(depth) AS depth FROM w GROUP BY 1")
def j11(spark, sf):
    nodes, edges = lineage(spark, sf)
    return graph.reachable(edges, nodes.where("node_id = 'R1'"))


@C.add("j12_graph_issues", "SELECT 'lineage.orphan' AS code, 'C' || c_custkey AS subject FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'lineage.unknown_endpoint', 'C' || o_custkey || '->O' || o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def j12(spark, sf):
    nodes, edges = lineage(spark, sf)
    last = edges.where("substr(upstream_node_id, 1, 1) = 'C'")
    gone = base(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("node_id"))
    idle = base(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("node_id"))
    kept = nodes.where("substr(node_id, 1, 1) IN ('C', 'O')").join(gone, "node_id", "left_anti")
    touched = last.select(F.col("upstream_node_id").alias("node_id"))
    return graph.graph_issues(kept.unionByName(idle.join(touched, "node_id", "left_anti").withColumn("node_type", F.lit("dataset"))), last)


def records(spark, sf):
    return shared(spark, sf, "records", lambda: health_records(spark, sf).unionByName(ev.deployment_evidence(tables_of(spark, sf)["deployments"], WINDOW)).unionByName(typed(spark, sf)[1]))


def timeline(spark, sf):
    return shared(spark, sf, "timeline", lambda: ev.timeline(records(spark, sf), WINDOW))


@C.add("j13_incident_timeline", oracle_prelude("deployments") + f"""
SELECT CAST(row_number() OVER (ORDER BY occurred_at, event_type, title, k) AS BIGINT) AS sequence, occurred_at, event_type, title FROM (
 SELECT deployed_at AS occurred_at, 'deployment' AS event_type, concat('Deployment ', version, ' to ', service) AS title, deployment_id AS k FROM s_deployments WHERE deployed_at {_IN}
 UNION ALL SELECT TIMESTAMP '2024-01-20', 'incident_started', 'Incident started', '' UNION ALL SELECT TIMESTAMP '2024-01-23', 'incident_ended', 'Incident ended', '')""")
def j13(spark, sf):
    found = ev.timeline(ev.deployment_evidence(tables_of(spark, sf)["deployments"], WINDOW), WINDOW)
    return found.select("sequence", "occurred_at", "event_type", "title")


@C.add("j14_source_evidence", oracle_prelude("orders", "refunds") + """SELECT 'orders' AS source_ref, concat(count(*), ' rows, 16 columns.') AS summary FROM s_orders UNION ALL SELECT 'refunds', concat(count(*), ' rows, 8 columns.') FROM s_refunds""")
def j14(spark, sf):
    t = tables_of(spark, sf)
    profiles = io.union_all([io.profile_table(t[n], n, SOURCE_SPECS[n].timestamp_columns) for n in ("orders", "refunds")])
    return ev.source_evidence(profiles, WINDOW).select("source_ref", "summary")


def evidence_tables(spark, sf):
    nodes, edges = lineage(spark, sf)
    tables, _ = typed(spark, sf)
    return {"evidence_records": records(spark, sf), "service_health": health(spark, sf), "lineage_nodes": nodes, "lineage_edges": edges, "incident_timeline": timeline(spark, sf), **tables}


def evidence_checks(spark, sf):
    return shared(spark, sf, "evidence-checks", lambda: ev.evidence_quality(evidence_tables(spark, sf), [s for _, s, _, _ in _SERVICES]))


@C.add("j15_evidence_quality", "SELECT unnest(['evidence.unique_ids', 'evidence.content_hashes', 'evidence.references', 'health.arithmetic', 'lineage.references', 'lineage.acyclic', 'timeline.ordering', 'health.service_coverage']) AS check_name, 'pass' AS status")
def j15(spark, sf):
    return evidence_checks(spark, sf).select("check_name", "status")


@C.add("j16_record_reconstruction", oracle_prelude("deployments") + "SELECT 'evidence.content' AS code, count(*) AS n FROM s_deployments WHERE status = 'failed' UNION ALL SELECT 'evidence.id', count(*) FROM s_deployments WHERE status = 'failed'")
def j16(spark, sf):
    found = ev.deployment_evidence(tables_of(spark, sf)["deployments"], WINDOW)
    drifted = found.withColumn("payload_json", F.when(F.contains("summary", F.lit("failed")), F.concat("payload_json", F.lit(" "))).otherwise(F.col("payload_json")))
    return ev.record_issues(drifted).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------- K


@C.add("k1_bounded_sql", "WITH g AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2) SELECT *, (SELECT count(*) FROM g) > 40 AS truncated FROM g ORDER BY 1, 2, 3 LIMIT 40")
def k1(spark, sf):
    io.register(spark, {"stream": {"events": base(spark, sf, "events")}})
    rows, truncated = search.bounded_sql(spark, "SELECT event_type, user_id, count(*) AS n FROM stream__events GROUP BY event_type, user_id", ["stream__events"], row_limit=40)
    return rows.withColumn("truncated", F.lit(truncated))


@C.add("k2_allowed_relations", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def k2(spark, sf):
    io.register(spark, {"stream": {"events": base(spark, sf, "events")}})
    return search.allowed_query(spark, "WITH x AS (SELECT event_type FROM stream__events) SELECT event_type, count(*) AS n FROM x GROUP BY event_type", ["stream__events"])


@C.add("k3_search_text", "SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'license') OR contains(lower(lang), 'license')")
def k3(spark, sf):
    return search.search_text(base(spark, sf, "documents"), "LICENSE").select("doc_id", "lang")


@C.add("k4_evidence_search", oracle_prelude("deployments") + "SELECT deployment_id AS source_ref, deployed_at AS observed_at FROM s_deployments WHERE contains(concat('Deployment ', version, ' to ', service), 'payment') ORDER BY deployed_at DESC, source_ref DESC LIMIT 25")
def k4(spark, sf):
    found = ev.deployment_evidence(tables_of(spark, sf)["deployments"], WINDOW)
    return search.find(found.select("source_ref", "observed_at", "title"), query="Payment", newest="observed_at", ties=("source_ref",), limit=25).select("source_ref", "observed_at")


@C.add("k5_lineage_trace", f"""WITH RECURSIVE {EDGES_SQL}, w AS (SELECT 'N3' AS node_id, 0 AS depth UNION SELECT d, depth + 1 FROM w JOIN e ON u = node_id WHERE depth < 2) SELECT DISTINCT node_id FROM w""")
def k5(spark, sf):
    nodes, edges = lineage(spark, sf)
    return graph.trace(nodes, edges, "N3", "down", 2)[0].select("node_id")


@C.add("k6_changes", f"SELECT record_kind, id, happened_at FROM (SELECT * FROM ({_CHANGES} UNION ALL {_FLAGS}) WHERE service = 'checkout-service' ORDER BY CASE record_kind WHEN 'configuration' THEN 0 ELSE 1 END, happened_at, id LIMIT 30)")
def k6(spark, sf):
    t, _ = typed(spark, sf)
    found = search.changes(t["config_changes"], t["feature_flag_states"], service="checkout-service", limit=30)
    return found.select("record_kind", F.coalesce("change_id", "flag_state_id").alias("id"), F.coalesce("changed_at", "valid_from").alias("happened_at"))


@C.add("k7_runbook_lookup", "SELECT doc_id, source FROM documents WHERE source = 'src3' AND contains(lower(text), 'the')")
def k7(spark, sf):
    docs = base(spark, sf, "documents").where("source = 'src3'")
    return search.search_text(docs.select("doc_id", "text", "source"), "the").select("doc_id", "source")


@C.add("k8_history_search", "SELECT event_id, ts FROM events WHERE event_type = 'error' AND contains(props, '5') ORDER BY ts DESC, event_id DESC LIMIT 20")
def k8(spark, sf):
    return search.find(base(spark, sf, "events"), query="5", equals={"event_type": "error"}, newest="ts", ties=("event_id",), limit=20).select("event_id", "ts")


@C.add("k9_anomaly_list")
def k9(spark, sf):
    return search.find(anomalies._events(spark, sf), newest="started_at", ties=("event_id",), limit=50)


@C.add("k10_impact_bundle")
def k10(spark, sf):
    parts = [df.select(F.lit(n).alias("table_name"), F.to_json(F.struct(*df.columns)).alias("row")) for n, df in (
        ("financial_impact", customers.financial(spark, sf)), ("causal_estimates", customers.estimates(spark, sf)), ("model_metrics", customers.model_metrics(spark, sf)))]
    return io.union_all(parts)


@C.add("k11_table_set_summary")
def k11(spark, sf):
    names = io.register(spark, {"dataset": tables_of(spark, sf), "evidence": evidence_tables(spark, sf)})
    return io.union_all([spark.table(n).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n in names])


@C.add("k12_extract_references", "SELECT DISTINCT unnest([CAST(o_custkey AS VARCHAR), o_orderpriority]) AS evidence_record_id FROM orders")
def k12(spark, sf):
    rows = base(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("one"), F.to_json(F.array("o_orderpriority")).alias("many_json"))
    return search.extract_refs(rows, single=["one"], json_lists=["many_json"])


@C.add("k13_redaction", r"""SELECT page_id, regexp_replace(html, '(?:(?:file:)?/[^\s''"\\]+|[A-Za-z]:\\[^\s''"\\]+)', '[PATH_REDACTED]', 'g') AS html FROM pages""")
def k13(spark, sf):
    return base(spark, sf, "pages").select("page_id", search.redact_text("html").alias("html"))


def nested_logs(spark, sf):
    """One log record of JSON text per order: secrets, paths and evidence ids at several levels, every seventh one nested deep."""
    orders = base(spark, sf, "orders")
    key, status = F.col("o_orderkey").cast("string"), F.col("o_orderstatus")
    item = F.struct(F.concat(F.lit("order-"), key).alias("evidence_record_id"), F.lit("/srv/run").alias("output_path"), F.array(status, F.lit("shared")).alias("evidence_record_ids"))
    detail = F.struct(key.alias("api_token"), F.concat(F.lit("see /var/"), key, F.lit(" now")).alias("note"), F.array(item).alias("items"),
                      F.to_json(F.array(F.col("o_orderpriority"))).alias("evidence_record_ids_json"))
    text = F.to_json(F.struct(F.col("o_orderkey").alias("id"), detail.alias("detail")))
    deep = F.concat(F.lit('{"w":[' * 4), text, F.lit("]}" * 4))
    return orders.select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, deep).otherwise(text).alias("record"))


@C.add("k12_nested_references", """SELECT unnest(['order-' || o_orderkey, o_orderstatus, o_orderpriority]) AS evidence_record_id FROM orders UNION SELECT 'shared' FROM orders""")
def k12_nested(spark, sf):
    return search.nested_refs(nested_logs(spark, sf), "record")


_SHOWN = """'{"detail":{"api_token":"[REDACTED]","evidence_record_ids_json":"[\\"' || o_orderpriority || '\\"]","items":[{"evidence_record_id":"order-' || o_orderkey || '","evidence_record_ids":["' || o_orderstatus || '","shared"]}],"note":"see [PATH_REDACTED] now"},"id":' || o_orderkey || '}'"""


@C.add("k13_nested_redaction", f"""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN repeat('{{"w":[', 4) || {_SHOWN} || repeat(']}}', 4) ELSE {_SHOWN} END AS record FROM orders""")
def k13_nested(spark, sf):
    return nested_logs(spark, sf).select("o_orderkey", search.redact_json("record").alias("record"))


def chained_log(spark, sf):
    """One hash-chained log per priority: a record per distinct order day, built link by link."""
    days = base(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("log_id"), F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    steps = days.groupBy("log_id").agg(F.array_sort(F.collect_list(F.struct("year", "n"))).alias("s"))
    link = lambda acc, x: F.struct(
        (acc["i"] + 1).alias("i"), F.sha2(F.to_json(F.struct(x["n"].alias("n"), acc["h"].alias("previous_hash"), (acc["i"] + 1).alias("sequence"), x["year"].alias("year"))), 256).alias("h"),
        F.concat(acc["out"], F.array(F.struct((acc["i"] + 1).alias("sequence"), x["year"].alias("year"), x["n"].alias("n"), acc["h"].alias("previous_hash"),
            F.sha2(F.to_json(F.struct(x["n"].alias("n"), acc["h"].alias("previous_hash"), (acc["i"] + 1).alias("sequence"), x["year"].alias("year"))), 256).alias("record_hash")))).alias("out"))
    zero = F.struct(F.lit(0).alias("i"), F.lit(search.GENESIS).alias("h"), F.expr("CAST(array() AS array<struct<sequence:int,year:int,n:bigint,previous_hash:string,record_hash:string>>)").alias("out"))
    return steps.select("log_id", F.inline(F.aggregate("s", zero, link)["out"]))


@C.add("k14_hash_chain", "SELECT o_orderpriority AS log_id, CAST(3 AS INT) AS sequence, 'chain.hash' AS code FROM orders GROUP BY 1")
def k14(spark, sf):
    log = chained_log(spark, sf).withColumn("n", F.when(F.col("sequence") == 3, F.col("n") + 1).otherwise(F.col("n")))
    return search.verify_hash_chain(log, ["year", "n"], keys=["log_id"])


@C.add("k15_result_digest")
def k15(spark, sf):
    return search.result_digest(base(spark, sf, "orders"))
