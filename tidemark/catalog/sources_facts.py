"""Queries for sections A (sources, contracts) and B (facts, joins)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.common import Catalog, base, oracle_prelude, r, rounded, tables_of
from tidemark.operators import facts as fx
from tidemark.plans.binding import BASE_SPECS
from tidemark.sources import io
from tidemark.sources.contracts import SOURCE_SPECS, conform

C = Catalog()

# ---------------------------------------------------------------- A


@C.add("a1_load_tables", " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS row_count FROM {name}" for name in BASE_SPECS))
def a1(spark, sf):
    tables = io.load_tables(spark, sf, BASE_SPECS)
    return io.union_all([
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ])


@C.add("a2_load_derived_set", oracle_prelude("shipments", "refunds") + """
SELECT 'shipments' AS table_name, count(*) AS row_count, count(delivered_at) AS filled FROM s_shipments
UNION ALL SELECT 'refunds', count(*), count(completed_at) FROM s_refunds""")
def a2(spark, sf):
    specs = {name: SOURCE_SPECS[name] for name in ("shipments", "refunds")}
    where = io.scratch_dir(spark, "a2")
    io.write_tables(tables_of(spark, sf, *specs), where)
    loaded = io.load_tables(spark, where, specs)
    filled = {"shipments": "delivered_at", "refunds": "completed_at"}
    return io.union_all([
        df.agg(F.count(F.lit(1)).alias("row_count"), F.count(filled[name]).alias("filled"))
        .select(F.lit(name).alias("table_name"), "row_count", "filled")
        for name, df in loaded.items()
    ])


@C.add("a3_write_partitioned", f"SELECT event_type, count(*) AS row_count, {r('sum(value)', 4, 'total')} FROM events GROUP BY 1")
def a3(spark, sf):
    where = io.scratch_dir(spark, "a3")
    io.write_tables({"events": base(spark, sf, "events")}, where, compression="zstd", partition_by={"events": ["event_type"]})
    back = spark.read.parquet(f"{where}/events.parquet")
    return rounded(back.groupBy("event_type").agg(F.count(F.lit(1)).alias("row_count"), F.sum("value").alias("total")), 4)


def _profile_sql(table: str, name: str, spec_columns, times, key) -> str:
    low = ", ".join(f"min({c})" for c in times)
    high = ", ".join(f"max({c})" for c in times)
    return " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS row_count, least({low}) AS min_timestamp, greatest({high}) AS max_timestamp, "
        f"CAST({i} AS BIGINT) AS position, '{c}' AS column_name, '{kind}' AS column_type, "
        f"CAST(count(*) - count({c}) AS BIGINT) AS null_count, {str(c in key).lower()} AS is_key FROM {table}"
        for i, (c, kind) in enumerate(spec_columns)
    )


def _profile(spark, sf, *names):
    tables = tables_of(spark, sf, *names)
    return io.union_all([
        io.profile_table(df, n, SOURCE_SPECS[n].timestamp_columns, SOURCE_SPECS[n].primary_key) for n, df in tables.items()
    ])


@C.add("a4_profile_table", oracle_prelude("checkout_sessions", "shipments") + " UNION ALL ".join(
    _profile_sql(f"s_{n}", n, SOURCE_SPECS[n].fields, SOURCE_SPECS[n].timestamp_columns, SOURCE_SPECS[n].primary_key)
    for n in ("checkout_sessions", "shipments")))
def a4(spark, sf):
    return _profile(spark, sf, "checkout_sessions", "shipments")


@C.add("a5_fingerprint")
def a5(spark, sf):
    return io.union_all([io.fingerprint(df, n) for n, df in tables_of(spark, sf).items()])


@C.add("a6_verify_profiles", """
WITH e AS (SELECT count(*) AS n, min(ts) AS lo, max(ts) AS hi FROM events),
 a AS (SELECT count(*) AS n, min(ts) AS lo, max(ts) AS hi FROM events WHERE event_type <> 'error' AND value >= 1),
 full_nulls AS (SELECT CAST(0 AS BIGINT) AS z)
SELECT 'events' AS table_name, CAST(NULL AS VARCHAR) AS column_name, 'table.rows' AS code, CAST(a.n AS VARCHAR) AS actual, CAST(e.n AS VARCHAR) AS expected FROM a, e WHERE a.n <> e.n
UNION ALL SELECT 'events', 'props', 'column.missing', NULL, 'string'
UNION ALL SELECT 'events', 'user_id', 'column.type', 'int', 'bigint'
UNION ALL SELECT 'orders', NULL, 'table.missing', NULL, CAST((SELECT count(*) FROM orders) AS VARCHAR)
UNION ALL SELECT 'labels', NULL, 'table.unexpected', CAST((SELECT count(*) FROM labels) AS VARCHAR), NULL""")
def a6(spark, sf):
    events, orders, labels = (base(spark, sf, n) for n in ("events", "orders", "labels"))
    expected = io.union_all([io.profile_table(events, "events", ["ts"], ["event_id"]), io.profile_table(orders, "orders", ["o_orderdate"], ["o_orderkey"])])
    altered = events.where("event_type <> 'error' AND value >= 1").drop("props").withColumn("user_id", F.col("user_id").cast("int"))
    actual = io.union_all([io.profile_table(altered, "events", ["ts"], ["event_id"]), io.profile_table(labels, "labels")])
    found = io.verify_profiles(actual, expected)
    # The first and last event may or may not survive the filter: leave range issues to the tests.
    return found.where("code NOT IN ('table.start', 'table.end')")


@C.add("a7_load_nested_cases", """
SELECT role, count(*) AS messages, count(DISTINCT conv_id) AS cases, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY role""")
def a7(spark, sf):
    where = io.scratch_dir(spark, "a7")
    cases = base(spark, sf, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages")
    ).withColumnRenamed("conv_id", "case_id")
    io.write_jsonl(cases, where)
    loaded = io.load_cases(spark, where, "case_id bigint, messages array<struct<turn: bigint, role: string, text: string>>", multi_line=False)
    rows = loaded.select("case_id", F.inline("messages"))
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("messages"), F.countDistinct("case_id").alias("cases"), F.sum(F.length("text")).alias("chars"))


@C.add("a8_write_jsonl", "SELECT quality, toxic, count(*) AS row_count FROM labels GROUP BY 1, 2")
def a8(spark, sf):
    where = io.scratch_dir(spark, "a8")
    io.write_jsonl(base(spark, sf, "labels"), where)
    return spark.read.schema("doc_id bigint, quality int, toxic int").json(where).groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("row_count"))


@C.add("a9_register_views", oracle_prelude("orders", "shipments") + """
SELECT carrier, count(*) AS shipments, round(sum(total_amount) + 1e-4, 2) AS value
FROM s_shipments JOIN s_orders USING (order_id) GROUP BY carrier""")
def a9(spark, sf):
    io.register(spark, {"dataset": tables_of(spark, sf, "orders", "shipments")})
    return spark.sql("""SELECT carrier, count(*) AS shipments, round(sum(total_amount) + 1e-4, 2) AS value
        FROM dataset__shipments JOIN dataset__orders USING (order_id) GROUP BY carrier""")


@C.add("a10_conform", "SELECT concat('', event_id) AS event_id, ts, CAST(value AS DOUBLE) AS value, event_type FROM events")
def a10(spark, sf):
    from tidemark.sources.contracts import TableSpec

    spec = TableSpec("event_text", "event_id string, ts timestamp, value double, event_type string", ("event_id",))
    return conform(base(spark, sf, "events"), spec)


@C.add("a12_diff_tables", """
WITH b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
 CASE WHEN o_custkey % 10 = 3 THEN '9-NONE' ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderstatus <> 'F')
SELECT a.o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'left_only' ELSE 'changed' END AS status,
 CASE WHEN b.o_orderkey IS NULL THEN NULL ELSE list_filter([CASE WHEN a.o_totalprice <> b.o_totalprice THEN 'o_totalprice' END, CASE WHEN a.o_orderpriority <> b.o_orderpriority THEN 'o_orderpriority' END], lambda x: x IS NOT NULL) END AS changed_columns
FROM orders a LEFT JOIN b USING (o_orderkey)
WHERE b.o_orderkey IS NULL OR a.o_totalprice <> b.o_totalprice OR a.o_orderpriority <> b.o_orderpriority""")
def a12(spark, sf):
    a = base(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    b = a.where("o_orderstatus <> 'F'").withColumns({
        "o_totalprice": F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")),
        "o_orderpriority": F.when(F.col("o_custkey") % 10 == 3, F.lit("9-NONE")).otherwise(F.col("o_orderpriority")),
    })
    return io.diff_tables(a.drop("o_orderstatus"), b.drop("o_orderstatus"), ["o_orderkey"])


# ---------------------------------------------------------------- B

_LEFT = "customer_segment, loyalty_tier, p.category AS product_category, p.seller_id, p.warehouse_id"
FACT_SQL = {
    "session": f"SELECT s.*, {_LEFT} FROM s_checkout_sessions s LEFT JOIN s_customers c USING (customer_id) LEFT JOIN s_products p USING (product_id)",
    "checkout": """SELECT f.*, COALESCE(o.n, 0) AS order_count, COALESCE(o.v, 0) AS session_order_value,
 address_submitted_at IS NOT NULL AS address_submitted, inventory_checked_at IS NOT NULL AS inventory_checked,
 payment_started_at IS NOT NULL AS payment_started, COALESCE(o.n, 0) > 0 AS has_order
 FROM f_session f LEFT JOIN (SELECT session_id, count(*) AS n, sum(total_amount) AS v FROM s_orders GROUP BY 1) o USING (session_id)""",
    "payments": """SELECT p.*, f.region, f.channel, f.device, f.customer_type, f.app_version, f.customer_segment, f.loyalty_tier,
 f.product_category, f.seller_id, f.warehouse_id, NOT approved AS declined, COALESCE(decline_reason = 'risk_rejected', FALSE) AS risk_rejected
 FROM s_payment_attempts p LEFT JOIN f_session f USING (session_id)""",
    "orders": """SELECT o.*, f.device, f.customer_type, f.app_version, f.customer_segment, f.loyalty_tier, f.product_category, f.seller_id, f.warehouse_id,
 COALESCE(r.n, 0) AS return_request_count, COALESCE(r.n, 0) > 0 AS has_return
 FROM s_orders o LEFT JOIN f_session f USING (session_id) LEFT JOIN (SELECT order_id, count(*) AS n FROM s_returns GROUP BY 1) r USING (order_id)""",
    "order_items": """SELECT i.*, o.session_id, o.customer_id, o.ordered_at, o.region, o.channel, o.device, o.customer_type, o.app_version, o.customer_segment, o.loyalty_tier,
 p.warehouse_id, p.category AS product_category FROM s_order_items i LEFT JOIN f_orders o USING (order_id) LEFT JOIN s_products p USING (product_id)""",
    "inventory": """SELECT i.*, p.seller_id, p.category AS product_category, w.region, feed_reported_quantity = available_quantity AS inventory_exact_match,
 available_quantity <= 0 AS out_of_stock, available_quantity <= i.reorder_point AS low_stock,
 CAST(abs(feed_reported_quantity - available_quantity) AS DOUBLE) AS inventory_gap_units
 FROM s_inventory_snapshots i LEFT JOIN s_products p ON p.product_id = i.product_id AND p.warehouse_id = i.warehouse_id LEFT JOIN s_warehouses w ON w.warehouse_id = i.warehouse_id""",
    "shipments": """SELECT s.*, o.session_id, o.customer_id, o.region, o.channel, o.device, o.customer_type, o.app_version, o.customer_segment, o.loyalty_tier,
 delivered_at IS NOT NULL AS delivered, delivered_at IS NOT NULL AND NOT late AS on_time, delivered_at IS NOT NULL AND late AS late_delivered,
 date_diff('second', shipped_at, delivered_at) / 3600.0::DOUBLE AS delivery_duration_hours FROM s_shipments s LEFT JOIN f_orders o USING (order_id)""",
    "scans": """SELECT e.*, f.region, f.channel, f.device, f.customer_type, f.app_version, f.customer_segment, f.loyalty_tier
 FROM s_warehouse_scan_events e LEFT JOIN f_shipments f USING (shipment_id)""",
    "returns": """SELECT r.*, o.region, o.channel, o.device, o.customer_type, o.app_version, o.customer_segment, o.loyalty_tier,
 i.product_id, i.seller_id, p.warehouse_id, p.category AS product_category, x.a AS refund_initiated_at, x.b AS refund_completed_at,
 COALESCE(x.c, FALSE) AS refund_completed, received_at IS NOT NULL AS return_received, date_diff('second', x.a, x.b) / 3600.0::DOUBLE AS refund_processing_hours
 FROM s_returns r LEFT JOIN f_orders o USING (order_id) LEFT JOIN s_order_items i USING (order_item_id) LEFT JOIN s_products p ON p.product_id = i.product_id
 LEFT JOIN (SELECT return_id, min(initiated_at) AS a, max(completed_at) AS b, bool_or(status = 'completed') AS c FROM s_refunds GROUP BY 1) x USING (return_id)""",
    "seller_feeds": """SELECT f.*, s.home_region AS region, s.category_focus AS product_category, status = 'success' AS feed_success FROM s_seller_feed_runs f LEFT JOIN s_sellers s USING (seller_id)""",
    "pipelines": """SELECT *, status = 'success' AS pipeline_success, CAST(date_diff('second', started_at, completed_at) AS DOUBLE) AS pipeline_duration_seconds FROM s_pipeline_runs""",
    "deployments": """SELECT deployment_id, service, version, region_scope AS deployment_scope, deployed_at, status, change_type, rollback_available, status = 'success' AS deployment_success FROM s_deployments""",
}
_FACT_TABLES = {
    "session": ("checkout_sessions", "customers", "products"), "checkout": ("orders",), "payments": ("payment_attempts",),
    "orders": ("orders", "returns"), "order_items": ("order_items", "products"), "inventory": ("inventory_snapshots", "products", "warehouses"),
    "shipments": ("shipments",), "scans": ("warehouse_scan_events",), "returns": ("returns", "order_items", "products", "refunds"),
    "seller_feeds": ("seller_feed_runs", "sellers"), "pipelines": ("pipeline_runs",), "deployments": ("deployments",),
}
_FACT_NEEDS = {
    "checkout": ("session",), "payments": ("session",), "orders": ("session",), "order_items": ("session", "orders"),
    "shipments": ("session", "orders"), "scans": ("session", "orders", "shipments"), "returns": ("session", "orders"),
}


def fact_prelude(*names: str) -> str:
    """``WITH`` clause defining ``f_<name>`` for facts plus everything below them."""
    order: list[str] = []
    for name in names:
        for item in (*_FACT_NEEDS.get(name, ()), name):
            if item not in order:
                order.append(item)
    tables = [t for item in order for t in _FACT_TABLES[item]]
    return oracle_prelude(*tables) + "".join(f",\nf_{n} AS ({FACT_SQL[n]})" for n in order) + "\n"


def fact(spark, sf, name):
    return fx.FACT_BUILDERS[name](tables_of(spark, sf))


def _fact_query(key: str, name: str) -> None:
    columns = {
        "checkout": ("expected_amount", "session_order_value"), "payments": ("amount", "fraud_score"),
        "orders": ("subtotal", "discount_amount", "tax_amount", "total_amount"),
        "order_items": ("unit_price", "discount_amount", "line_total"), "inventory": ("inventory_gap_units",),
        "shipments": ("delivery_duration_hours",), "returns": ("refund_amount", "refund_processing_hours"),
        "pipelines": ("pipeline_duration_seconds",),
    }.get(name, ())
    replace = ", ".join(r(c, 4) for c in columns)
    shown = f"* REPLACE ({replace})" if replace else "*"
    C.add(key, fact_prelude(name) + f"SELECT {shown} FROM f_{name}")(
        lambda spark, sf: rounded(fact(spark, sf, name), 4)
    )


for _key, _name in (("b4_checkout_fact", "checkout"), ("b5_payments_fact", "payments"), ("b3_order_context", "orders"),
                    ("b6_order_items_fact", "order_items"), ("b7_inventory_fact", "inventory"), ("b8_shipments_fact", "shipments"),
                    ("b9_scans_fact", "scans"), ("b10_returns_fact", "returns"), ("b11_seller_feeds_fact", "seller_feeds"),
                    ("b11_flow_runs_fact", "pipelines"), ("b11_deployments_fact", "deployments")):
    _fact_query(_key, _name)


@C.add("b1_validated_join", "SELECT o_orderkey, o_custkey, c_mktsegment, o_orderpriority FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def b1(spark, sf):
    customers = base(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    orders = base(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return fx.validated_join(orders, customers, "o_custkey", validate="m:1")


@C.add("b2_session_context", fact_prelude("session") + f"SELECT * REPLACE ({r('expected_amount', 4)}) FROM f_session")
def b2(spark, sf):
    return rounded(fx.session_context(tables_of(spark, sf)), 4)


@C.add("b12_fact_cardinality", oracle_prelude(*fx.FACT_SOURCES.values()) + " UNION ALL ".join(
    f"SELECT '{f}' AS fact, count(*) AS fact_rows, count(*) AS source_rows FROM s_{s}" for f, s in fx.FACT_SOURCES.items()))
def b12(spark, sf):
    tables = tables_of(spark, sf)
    return fx.cardinalities(tables, fx.build_facts(tables))


@C.add("b13_window_filter", oracle_prelude("checkout_sessions") + """
SELECT session_id, started_at, region FROM s_checkout_sessions WHERE started_at >= TIMESTAMP '2024-01-10 00:00:00' AND started_at < TIMESTAMP '2024-01-20 00:00:00'""")
def b13(spark, sf):
    from datetime import datetime

    from tidemark.functions.columns import in_window

    sessions = tables_of(spark, sf, "checkout_sessions")["checkout_sessions"]
    return sessions.where(in_window("started_at", datetime(2024, 1, 10), datetime(2024, 1, 20))).select("session_id", "started_at", "region")


@C.add("b14_inner_dimension_join", oracle_prelude("payment_attempts", "checkout_sessions") + """
SELECT region, count(*) AS attempts, CAST(sum(CASE WHEN approved THEN 0 ELSE 1 END) AS BIGINT) AS declines
FROM s_payment_attempts JOIN s_checkout_sessions USING (session_id) GROUP BY region""")
def b14(spark, sf):
    t = tables_of(spark, sf, "payment_attempts", "checkout_sessions")
    joined = t["payment_attempts"].join(t["checkout_sessions"].select("session_id", "region"), "session_id")
    return joined.groupBy("region").agg(F.count(F.lit(1)).alias("attempts"), F.sum((~F.col("approved")).cast("bigint")).alias("declines"))


@C.add("b15_unmatched_keys", "SELECT DISTINCT o_orderkey AS o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def b15(spark, sf):
    return fx.unmatched_keys(base(spark, sf, "orders"), "o_orderkey", base(spark, sf, "lineitem"), "l_orderkey")


@C.add("b16_full_outer", """
SELECT COALESCE(a.k, b.k) AS k, a.orders, b.errors FROM (SELECT o_custkey AS k, count(*) AS orders FROM orders GROUP BY 1) a
FULL JOIN (SELECT user_id AS k, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1) b ON a.k = b.k""")
def b16(spark, sf):
    a = base(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("orders"))
    b = base(spark, sf, "events").where("event_type = 'error'").groupBy(F.col("user_id").alias("k")).agg(F.count(F.lit(1)).alias("errors"))
    return fx.full_outer(a, b, ["k"])


@C.add("b17_membership", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase') AND o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def b17(spark, sf):
    buyers = base(spark, sf, "events").where("event_type = 'purchase'").select("user_id")
    orders = fx.member_of(base(spark, sf, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"])
    return fx.member_of(orders, "o_custkey", buyers).select("o_orderkey", "o_custkey")
