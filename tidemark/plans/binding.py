"""Derive the 17 linked commerce tables from the star-schema test tables.

Each derivation is one SQL statement in the common subset of Spark SQL and
ANSI SQL, so the same text can also prefix an oracle query as a CTE.  Two
tokens are filled in per dialect: ``TS'...'`` is a zone-free timestamp literal.
Order days are folded onto 60 days from 2024-01-01 so that hourly series are
dense; row counts follow the given tables one to one.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.shared import shared
from tidemark.sources.contracts import SOURCE_SPECS, TableSpec, conform

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

BASE_SPECS: dict[str, TableSpec] = {
    name: TableSpec(name, ddl, (key,))
    for name, key, ddl in (
        ("region", "r_regionkey", "r_regionkey int, r_name string"),
        ("nation", "n_nationkey", "n_nationkey int, n_name string, n_regionkey int"),
        ("customer", "c_custkey", "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        ("supplier", "s_suppkey", "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"),
        ("part", "p_partkey", "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        ("orders", "o_orderkey", "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        ("lineitem", "l_orderkey", "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
        ("events", "event_id", "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"),
        ("documents", "doc_id", "doc_id bigint, text string, lang string, source string, n_chars bigint"),
        ("pages", "page_id", "page_id bigint, url string, html string"),
        ("benchmark", "item_id", "item_id bigint, text string"),
        ("labels", "doc_id", "doc_id bigint, quality int, toxic int"),
        ("conversations", "conv_id", "conv_id bigint, turn bigint, role string, text string"),
    )
}

DERIVED_SQL: dict[str, str] = {
    "s_customers": """
SELECT concat('C', c_custkey) AS customer_id,
       TS'2023-01-01 00:00:00' + (c_custkey * 37 % 360) * INTERVAL '1' DAY AS created_at,
       r_name AS home_region,
       CASE c_custkey % 3 WHEN 0 THEN 'android' WHEN 1 THEN 'ios' ELSE 'web' END AS preferred_device,
       CASE c_custkey % 2 WHEN 0 THEN 'card' ELSE 'wallet' END AS preferred_payment_method,
       concat('bank-', c_custkey % 4) AS issuer,
       CASE WHEN c_acctbal > 5e3 THEN 'gold' WHEN c_acctbal > 1e3 THEN 'silver' ELSE 'standard' END AS loyalty_tier,
       CASE c_custkey % 2 WHEN 0 THEN 'organic' ELSE 'paid_search' END AS acquisition_channel,
       c_mktsegment AS customer_segment,
       (c_custkey % 100) / 1e2 AS baseline_activity_score,
       (c_custkey % 50) / 5e1 AS baseline_price_sensitivity,
       (c_custkey % 20) / 1e2 AS baseline_return_propensity
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "s_sellers": """
SELECT concat('SL', s_suppkey) AS seller_id, s_name AS seller_name, r_name AS home_region,
       CASE s_suppkey % 4 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'PROMO' WHEN 2 THEN 'STANDARD' ELSE 'MEDIUM' END AS category_focus,
       CASE WHEN s_acctbal > 5e3 THEN 'premier' ELSE 'basic' END AS seller_tier,
       (s_suppkey % 50) / 1e1 AS rating,
       CASE s_suppkey % 2 WHEN 0 THEN 'csv' ELSE 'json' END AS feed_format,
       'v1' AS feed_schema_version, (s_suppkey % 10) / 1e1 AS feed_reliability,
       TS'2022-01-01 00:00:00' + (s_suppkey % 300) * INTERVAL '1' DAY AS joined_at
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "s_warehouses": """
SELECT concat('W', n_nationkey) AS warehouse_id, r_name AS region,
       CAST(1000 + n_nationkey * 40 AS BIGINT) AS capacity_units, CAST(1 + n_nationkey % 3 AS BIGINT) AS service_level_days,
       (90 + n_nationkey % 10) / 1e2 AS scan_reliability, TS'2020-01-01 00:00:00' AS active_from
FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "s_products": """
SELECT concat('P', p_partkey) AS product_id,
       concat('SL', p_partkey % (SELECT count(*) FROM supplier)) AS seller_id,
       concat('W', p_partkey % (SELECT count(*) FROM nation)) AS warehouse_id,
       p_type AS category, p_retailprice AS base_price, p_retailprice * 6e-1 AS unit_cost,
       (p_partkey % 10) / 1e1 AS demand_weight, (p_size % 10) / 1e2 AS return_propensity,
       CAST(60 AS BIGINT) AS reorder_point, TS'2021-01-01 00:00:00' AS active_from
FROM part""",
    "s_promotions": """
SELECT concat('PR', n_nationkey) AS promotion_id, concat('Promotion ', n_name) AS promotion_name,
       'email' AS channel, r_name AS region, 'PROMO' AS category,
       TS'2024-01-01 00:00:00' AS start_at, TS'2024-03-01 00:00:00' AS end_at,
       (n_nationkey % 5) / 2e1 AS discount_pct, 1e4 AS budget
FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "s_order_totals": """
SELECT l_orderkey AS total_orderkey, count(*) AS item_count, sum(l_extendedprice) AS subtotal,
       sum(l_extendedprice * l_discount) AS discount_amount,
       sum(l_extendedprice * (1 - l_discount) * l_tax) AS tax_amount
FROM lineitem GROUP BY l_orderkey""",
    "s_session_base": """
SELECT o_orderkey AS k, o_custkey AS ck, o_totalprice AS price, customer_segment AS seg, home_region AS region,
       o_orderkey * 31 % (SELECT count(*) FROM part) AS pk,
       TS'2024-01-01 00:00:00'
         + ((EXTRACT(DOY FROM o_orderdate) + EXTRACT(YEAR FROM o_orderdate) * 365) % 60) * INTERVAL '1' DAY
         + (o_orderkey * 7919 % 86400) * INTERVAL '1' SECOND AS started_at,
       CASE WHEN o_orderkey * 104729 % 1000 < 620 THEN 'order_completed'
            WHEN o_orderkey * 104729 % 1000 < 720 THEN 'payment_started'
            WHEN o_orderkey * 104729 % 1000 < 780 THEN 'inventory_confirmed'
            WHEN o_orderkey * 104729 % 1000 < 840 THEN 'inventory_checked'
            WHEN o_orderkey * 104729 % 1000 < 920 THEN 'address_submitted'
            ELSE 'checkout_started' END AS stage
FROM orders JOIN s_customers ON customer_id = concat('C', o_custkey)""",
    "s_checkout_sessions": """
SELECT concat('S', k) AS session_id, concat('C', ck) AS customer_id, concat('P', pk) AS product_id,
       CASE WHEN k % 4 = 0 THEN concat('PR', k % (SELECT count(*) FROM nation)) END AS promotion_id,
       CASE WHEN k % 5 > 1 THEN concat('CMP', k % 7) END AS campaign_id,
       region,
       CASE k % 3 WHEN 0 THEN 'android' WHEN 1 THEN 'ios' ELSE 'web' END AS device,
       CASE k % 5 WHEN 0 THEN 'organic' WHEN 1 THEN 'direct' WHEN 2 THEN 'paid_search' WHEN 3 THEN 'email' ELSE 'social' END AS channel,
       CASE ck % 2 WHEN 0 THEN 'new' ELSE 'returning' END AS customer_type,
       concat('1.', k % 4) AS app_version,
       started_at,
       CASE WHEN stage <> 'checkout_started' THEN started_at + (20 + k % 90) * INTERVAL '1' SECOND END AS address_submitted_at,
       CASE WHEN stage NOT IN ('checkout_started', 'address_submitted') THEN started_at + (120 + k % 60) * INTERVAL '1' SECOND END AS inventory_checked_at,
       CASE WHEN stage IN ('payment_started', 'order_completed') THEN started_at + (200 + k % 100) * INTERVAL '1' SECOND END AS payment_started_at,
       CASE WHEN stage = 'order_completed' THEN started_at + (320 + k % 200) * INTERVAL '1' SECOND END AS completed_at,
       stage AS stage_reached,
       CASE stage WHEN 'checkout_started' THEN 'customer_abandoned' WHEN 'address_submitted' THEN 'address_validation_failed'
            WHEN 'inventory_checked' THEN 'inventory_unavailable' WHEN 'inventory_confirmed' THEN 'before_payment'
            WHEN 'payment_started' THEN 'payment_declined' END AS abandonment_reason,
       price AS expected_amount
FROM s_session_base""",
    "s_orders": """
SELECT concat('O', k) AS order_id, concat('S', k) AS session_id, concat('C', ck) AS customer_id,
       concat('PA', k) AS payment_attempt_id, started_at + (320 + k % 200) * INTERVAL '1' SECOND AS ordered_at,
       region,
       CASE k % 5 WHEN 0 THEN 'organic' WHEN 1 THEN 'direct' WHEN 2 THEN 'paid_search' WHEN 3 THEN 'email' ELSE 'social' END AS channel,
       CASE WHEN k % 5 > 1 THEN concat('CMP', k % 7) END AS campaign_id,
       'completed' AS status,
       COALESCE(subtotal, 0e0) AS subtotal, COALESCE(discount_amount, 0e0) AS discount_amount,
       COALESCE(tax_amount, 0e0) AS tax_amount, 5e0 AS shipping_amount,
       COALESCE(subtotal, 0e0) - COALESCE(discount_amount, 0e0) + COALESCE(tax_amount, 0e0) + 5e0 AS total_amount,
       'USD' AS currency, CAST(COALESCE(item_count, 0) AS BIGINT) AS item_count
FROM s_session_base LEFT JOIN s_order_totals ON total_orderkey = k
WHERE stage = 'order_completed'""",
    "s_payment_attempts": """
SELECT concat('PA', k) AS payment_attempt_id, concat('S', k) AS session_id, concat('C', ck) AS customer_id,
       CASE k % 3 WHEN 0 THEN 'card' WHEN 1 THEN 'wallet' ELSE 'transfer' END AS payment_method,
       concat('bank-', ck % 4) AS issuer, concat('processor-', k % 2) AS processor,
       started_at + (205 + k % 100) * INTERVAL '1' SECOND AS attempted_at,
       COALESCE(total_amount, price) AS amount, 'USD' AS currency,
       stage = 'order_completed' AS approved,
       CASE WHEN stage = 'payment_started' THEN CASE k % 3 WHEN 0 THEN 'risk_rejected' ELSE 'insufficient_funds' END END AS decline_reason,
       CAST(80 + k * 13 % 900 AS BIGINT) AS latency_ms, (k % 100) / 1e2 AS fraud_score, '17' AS fraud_rule_version
FROM s_session_base LEFT JOIN s_orders ON order_id = concat('O', k)
WHERE stage IN ('payment_started', 'order_completed')""",
    "s_order_items": """
SELECT concat('OI', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', CAST(round(l_extendedprice * 100) AS BIGINT)) AS order_item_id,
       order_id, concat('P', l_partkey) AS product_id, concat('SL', l_suppkey) AS seller_id,
       CAST(l_quantity AS BIGINT) AS quantity, l_extendedprice / l_quantity AS unit_price,
       l_extendedprice * l_discount AS discount_amount, l_extendedprice * (1 - l_discount) AS line_total
FROM lineitem JOIN s_orders ON order_id = concat('O', l_orderkey)""",
    "s_inventory_snapshots": """
SELECT concat('IS', event_id) AS snapshot_id,
       concat('P', event_id * 17 % (SELECT count(*) FROM part)) AS product_id,
       concat('W', event_id * 17 % (SELECT count(*) FROM part) % (SELECT count(*) FROM nation)) AS warehouse_id,
       ts AS snapshot_at, CAST(60 + event_id % 200 AS BIGINT) AS on_hand_quantity,
       CAST(event_id % 61 AS BIGINT) AS reserved_quantity,
       CAST(60 + event_id % 200 - event_id % 61 AS BIGINT) AS available_quantity,
       CAST(60 AS BIGINT) AS reorder_point,
       CAST(60 + event_id % 200 - event_id % 61 + CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END AS BIGINT) AS feed_reported_quantity
FROM events""",
    "s_shipments": """
SELECT concat('SH', k) AS shipment_id, concat('O', k) AS order_id,
       concat('W', pk % (SELECT count(*) FROM nation)) AS warehouse_id,
       concat('carrier-', k % 3) AS carrier, CASE k % 2 WHEN 0 THEN 'standard' ELSE 'express' END AS delivery_service,
       started_at + (4 + k % 20) * INTERVAL '1' HOUR AS shipped_at,
       started_at + (76 + k % 20) * INTERVAL '1' HOUR AS promised_delivery_at,
       CASE WHEN k % 17 <> 0 THEN started_at + (28 + k % 20 + k * 7 % 60) * INTERVAL '1' HOUR END AS delivered_at,
       CASE WHEN k % 17 <> 0 THEN 'delivered' ELSE 'in_transit' END AS status,
       CAST(3 AS BIGINT) AS scan_count, 24 + k * 7 % 60 > 72 AS late
FROM s_session_base WHERE stage = 'order_completed'""",
    "s_scan_steps": """
SELECT shipment_id, order_id, warehouse_id, 'picked' AS event_type, 1 AS n, shipped_at - INTERVAL '2' HOUR AS step_at FROM s_shipments
UNION ALL SELECT shipment_id, order_id, warehouse_id, 'packed', 2, shipped_at - INTERVAL '1' HOUR FROM s_shipments
UNION ALL SELECT shipment_id, order_id, warehouse_id, 'shipped', 3, shipped_at FROM s_shipments""",
    "s_warehouse_scan_events": """
SELECT concat(shipment_id, '-', n) AS scan_event_id, shipment_id, order_id, warehouse_id, event_type,
       CAST(n AS BIGINT) AS sequence_number, step_at AS source_event_at,
       step_at + (30 + CAST(substring(shipment_id, 3) AS BIGINT) * n * 13 % 600) * INTERVAL '1' SECOND AS platform_received_at,
       30 + CAST(substring(shipment_id, 3) AS BIGINT) * n * 13 % 600 AS ingestion_lag_seconds,
       CAST(30 AS BIGINT) AS connector_batch_seconds
FROM s_scan_steps""",
    "s_returns": """
SELECT concat('RT', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', CAST(round(l_extendedprice * 100) AS BIGINT)) AS return_id,
       order_id,
       concat('OI', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', CAST(round(l_extendedprice * 100) AS BIGINT)) AS order_item_id,
       customer_id, ordered_at + (5 + l_partkey % 10) * INTERVAL '1' DAY AS requested_at,
       CASE WHEN l_linenumber % 5 <> 0 THEN ordered_at + (8 + l_partkey % 10) * INTERVAL '1' DAY END AS received_at,
       CASE l_suppkey % 3 WHEN 0 THEN 'damaged' WHEN 1 THEN 'wrong_item' ELSE 'changed_mind' END AS reason,
       CASE WHEN l_linenumber % 5 <> 0 THEN 'received' ELSE 'requested' END AS status,
       l_extendedprice * (1 - l_discount) AS refund_amount
FROM lineitem JOIN s_orders ON order_id = concat('O', l_orderkey) WHERE l_returnflag = 'R'""",
    "s_refunds": """
SELECT concat('RF', substring(return_id, 3)) AS refund_id, return_id, order_id,
       received_at + INTERVAL '2' HOUR AS initiated_at,
       CASE WHEN length(return_id) % 11 <> 0 THEN received_at + (8 + CAST(substring(order_id, 2) AS BIGINT) % 90) * INTERVAL '1' HOUR END AS completed_at,
       CASE WHEN length(return_id) % 11 <> 0 THEN 'completed' ELSE 'pending' END AS status,
       refund_amount AS amount, concat('processor-', CAST(substring(order_id, 2) AS BIGINT) % 2) AS processor
FROM s_returns WHERE received_at IS NOT NULL""",
    "s_seller_feed_runs": """
SELECT concat('FR', event_id) AS feed_run_id, concat('SL', event_id % (SELECT count(*) FROM supplier)) AS seller_id,
       ts AS started_at, ts + (20 + event_id % 300) * INTERVAL '1' SECOND AS completed_at, 'v1' AS schema_version,
       CAST(100 + event_id % 900 AS BIGINT) AS records_received,
       CAST(event_id % 5 + CASE WHEN event_type = 'error' THEN 30 ELSE 0 END AS BIGINT) AS records_rejected,
       CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
       CAST(20 + event_id % 300 AS BIGINT) AS latency_seconds
FROM events""",
    "s_pipeline_runs": """
SELECT concat('PL', event_id) AS pipeline_run_id, concat('flow-', user_id % 4) AS pipeline_name, ts AS started_at,
       ts + (60 + event_id % 1200) * INTERVAL '1' SECOND AS completed_at,
       CAST(1000 + event_id % 5000 AS BIGINT) AS input_rows,
       CAST(1000 + event_id % 5000 - event_id % 7 - CASE WHEN event_type = 'error' THEN 150 ELSE 0 END AS BIGINT) AS output_rows,
       CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
       event_type <> 'error' AS data_quality_passed, concat('r', event_id % 3) AS code_version
FROM events""",
    "s_deployments": """
SELECT concat('DP', event_id) AS deployment_id,
       CASE user_id % 3 WHEN 0 THEN 'checkout-service' WHEN 1 THEN 'payment-service' ELSE 'data-platform' END AS service,
       concat('2.', event_id % 10) AS version,
       CASE user_id % 4 WHEN 0 THEN 'global' WHEN 1 THEN 'ASIA' WHEN 2 THEN 'EUROPE' ELSE 'AMERICA' END AS region_scope,
       ts AS deployed_at, CASE WHEN value > 1e2 THEN 'failed' ELSE 'success' END AS status,
       CASE user_id % 2 WHEN 0 THEN 'configuration' ELSE 'release' END AS change_type, event_id % 2 = 0 AS rollback_available
FROM events WHERE event_type = 'signup'""",
}


def _dependencies(name: str) -> list[str]:
    """Derived tables needed by ``name``, dependencies first."""
    seen: list[str] = []

    def visit(item: str) -> None:
        for word in re.findall(r"\bs_\w+", DERIVED_SQL[item]):
            if word in DERIVED_SQL and word != item and word not in seen:
                visit(word)
        if item not in seen:
            seen.append(item)

    visit(name)
    return seen


def oracle_prelude(*names: str) -> str:
    """``WITH`` clause defining the named derived tables (``s_`` prefix implied)."""
    ordered: list[str] = []
    for name in names:
        for item in _dependencies(name if name.startswith("s_") else f"s_{name}"):
            if item not in ordered:
                ordered.append(item)
    body = ",\n".join(f"{n} AS ({DERIVED_SQL[n].strip()})" for n in ordered)
    return "WITH " + body.replace("TS'", "TIMESTAMP '")


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Derivations with a join or an aggregate are published once and read by those built on them; the
# others are projections of one published or given table, which would only repeat its bytes.
KEPT = ("s_customers", "s_sellers", "s_warehouses", "s_products", "s_promotions", "s_session_base", "s_orders",
        "s_payment_attempts", "s_order_items", "s_returns")


_VIEWS: dict[tuple[str, str], dict[str, DataFrame]] = {}


def _words(item: str) -> list[str]:
    """The tables that a derivation reads, given ones and derived ones."""
    named = dict.fromkeys(re.findall(r"\b\w+", DERIVED_SQL[item]))
    return [word for word in named if word != item and (word in DERIVED_SQL or word in BASE_TABLES[:8])]


def _bind(spark: SparkSession, sf_dir: str, item: str, done: set[str]) -> DataFrame:
    """Make the view ``item`` of this folder; a table that is not known yet is derived from views that it names.

    Tables are kept by folder, so that each given one is opened and each statement analysed once.
    """
    views = _VIEWS.setdefault((spark.sparkContext.applicationId, sf_dir), {})

    def build() -> DataFrame:
        if item in BASE_TABLES:
            return base(spark, sf_dir, item)
        for word in _words(item):
            _bind(spark, sf_dir, word, done)
        return spark.sql(DERIVED_SQL[item].replace("TS'", "TIMESTAMP_NTZ '"))

    if item not in views:
        views[item] = shared(spark, sf_dir, item, build) if item in KEPT else build()
    if item not in done:
        views[item].createOrReplaceTempView(item)
        done.add(item)
    return views[item]


_BOUND: dict[tuple[str, str], dict[str, DataFrame]] = {}


def commerce_tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """Conformed source tables (all 17 when no names are given)."""
    bound = _BOUND.setdefault((spark.sparkContext.applicationId, sf_dir), {})
    wanted = names or tuple(SOURCE_SPECS)
    done: set[str] = set()
    for name in wanted:
        if name not in bound:
            bound[name] = conform(_bind(spark, sf_dir, f"s_{name}", done), SOURCE_SPECS[name])
    return {name: bound[name] for name in wanted}
