"""Table contracts: ordered typed columns, keys, foreign keys and timestamps.

Column lists, keys and names in this module are fixed values: they are the
published data model that every table set must follow.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = (
    "region", "device", "channel", "customer_type", "app_version", "issuer",
    "payment_method", "processor", "customer_segment", "loyalty_tier",
    "product_category", "seller_id", "warehouse_id", "pipeline_name", "service",
    "deployment_scope",
)

_DIMS_DDL = ", ".join(f"{name} string" for name in DIMENSIONS)


@dataclass(frozen=True)
class ForeignKey:
    column: str
    target_table: str
    target_column: str
    nullable: bool = False


@dataclass(frozen=True)
class TableSpec:
    """Ordered columns plus keys.  ``timestamp`` in the DDL means UTC wall time."""

    name: str
    ddl: str
    primary_key: tuple[str, ...]
    foreign_keys: tuple[ForeignKey, ...] = ()
    may_be_empty: bool = False

    @property
    def fields(self) -> tuple[tuple[str, str], ...]:
        """``(column, type)`` pairs in canonical order."""
        parts = (part.strip().split(" ", 1) for part in self.ddl.split(","))
        return tuple(
            (name, "timestamp_ntz" if kind == "timestamp" else kind) for name, kind in parts
        )

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(name for name, _ in self.fields)

    @property
    def timestamp_columns(self) -> tuple[str, ...]:
        return tuple(name for name, kind in self.fields if kind == "timestamp_ntz")

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(", ".join(f"`{n}` {k}" for n, k in self.fields))


def _spec(name: str, ddl: str, key: str, *fks: tuple[str, ...], empty: bool = False) -> TableSpec:
    keys = tuple(
        ForeignKey(fk[0], fk[1], fk[2], len(fk) > 3) for fk in fks
    )
    return TableSpec(name, ddl.replace("<16 dimensions>", _DIMS_DDL), tuple(key.split()), keys, empty)


SOURCE_SPECS: dict[str, TableSpec] = {
    spec.name: spec
    for spec in (
        _spec("customers", "customer_id string, created_at timestamp, home_region string, preferred_device string, preferred_payment_method string, issuer string, loyalty_tier string, acquisition_channel string, customer_segment string, baseline_activity_score double, baseline_price_sensitivity double, baseline_return_propensity double", "customer_id"),
        _spec("sellers", "seller_id string, seller_name string, home_region string, category_focus string, seller_tier string, rating double, feed_format string, feed_schema_version string, feed_reliability double, joined_at timestamp", "seller_id"),
        _spec("warehouses", "warehouse_id string, region string, capacity_units bigint, service_level_days bigint, scan_reliability double, active_from timestamp", "warehouse_id"),
        _spec("products", "product_id string, seller_id string, warehouse_id string, category string, base_price double, unit_cost double, demand_weight double, return_propensity double, reorder_point bigint, active_from timestamp", "product_id", ("seller_id", "sellers", "seller_id"), ("warehouse_id", "warehouses", "warehouse_id")),
        _spec("promotions", "promotion_id string, promotion_name string, channel string, region string, category string, start_at timestamp, end_at timestamp, discount_pct double, budget double", "promotion_id", empty=True),
        _spec("checkout_sessions", "session_id string, customer_id string, product_id string, promotion_id string, campaign_id string, region string, device string, channel string, customer_type string, app_version string, started_at timestamp, address_submitted_at timestamp, inventory_checked_at timestamp, payment_started_at timestamp, completed_at timestamp, stage_reached string, abandonment_reason string, expected_amount double", "session_id", ("customer_id", "customers", "customer_id"), ("product_id", "products", "product_id"), ("promotion_id", "promotions", "promotion_id", "nullable")),
        _spec("payment_attempts", "payment_attempt_id string, session_id string, customer_id string, payment_method string, issuer string, processor string, attempted_at timestamp, amount double, currency string, approved boolean, decline_reason string, latency_ms bigint, fraud_score double, fraud_rule_version string", "payment_attempt_id", ("session_id", "checkout_sessions", "session_id"), ("customer_id", "customers", "customer_id")),
        _spec("orders", "order_id string, session_id string, customer_id string, payment_attempt_id string, ordered_at timestamp, region string, channel string, campaign_id string, status string, subtotal double, discount_amount double, tax_amount double, shipping_amount double, total_amount double, currency string, item_count bigint", "order_id", ("session_id", "checkout_sessions", "session_id"), ("customer_id", "customers", "customer_id"), ("payment_attempt_id", "payment_attempts", "payment_attempt_id")),
        _spec("order_items", "order_item_id string, order_id string, product_id string, seller_id string, quantity bigint, unit_price double, discount_amount double, line_total double", "order_item_id", ("order_id", "orders", "order_id"), ("product_id", "products", "product_id"), ("seller_id", "sellers", "seller_id")),
        _spec("inventory_snapshots", "snapshot_id string, product_id string, warehouse_id string, snapshot_at timestamp, on_hand_quantity bigint, reserved_quantity bigint, available_quantity bigint, reorder_point bigint, feed_reported_quantity bigint", "snapshot_id", ("product_id", "products", "product_id"), ("warehouse_id", "warehouses", "warehouse_id")),
        _spec("shipments", "shipment_id string, order_id string, warehouse_id string, carrier string, delivery_service string, shipped_at timestamp, promised_delivery_at timestamp, delivered_at timestamp, status string, scan_count bigint, late boolean", "shipment_id", ("order_id", "orders", "order_id"), ("warehouse_id", "warehouses", "warehouse_id")),
        _spec("warehouse_scan_events", "scan_event_id string, shipment_id string, order_id string, warehouse_id string, event_type string, sequence_number bigint, source_event_at timestamp, platform_received_at timestamp, ingestion_lag_seconds bigint, connector_batch_seconds bigint", "scan_event_id", ("shipment_id", "shipments", "shipment_id"), ("order_id", "orders", "order_id"), ("warehouse_id", "warehouses", "warehouse_id")),
        _spec("returns", "return_id string, order_id string, order_item_id string, customer_id string, requested_at timestamp, received_at timestamp, reason string, status string, refund_amount double", "return_id", ("order_id", "orders", "order_id"), ("order_item_id", "order_items", "order_item_id"), ("customer_id", "customers", "customer_id"), empty=True),
        _spec("refunds", "refund_id string, return_id string, order_id string, initiated_at timestamp, completed_at timestamp, status string, amount double, processor string", "refund_id", ("return_id", "returns", "return_id"), ("order_id", "orders", "order_id"), empty=True),
        _spec("seller_feed_runs", "feed_run_id string, seller_id string, started_at timestamp, completed_at timestamp, schema_version string, records_received bigint, records_rejected bigint, status string, latency_seconds bigint", "feed_run_id", ("seller_id", "sellers", "seller_id")),
        _spec("pipeline_runs", "pipeline_run_id string, pipeline_name string, started_at timestamp, completed_at timestamp, input_rows bigint, output_rows bigint, status string, data_quality_passed boolean, code_version string", "pipeline_run_id"),
        _spec("deployments", "deployment_id string, service string, version string, region_scope string, deployed_at timestamp, status string, change_type string, rollback_available boolean", "deployment_id"),
    )
}

ANALYTICS_SPECS: dict[str, TableSpec] = {
    spec.name: spec
    for spec in (
        _spec("metric_observations", "metric_name string, display_name string, domain string, metric_type string, unit string, higher_is_better boolean, time_grain string, period_start timestamp, period_end timestamp, cohort_name string, dimension_count bigint, <16 dimensions>, value double, numerator double, denominator double, sample_size bigint, quality_status string", "metric_name time_grain period_start cohort_name " + " ".join(DIMENSIONS)),
        _spec("funnel_observations", "time_grain string, period_start timestamp, period_end timestamp, cohort_name string, dimension_count bigint, <16 dimensions>, stage_order bigint, stage_name string, stage_count bigint, previous_stage_count bigint, conversion_from_previous double, conversion_from_start double, drop_off_count bigint, drop_off_rate double, quality_status string", "time_grain period_start cohort_name " + " ".join(DIMENSIONS) + " stage_name"),
        _spec("contribution_observations", "analysis_name string, metric_name string, time_grain string, baseline_period_start timestamp, baseline_period_end timestamp, current_period_start timestamp, current_period_end timestamp, dimension_name string, cohort_value string, baseline_numerator double, baseline_denominator double, baseline_rate double, current_numerator double, current_denominator double, current_rate double, baseline_share double, current_share double, rate_effect double, mix_effect double, total_contribution double, overall_change double, contribution_share double, direction string, quality_status string", "analysis_name baseline_period_start current_period_start cohort_value"),
        _spec("data_quality_results", "check_name string, category string, severity string, status string, metric_name string, time_grain string, period_start timestamp, cohort_name string, observed_value double, expected string, details string", "check_name"),
    )
}

DETECTION_SPECS: dict[str, TableSpec] = {
    spec.name: spec
    for spec in (
        _spec("detector_observations", "observation_id string, series_id string, metric_name string, display_name string, domain string, metric_type string, unit string, higher_is_better boolean, time_grain string, period_start timestamp, period_end timestamp, cohort_name string, dimension_count bigint, <16 dimensions>, observed_value double, expected_value double, expected_lower double, expected_upper double, numerator double, denominator double, sample_size bigint, baseline_points bigint, seasonal_points bigint, baseline_method string, baseline_last_period timestamp, robust_scale double, residual double, absolute_change double, relative_change double, robust_z double, distribution_name string, p_value double, q_value double, cusum_score double, change_detected boolean, estimated_change_start timestamp, sequential_log_likelihood double, sequential_alert boolean, support_robust_deviation boolean, support_fdr_significance boolean, support_cusum boolean, support_sequential boolean, detector_support_count bigint, sample_size_gate_passed boolean, effect_size_gate_passed boolean, history_gate_passed boolean, alert_reason_codes string, is_eligible boolean, is_anomaly boolean, direction string, impact_direction string, severity string, evidence_score double, source_quality_status string, scenario_id string", "observation_id"),
        _spec("anomaly_events", "event_id string, series_id string, metric_name string, time_grain string, cohort_name string, <16 dimensions>, started_at timestamp, ended_at timestamp, first_detected_at timestamp, peak_at timestamp, observation_count bigint, max_evidence_score double, minimum_q_value double, max_absolute_z double, max_absolute_relative_change double, direction string, impact_direction string, severity string, scenario_ids string", "event_id", empty=True),
        _spec("change_point_events", "change_event_id string, series_id string, metric_name string, time_grain string, cohort_name string, <16 dimensions>, detected_at timestamp, estimated_start_at timestamp, direction string, cusum_score double, robust_z double, scenario_id string", "change_event_id", empty=True),
        _spec("benchmark_ground_truth", "scenario_id string, metric_name string, time_grain string, cohort_name string, <16 dimensions>, started_at timestamp, ended_at timestamp, kind string, magnitude double, expected_direction string, injected_points bigint", "scenario_id", empty=True),
        _spec("benchmark_results", "scenario_id string, detected boolean, first_detected_at timestamp, detection_delay_periods bigint, expected_direction string, direction_match boolean, true_positive_points bigint, false_negative_points bigint, peak_evidence_score double, matched_event_id string", "scenario_id", empty=True),
        _spec("benchmark_summary", "scope string, scenario_count bigint, scenarios_detected bigint, observation_true_positives bigint, observation_false_positives bigint, observation_false_negatives bigint, eligible_non_scenario_points bigint, precision double, scenario_recall double, point_recall double, false_positive_rate double, mean_detection_delay_periods double, median_detection_delay_periods double", "scope", empty=True),
        _spec("detection_quality_results", "check_name string, category string, severity string, status string, observed_value double, expected string, details string", "check_name"),
    )
}

IMPACT_SPECS: dict[str, TableSpec] = {
    spec.name: spec
    for spec in (
        _spec("customer_features", "customer_id string, index_at timestamp, home_region string, customer_segment string, exposed boolean, exposure_interactions bigint, tenure_days double, recency_days double, pre_orders bigint, post_orders bigint, pre_spend double, average_order_value double, order_frequency_30d double, pre_purchase_rate double, post_purchase_rate double, failed_checkout_count bigint, payment_decline_count bigint, late_delivery_count bigint, return_count bigint, refund_count bigint, discount_share double, category_diversity bigint, baseline_ltv double, control_event_days double, treated_event_days double, observed_event_days double, event_observed boolean, churned boolean, control_churned boolean, treated_churned boolean, benchmark_effect_applied boolean", "customer_id"),
        _spec("survival_curves", "group string, time_days double, at_risk bigint, events bigint, censored bigint, survival_probability double, lower_ci double, upper_ci double", "group time_days"),
        _spec("cox_coefficients", "feature string, coefficient double, standard_error double, hazard_ratio double, lower_ci double, upper_ci double, z_value double, p_value double", "feature"),
        _spec("propensity_scores", "customer_id string, exposed boolean, propensity_score double, stabilized_weight double, matched_customer_id string, matched boolean", "customer_id"),
        _spec("causal_estimates", "estimator string, estimand string, estimate double, standard_error double, lower_ci double, upper_ci double, sample_size bigint, treated_count bigint, control_count bigint, placebo boolean", "estimator"),
        _spec("segment_impact", "segment_name string, segment_value string, customers bigint, exposed_customers bigint, observed_churn_rate double, weighted_incremental_churn double, revenue_at_risk double", "segment_name segment_value"),
        _spec("financial_impact", "impact_id string, exposed_customers bigint, immediate_failed_interactions bigint, immediate_revenue_loss double, support_and_recovery_cost double, incremental_churn_rate double, incremental_churn_customers double, future_revenue_at_risk double, future_margin_at_risk double, total_financial_impact double, lower_ci double, upper_ci double, benchmark_true_att double", "impact_id"),
        _spec("model_metrics", "model string, metric string, value double", "model metric"),
        _spec("impact_quality_results", "check_name string, severity string, status string, observed_value double, expected string, details string", "check_name"),
    )
}

EVIDENCE_SPECS: dict[str, TableSpec] = {
    spec.name: spec
    for spec in (
        _spec("evidence_records", "evidence_record_id string, evidence_type string, source_name string, source_ref string, observed_at timestamp, valid_from timestamp, valid_to timestamp, service string, component string, region string, environment string, severity string, trust_level string, evidence_role string, title string, summary string, payload_json string, content_sha256 string, incident_id string", "evidence_record_id"),
        _spec("config_changes", "change_id string, change_type string, service string, key string, old_value string, new_value string, region_scope string, changed_at timestamp, actor string, approved boolean, rollback_available boolean, evidence_role string, description string, evidence_record_id string", "change_id", empty=True),
        _spec("feature_flag_states", "flag_state_id string, flag_key string, value string, service string, region_scope string, valid_from timestamp, valid_to timestamp, changed_by string, evidence_role string, description string, evidence_record_id string", "flag_state_id", empty=True),
        _spec("service_health", "health_observation_id string, service string, component string, region string, observed_at timestamp, window_minutes bigint, request_count bigint, error_count bigint, error_rate double, p50_latency_ms double, p95_latency_ms double, saturation double, status string, evidence_record_id string", "health_observation_id"),
        _spec("lineage_nodes", "node_id string, node_type string, name string, domain string, owner string, system string, description string, evidence_record_id string", "node_id"),
        _spec("lineage_edges", "edge_id string, upstream_node_id string, downstream_node_id string, edge_type string, transform_name string, criticality string, valid_from timestamp, evidence_record_id string", "edge_id"),
        _spec("incident_timeline", "timeline_event_id string, incident_id string, occurred_at timestamp, sequence bigint, event_type string, source string, title string, detail string, evidence_record_ids_json string", "timeline_event_id"),
        _spec("historical_incidents", "historical_incident_id string, family string, service string, started_at timestamp, ended_at timestamp, root_cause string, symptoms_json string, remediation string, recovery_minutes bigint, tags_json string, evidence_record_id string", "historical_incident_id", empty=True),
        _spec("runbooks", "runbook_id string, title string, service string, trigger string, diagnostic_steps_json string, remediation_steps_json string, rollback_steps_json string, owner string, version string, evidence_record_id string", "runbook_id", empty=True),
        _spec("evidence_quality_results", "check_name string, category string, severity string, status string, observed_value double, expected string, details string", "check_name"),
    )
}


def conform(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Project to the canonical columns and types; a missing column is an error.

    Casts follow the session's ANSI mode (on by default), so a bad value raises.
    """
    missing = [name for name in spec.columns if name not in df.columns]
    if missing:
        raise ValueError(f"{spec.name} is missing columns: {', '.join(missing)}")
    return df.select(*(F.col(name).cast(kind).alias(name) for name, kind in spec.fields))


def empty(spark: SparkSession, spec: TableSpec) -> DataFrame:
    """Zero-row table with the canonical schema."""
    return spark.createDataFrame([], spec.schema)


def schema_issues(df: DataFrame, spec: TableSpec) -> list[tuple[str, str]]:
    """Plan-time comparison of column order and types; reads no data."""
    issues = []
    if tuple(df.columns) != spec.columns:
        issues.append(("schema.columns", f"expected {list(spec.columns)}, found {df.columns}"))
    actual = dict(df.dtypes)
    for name, kind in spec.fields:
        if name in actual and actual[name] != kind:
            issues.append(("schema.dtype", f"{name} expected {kind}, found {actual[name]}"))
    return issues
