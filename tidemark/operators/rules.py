"""Source-table rules: every rule yields a count of violations.

Rules over one table share a single aggregate; rules that relate tables are one
join and one aggregate each.  The result has one row per rule with its violation
count; ``issues`` keeps the rows that have any.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import count_if, whole_seconds_between
from tidemark.sources.contracts import SOURCE_SPECS, TableSpec, schema_issues

Tables = Mapping[str, DataFrame]
RULE_DDL = "severity string, code string, table_name string, message string, violations bigint"


@dataclass(frozen=True)
class Rule:
    code: str
    table: str
    violations: Column
    message: str = ""
    severity: str = "error"


def _rows(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    measured = df.agg(*(F.coalesce(rule.violations, F.lit(0)).cast("bigint").alias(f"_v{i}") for i, rule in enumerate(rules)))
    return measured.select(F.inline(F.array(*(
        F.struct(F.lit(rule.severity).alias("severity"), F.lit(rule.code).alias("code"), F.lit(rule.table).alias("table_name"),
                 F.lit(rule.message).alias("message"), F.col(f"_v{i}").alias("violations"))
        for i, rule in enumerate(rules)
    ))))


# Pairs of columns that must be in time order.
TIME_ORDER = (
    ("checkout_sessions", "started_at", "address_submitted_at"),
    ("checkout_sessions", "address_submitted_at", "inventory_checked_at"),
    ("checkout_sessions", "inventory_checked_at", "payment_started_at"),
    ("checkout_sessions", "payment_started_at", "completed_at"),
    ("promotions", "start_at", "end_at"),
    ("shipments", "shipped_at", "delivered_at"),
    ("warehouse_scan_events", "source_event_at", "platform_received_at"),
    ("returns", "requested_at", "received_at"),
    ("refunds", "initiated_at", "completed_at"),
    ("seller_feed_runs", "started_at", "completed_at"),
    ("pipeline_runs", "started_at", "completed_at"),
)
# Stage -> (abandonment reason, how many of the step times are filled).
STEP_TIMES = ("address_submitted_at", "inventory_checked_at", "payment_started_at", "completed_at")
STAGE_STATES = (
    ("checkout_started", "customer_abandoned", 0),
    ("address_submitted", "address_validation_failed", 1),
    ("inventory_checked", "inventory_unavailable", 2),
    ("inventory_confirmed", "before_payment", 2),
    ("payment_started", "payment_declined", 3),
    ("order_completed", None, 4),
)
MONEY_TOLERANCE = 0.02


def presence(tables: Tables, specs: Mapping[str, TableSpec] = SOURCE_SPECS) -> list[tuple]:
    """Missing and unregistered tables, and column or type mismatches; plan time only."""
    found = [("error", "table.missing", name, "required table is missing", 1) for name in specs if name not in tables]
    found += [("warning", "table.unregistered", name, "table is not registered", 1) for name in tables if name not in specs]
    for name, spec in specs.items():
        if name in tables:
            found += [("error", code, name, text, 1) for code, text in schema_issues(tables[name], spec)]
    return found


#: Children of one key domain whose bits share a group (a long holds 63 and the parent).
DOMAIN_CHILDREN = 62


@dataclass(frozen=True)
class _KeyRule:
    code: str
    table: str
    message: str
    domain: int
    slot: int


class _Domains:
    """Which columns of which tables are compared: slot 0 is the table that owns a key, the others refer to it."""

    def __init__(self) -> None:
        self.uses: dict[str, list[tuple[int, int, tuple[str, ...]]]] = {}
        self.rules: list[_KeyRule] = []
        self._ids: dict[tuple, int] = {}
        self._children: dict[tuple, int] = {}

    def owner(self, table: str, columns: tuple[str, ...], chunk: int = 0) -> int:
        place = (table, columns, chunk)
        if place not in self._ids:
            self._ids[place] = len(self._ids)
            self.uses.setdefault(table, []).append((self._ids[place], 0, columns))
        return self._ids[place]

    def child(self, table: str, column: str, target: str, target_column: str) -> tuple[int, int]:
        key = (target, (target_column,))
        chunk, slot = divmod(self._children.get(key, 0), DOMAIN_CHILDREN)
        self._children[key] = self._children.get(key, 0) + 1
        domain = self.owner(target, (target_column,), chunk)
        self.uses.setdefault(table, []).append((domain, slot + 1, (column,)))
        return domain, slot + 1

    def add(self, *rule) -> None:
        self.rules.append(_KeyRule(*rule))


def _one_key(columns: tuple[str, ...]) -> Column:
    """A key as text; a key of several columns is the JSON of all of them."""
    return F.col(columns[0]).cast("string") if len(columns) == 1 else F.to_json(F.struct(*columns))


def _key_uses(table: DataFrame, uses: Sequence[tuple[int, int, tuple[str, ...]]]) -> DataFrame:
    def use(domain: int, slot: int, columns: tuple[str, ...]) -> Column:
        missing = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in columns))
        return F.struct(F.lit(domain).alias("domain"), F.lit(slot).alias("slot"), _one_key(columns).alias("key"), F.when(missing, F.lit(slot)).alias("missing"))

    return table.select(F.inline(F.array(*(use(*u) for u in uses))))


def _key_results(tables: Tables, specs: Mapping[str, TableSpec], primary: bool, foreign: bool) -> DataFrame:
    """All declared keys in one scan of each table and one shuffle of (domain, key).

    A group holds the rows of the owning table and one bit for each table that has the key,
    so partial aggregation leaves one row per distinct key and task, however hot the key is.
    """
    domains = _Domains()
    for name, spec in specs.items():
        if primary:
            own = domains.owner(name, tuple(spec.primary_key))
            domains.add("primary_key.null", name, f"{list(spec.primary_key)} has nulls", own, 0)
            domains.add("primary_key.duplicate", name, f"{list(spec.primary_key)} repeats", own, 0)
            if not spec.may_be_empty:
                domains.add("table.empty", name, "table has no rows", own, 0)
        for fk in spec.foreign_keys if foreign else ():
            domain, slot = domains.child(name, fk.column, fk.target_table, fk.target_column)
            domains.add("foreign_key.unmatched", name, fk.column, domain, slot)
            if not fk.nullable:
                domains.add("foreign_key.null", name, fk.column, domain, slot)
    spark = next(iter(tables.values())).sparkSession
    declared = spark.createDataFrame(
        [(r.code, r.table, r.message, r.domain, r.slot) for r in domains.rules], "code string, table_name string, message string, domain int, slot int")
    if not domains.rules:
        return declared.select(F.lit("error").alias("severity"), "code", "table_name", "message", F.lit(0).cast("bigint").alias("violations"))
    uses = reduce(DataFrame.unionByName, (_key_uses(tables[name], used) for name, used in domains.uses.items()))
    groups = uses.groupBy("domain", "key", "missing").agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col("slot") == 0).alias("owners"), F.expr("bit_or(shiftleft(1L, slot))").alias("bits"))
    # One row per domain and set of tables that have a key.
    patterns = groups.groupBy("domain", "missing", "bits").agg(
        F.count(F.lit(1)).alias("keys"), F.sum("n").alias("n"), F.sum("owners").alias("owners"), F.sum(F.greatest(F.col("owners") - 1, F.lit(0))).alias("repeats"))
    code, has = F.col("code"), lambda bit: F.expr(f"(bits & shiftleft(1L, {bit})) <> 0")
    absent = F.col("missing") == F.col("slot")
    found = (
        F.when(code == "primary_key.duplicate", F.col("repeats"))
        .when(code == "table.empty", F.col("owners"))
        .when(code.endswith(".null") & absent, F.col("n"))
        .when((code == "foreign_key.unmatched") & F.col("missing").isNull() & has("slot") & ~has("0"), F.col("keys"))
    )
    total = F.coalesce(F.sum(found), F.lit(0)).cast("bigint")
    return declared.join(patterns, "domain", "left").groupBy(F.lit("error").alias("severity"), "code", "table_name", "message").agg(
        F.when(code == "table.empty", (total == 0).cast("bigint")).otherwise(total).alias("violations"))


def key_rules(tables: Tables, specs: Mapping[str, TableSpec] = SOURCE_SPECS) -> DataFrame:
    """Non-empty tables and null or repeated primary keys."""
    return _key_results(tables, specs, primary=True, foreign=False)


def foreign_key_rules(tables: Tables, specs: Mapping[str, TableSpec] = SOURCE_SPECS) -> DataFrame:
    """Distinct child keys without a parent, and nulls where a parent is required."""
    return _key_results(tables, specs, primary=False, foreign=True)


def declared_key_rules(tables: Tables, specs: Mapping[str, TableSpec] = SOURCE_SPECS) -> DataFrame:
    """``key_rules`` and ``foreign_key_rules`` from the same shuffle."""
    return _key_results(tables, specs, primary=True, foreign=True)


def time_order_rules(tables: Tables) -> DataFrame:
    grouped: dict[str, list[Rule]] = {}
    for table, earlier, later in TIME_ORDER:
        grouped.setdefault(table, []).append(
            Rule("temporal.order", table, count_if(F.col(earlier) > F.col(later)), f"{earlier} after {later}")
        )
    return reduce(DataFrame.unionByName, (_rows(tables[t], rules) for t, rules in grouped.items()))


def _count_gap(left: DataFrame, right: DataFrame, code: str, table: str) -> DataFrame:
    """Absolute difference of two row counts."""
    one = left.agg(F.count(F.lit(1)).alias("n")).unionByName(right.agg((-F.count(F.lit(1))).alias("n")))
    return _rows(one, [Rule(code, table, F.abs(F.sum("n")), "counts must be equal")])


def commerce_rules(tables: Tables) -> DataFrame:
    """Orders against payments, sessions and items."""
    orders, payments, sessions = tables["orders"], tables["payment_attempts"], tables["checkout_sessions"]
    items = tables["order_items"].groupBy("order_id").agg(
        F.count(F.lit(1)).alias("actual_items"), F.sum("line_total").alias("net")
    )
    total = F.col("subtotal") - F.col("discount_amount") + F.col("tax_amount") + F.col("shipping_amount")
    with_items = orders.join(items, "order_id", "left")
    paid = orders.join(payments.select("payment_attempt_id", F.col("amount").alias("paid")), "payment_attempt_id")
    return reduce(DataFrame.unionByName, [
        _count_gap(payments.where("approved"), orders, "commerce.approved_order_count", "orders"),
        _count_gap(sessions.where("stage_reached = 'order_completed'"), orders, "commerce.completed_order_count", "checkout_sessions"),
        _rows(with_items, [
            Rule("commerce.item_count", "orders", count_if(F.col("item_count") != F.col("actual_items"))),
            Rule("commerce.item_total", "orders", count_if(F.abs(F.col("net") - (F.col("subtotal") - F.col("discount_amount"))) > MONEY_TOLERANCE)),
            Rule("commerce.order_total", "orders", count_if(F.abs(F.col("total_amount") - total) > MONEY_TOLERANCE)),
        ]),
        _rows(paid, [Rule("commerce.payment_amount", "payment_attempts", count_if(F.abs(F.col("paid") - F.col("total_amount")) > MONEY_TOLERANCE))]),
    ])


def funnel_state_rules(tables: Tables) -> DataFrame:
    """Each stage has exactly its step times filled and its own abandonment reason."""
    stage, reason = F.col("stage_reached"), F.col("abandonment_reason")
    rules = [Rule("funnel.stage_unknown", "checkout_sessions", count_if(~stage.isin([s for s, _, _ in STAGE_STATES])))]
    for name, expected, filled in STAGE_STATES:
        wrong = reason.isNotNull() if expected is None else reason != expected
        for i, column in enumerate(STEP_TIMES):
            wrong = wrong | (F.col(column).isNull() if i < filled else F.col(column).isNotNull())
        rules.append(Rule("funnel.state", "checkout_sessions", count_if((stage == name) & wrong), name))
    unpaid = F.col("channel").isin("organic", "direct")
    rules.append(Rule("commerce.campaign_attribution", "checkout_sessions", count_if(unpaid == F.col("campaign_id").isNotNull())))
    return _rows(tables["checkout_sessions"], rules)


def operational_rules(tables: Tables) -> DataFrame:
    """Scan sequences and lags, child context, order attribution."""
    shipments, scans = tables["shipments"], tables["warehouse_scan_events"]
    seen = scans.groupBy("shipment_id").agg(
        F.count(F.lit(1)).alias("actual"), F.min("sequence_number").alias("first"), F.max("sequence_number").alias("last")
    )
    actual = F.col("actual")
    sequence = actual.isNull() | (F.col("scan_count") != actual) | (F.col("first") != 1) | (F.col("last") != actual)
    lag = F.col("ingestion_lag_seconds")
    lag_bad = (lag != whole_seconds_between("source_event_at", "platform_received_at")) | (lag < F.col("connector_batch_seconds")) | (lag <= 0)
    context = scans.join(shipments.select("shipment_id", F.col("order_id").alias("o"), F.col("warehouse_id").alias("w")), "shipment_id")
    origin = tables["checkout_sessions"].select("session_id", F.col("channel").alias("c"), F.col("campaign_id").alias("g"))
    orders = tables["orders"].select("order_id", "session_id", "channel", "campaign_id").join(origin, "session_id")
    return reduce(DataFrame.unionByName, [
        _rows(shipments.join(seen, "shipment_id", "left"), [Rule("fulfilment.scan_count", "shipments", count_if(sequence))]),
        _rows(scans, [Rule("fulfilment.scan_lag", "warehouse_scan_events", count_if(lag_bad))]),
        _rows(context, [Rule("fulfilment.scan_context", "warehouse_scan_events", count_if((F.col("order_id") != F.col("o")) | (F.col("warehouse_id") != F.col("w"))))]),
        _rows(orders, [Rule("commerce.order_attribution", "orders", count_if((F.col("channel") != F.col("c")) | ~F.col("campaign_id").eqNullSafe(F.col("g"))))]),
    ])


def inventory_rules(tables: Tables) -> DataFrame:
    available, hand, held = F.col("available_quantity"), F.col("on_hand_quantity"), F.col("reserved_quantity")
    balance = (available != hand - held) | (hand < 0) | (held < 0) | (available < 0)
    delta = F.abs(F.col("feed_reported_quantity") - available)
    return _rows(tables["inventory_snapshots"], [
        Rule("inventory.balance", "inventory_snapshots", count_if(balance)),
        Rule("inventory.feed_delta", "inventory_snapshots", count_if(delta > 1)),
    ])


def health_rates(tables: Tables) -> DataFrame:
    """One row: conversion, approval and late rates, and payments on another rule version."""
    zero = F.lit(0.0)
    sessions = tables["checkout_sessions"].agg(F.count(F.lit(1)).alias("sessions"))
    orders = tables["orders"].agg(F.count(F.lit(1)).alias("orders"))
    payments = tables["payment_attempts"].agg(
        F.coalesce(F.avg(F.col("approved").cast("double")), zero).alias("payment_approval_rate"),
        count_if(F.col("fraud_rule_version") != "17").alias("other_rule_versions"),
    )
    late = tables["shipments"].where("status = 'delivered'").agg(F.coalesce(F.avg(F.col("late").cast("double")), zero).alias("late_delivery_rate"))
    # Single-row aggregates laid side by side through one more aggregate.
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [sessions, orders, payments, late])
    row = stacked.agg(*(F.max(c).alias(c) for c in stacked.columns))
    return row.withColumn("checkout_conversion_rate", F.coalesce(F.try_divide("orders", "sessions"), zero))


def health_rules(tables: Tables) -> DataFrame:
    outside = lambda c, low, high: F.max((~F.col(c).between(low, high)).cast("bigint"))
    return _rows(health_rates(tables), [
        Rule("baseline.conversion", "checkout_sessions", outside("checkout_conversion_rate", 0.45, 0.95)),
        Rule("baseline.payment_approval", "payment_attempts", outside("payment_approval_rate", 0.70, 0.995)),
        Rule("baseline.fraud_rule", "payment_attempts", F.max("other_rule_versions")),
        Rule("baseline.late_delivery", "shipments", F.max((F.col("late_delivery_rate") > 0.30).cast("bigint"))),
    ])


def window_rules(tables: Tables, start: datetime, end: datetime) -> DataFrame:
    return _rows(tables["checkout_sessions"], [
        Rule("window.before_start", "checkout_sessions", count_if(F.col("started_at") < F.lit(start).cast("timestamp_ntz"))),
        Rule("window.after_end", "checkout_sessions", count_if(F.col("started_at") >= F.lit(end).cast("timestamp_ntz"))),
    ])


RULE_SETS = (declared_key_rules, time_order_rules, commerce_rules, funnel_state_rules, operational_rules, inventory_rules, health_rules)


def rule_parts(tables: Tables, start: datetime | None = None, end: datetime | None = None) -> dict[str, Callable[[], DataFrame]]:
    """The rules by the set they belong to, so that each set can be planned, written and read on its own."""
    parts = {rules.__name__: lambda rules=rules: rules(tables) for rules in RULE_SETS}
    if start is not None and end is not None:
        parts["window_rules"] = lambda: window_rules(tables, start, end)
    return parts


def structure_rules(tables: Tables) -> DataFrame | None:
    """``presence`` as rule rows, if there are any."""
    found = presence(tables)
    return next(iter(tables.values())).sparkSession.createDataFrame(found, RULE_DDL) if found else None


def validate_source(tables: Tables, start: datetime | None = None, end: datetime | None = None, extra: Sequence[DataFrame] = ()) -> DataFrame:
    """All rules with their violation counts (``extra`` adds caller-made rule rows)."""
    structural = structure_rules(tables)
    parts = [build() for build in rule_parts(tables, start, end).values()] + list(extra)
    if structural is not None:
        parts.append(structural)
    return reduce(DataFrame.unionByName, parts)


def issues(results: DataFrame) -> DataFrame:
    return results.where("violations > 0")
