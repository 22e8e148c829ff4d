"""Published stages: written in parts, built from earlier stages, read once."""

from datetime import datetime

import pytest

from tidemark.catalog.common import tables_of
from tidemark.catalog import anomalies, cube, quality
from tidemark.catalog.cube import daily_cube, kept_fact, narrow_fact
from tidemark.operators import checks, facts, rules
from tidemark.operators.metrics import metric_observations, observation_counts
from tidemark.operators.registry import REGISTRY, resolve
from tidemark.plans import binding, shared
from tidemark.plans.config import AnalyticsConfig, CohortSpec

SF = "/root/testdata/sf0.001"


def test_parts_are_planned_and_written_one_by_one(spark):
    order = []

    def part(name, value):
        def build():
            order.append(name)
            return spark.createDataFrame([(value,)], "v int")

        return build

    both = shared.shared_parts(spark, "parts", "t", {"a": part("a", 1), "b": part("b", 2)})
    assert sorted(r["v"] for r in both.collect()) == [1, 2] and order == ["a", "b"]
    assert shared.shared_parts(spark, "parts", "t", {}) is both
    with pytest.raises(ValueError, match="columns"):
        shared.shared_parts(spark, "parts", "u", {"a": part("a", 1), "b": lambda: spark.createDataFrame([("x",)], "v string")})


def test_daily_cube_is_one_scan_without_the_plan_of_its_union(spark):
    rows = daily_cube(spark, SF)
    assert {r["metric_name"] for r in rows.select("metric_name").distinct().collect()} == set(REGISTRY)
    folders = {f.rpartition("/")[0] for f in rows.inputFiles()}
    assert len(folders) == len({m.fact for m in REGISTRY.values()})


def test_facts_from_kept_stages_equal_those_from_tables(spark):
    tables = tables_of(spark, SF)
    for name in facts.FACT_BUILDERS:
        kept, plain = kept_fact(spark, SF, name), facts.FACT_BUILDERS[name](tables)
        assert kept.columns == plain.columns
        assert kept.exceptAll(plain).isEmpty() and plain.exceptAll(kept).isEmpty()
    made = {"orders": kept_fact(spark, SF, "orders")}
    text = facts.order_items_fact(tables, made)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Join") == 2


def test_quantiles_read_the_fact_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = [(f"P{i}", datetime(2024, 1, 1, i % 24), i * 7 % 40, "ab"[i % 2]) for i in range(60)]
    fact = spark.createDataFrame(rows, "payment_attempt_id string, attempted_at timestamp_ntz, latency_ms bigint, region string")
    fact = fact.mapInPandas(count, fact.schema)
    config = AnalyticsConfig(time_grains=("day",), cohorts=(CohortSpec("overall"), CohortSpec("region", ("region",))), funnel_cohorts=("overall",), contributions=())
    out = metric_observations({"payments": fact}, resolve(["payment_latency_p50_ms"]), config, rows_per_piece=10).collect()
    values = sorted(i * 7 % 40 for i in range(60))
    overall = next(r for r in out if r["cohort_name"] == "overall")
    assert overall["value"] == (values[29] + values[30]) / 2 and overall["sample_size"] == 60 and len(out) == 3
    assert seen.value == 60


def test_quality_parts_make_up_the_quality_table():
    config = AnalyticsConfig()
    assert list(checks.quality_parts(*[None] * 7, config)) == ["source", "facts", "metrics", "cohorts", "funnel", "contributions"]


def test_fact_checks_come_fact_by_fact(spark):
    tables = tables_of(spark, SF)
    parts = checks.fact_check_parts(tables, {n: kept_fact(spark, SF, n) for n in ("pipelines", "deployments")}, resolve(["deployment_count"]))
    rows = parts["deployments"]().collect()
    assert list(parts) == ["pipelines", "deployments"] and {r["check_name"].split(".")[1] for r in rows} == {"deployments"} and len(rows) == 4


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join")


def test_derived_tables_are_read_from_the_published_stages_before_them(spark):
    tables = tables_of(spark, f"{SF}/.")
    assert joins(tables["checkout_sessions"]) == joins(tables["payment_attempts"]) == joins(tables["warehouse_scan_events"]) == 0
    assert shared.published(spark, f"{SF}/.", "s_session_base").count() == tables["checkout_sessions"].count()


def test_narrow_facts_leave_out_unread_lookups_only(spark):
    own, whole = f"{SF}/", facts.FACT_BUILDERS
    for name, columns in (("orders", {"ordered_at", "region", "total_amount"}), ("orders", {"order_id", "device", "has_return"}),
                          ("payments", {"attempted_at", "issuer", "approved"}), ("payments", {"payment_attempt_id", "region", "loyalty_tier", "declined"}),
                          ("checkout", {"session_id", "region", "has_order"}), ("checkout", {"session_id", "seller_id", "payment_started"}),
                          ("shipments", {"shipment_id", "region", "on_time"}), ("scans", {"scan_event_id", "device"}),
                          ("order_items", {"order_item_id", "ordered_at", "quantity"}), ("returns", {"return_id", "region", "refund_completed"})):
        narrow, plain = narrow_fact(spark, own, name, frozenset(columns)), whole[name](tables_of(spark, own)).select(*sorted(columns))
        assert narrow.columns == sorted(columns) and narrow.exceptAll(plain).isEmpty() and plain.exceptAll(narrow).isEmpty()
    tables = tables_of(spark, own)
    assert joins(facts.order_context(tables, None, frozenset({"ordered_at", "region", "total_amount"}))) == 0
    assert joins(facts.payments_fact(tables, None, frozenset({"region"}))) == 1
    assert shared.published(spark, own, "fact-orders") is None


def test_selected_cubes_hold_what_the_whole_cube_holds(spark):
    wanted = [("payment_decline_rate", "day", "region"), ("payment_latency_p95_ms", "day", "overall"), ("payment_approval_rate", "hour", "overall")]
    some = cube.selected_cube(spark, SF, "some", wanted, anomalies.COHORTS)
    every = cube.published_cube(spark, SF, "every", [w[0] for w in wanted], anomalies.COHORTS)
    picked = lambda df: df.where(" OR ".join(f"(metric_name = '{m}' AND time_grain = '{g}' AND cohort_name = '{c}')" for m, g, c in wanted))
    assert picked(some).exceptAll(picked(every)).isEmpty() and picked(every).exceptAll(picked(some)).isEmpty()
    assert picked(some).count() > 0 and some.where("time_grain = 'hour' AND cohort_name = 'region'").isEmpty()


def test_rule_sets_are_published_on_their_own(spark):
    own = f"{SF}//"
    rows = quality.rule_set(spark, own, rules.funnel_state_rules)
    assert {r["code"] for r in rows.select("code").collect()} == {"funnel.state", "funnel.stage_unknown", "commerce.campaign_attribution"}
    assert shared.published(spark, own, "source-declared_key_rules") is None and shared.published(spark, own, "s_orders") is None


def test_given_tables_are_opened_once(spark, monkeypatch):
    opened, base = [], binding.base
    monkeypatch.setattr(binding, "base", lambda spark, sf_dir, name: opened.append(name) or base(spark, sf_dir, name))
    tables = tables_of(spark, f"{SF}/./")
    for name in ("customers", "products", "deployments", "shipments", "warehouses", "order_items"):
        assert tables[name].columns
    assert sorted(opened) == sorted(set(opened)) and {"customer", "events", "lineitem"} <= set(opened)


def test_cohort_reconciliation_makes_additive_metrics_only(spark):
    own, key = f"{SF}/./.", ("metric_name", "time_grain", "cohort_name", "gap")
    alone = quality.f12(spark, own).select(*key)
    made = {r["metric_name"] for r in shared.published(spark, own, "cube-daily-additive").select("metric_name").distinct().collect()}
    assert made == {m.name for m in REGISTRY.values() if m.calculation in checks.ADDITIVE} and shared.published(spark, own, "cube-daily") is None
    whole = quality.f12(spark, SF).select(*key) if daily_cube(spark, SF) else None
    assert alone.count() == 288 and alone.exceptAll(whole).isEmpty() and whole.exceptAll(alone).isEmpty()


def test_groups_without_values_and_empty_facts_are_counted_as_in_the_cube(spark):
    ddl = "payment_attempt_id string, attempted_at timestamp_ntz, latency_ms bigint, region string, approved boolean"
    config = AnalyticsConfig(cohorts=(CohortSpec("overall"), CohortSpec("region", ("region",))), funnel_cohorts=("overall",), contributions=())
    for rows in ([("a", datetime(2024, 1, 1, 1), None, None, True), ("b", datetime(2024, 1, 1, 2), 3, "x", None), ("c", None, 4, "x", True)], []):
        made = {"payments": spark.createDataFrame(rows, ddl)}, resolve(["payment_latency_p50_ms", "payment_approval_rate"]), config
        plain = metric_observations(*made).groupBy("metric_name", "time_grain", "cohort_name").count()
        counted = observation_counts(*made)
        assert counted.exceptAll(plain).isEmpty() and plain.exceptAll(counted).isEmpty() and counted.isEmpty() == (not rows)

def test_series_are_counted_without_their_measures(spark):
    own = f"{SF}/././"
    counted, support, listed = cube.daily_counts(spark, own), cube.c11(spark, own), cube.c12(spark, own)
    assert quality.f6(spark, own).first()["status"] == "pass" and shared.published(spark, own, "cube-daily") is None
    plain = daily_cube(spark, SF).groupBy("metric_name", "time_grain", "cohort_name").count()
    assert counted.exceptAll(plain).isEmpty() and plain.exceptAll(counted).isEmpty() and counted.count() > 400
    assert support.exceptAll(cube.c11(spark, SF)).isEmpty() and listed.exceptAll(cube.c12(spark, SF)).isEmpty() and listed.count() == 43

def test_one_kind_of_fact_check_leaves_the_others_undone(spark):
    own = f"{SF}//."
    rows, keys = quality.f2(spark, own), quality.f3(spark, own)
    assert shared.published(spark, own, "fact-checks") is None
    every = quality._fact_checks(spark, own)
    for some, kind in ((rows, "cardinality"), (keys, "primary_key")):
        same = every.where(f"check_name LIKE '%.{kind}'").select(*some.columns)
        assert some.exceptAll(same).isEmpty() and same.exceptAll(some).isEmpty() and some.count() == 11

def test_contributions_read_the_daily_cube_where_it_is_published(spark):
    own = f"{SF}/.//"
    alone = cube.contributions(spark, own)
    assert shared.published(spark, own, "cube-contribution") is not None and daily_cube(spark, SF) is not None
    read = cube.contributions(spark, SF)
    assert shared.published(spark, SF, "cube-contribution") is None
    key = ("analysis_name", "baseline_period_start", "cohort_value", "baseline_numerator", "current_denominator")
    assert alone.select(*key).exceptAll(read.select(*key)).isEmpty() and alone.count() == read.count() > 0
    assert len({f.rpartition("/")[0] for f in alone.inputFiles()}) == len(cube.DAILY.contributions)


def test_metric_checks_come_part_by_part(spark):
    own = f"{SF}//./"
    ranges, sums = quality.f10(spark, own), quality.f11(spark, own)
    assert shared.published(spark, own, "metric-checks") is None and ranges.count() == sums.count() == 43
    every = quality._metric_checks(spark, own)
    assert len({f.rpartition("/")[0] for f in every.inputFiles()}) == 4 and every.count() == 2 * 43 + 4
    same = every.where("check_name LIKE '%.arithmetic'").select("metric_name", "observed_value")
    assert sums.exceptAll(same).isEmpty() and same.exceptAll(sums).isEmpty()
