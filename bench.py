"""Headline timings: one JSON line on stdout."""

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))
from tidemark.catalog import all_queries  # noqa: E402

# Facts and cubes are published on first use, so order matters: each entry's time
# includes the stage outputs it is the first to need.
HEADLINE = (
    "b4_checkout_fact", "b6_order_items_fact", "c3_distinct_count", "c10_metric_cube_checkout", "c6_quantile", "d2_funnel_observations", "e3_contribution_observations",
    "g1_g18_source_rules", "h6_h7_robust_baseline", "h17_cusum", "h19_bh_fdr", "h20_h24_alerts", "i2_i9_customer_features", "i11_kaplan_meier", "i14_nearest_matching",
    "i23_concordance", "j1_checkout_health", "j13_incident_timeline", "l1_posteriors", "m13_lifecycle", "n1_n2_case_scores", "n6_aggregate_report", "q1_stream_metrics",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog, timings = all_queries().queries, {}
    for name in HEADLINE:
        began = time.time()
        catalog[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings, "sf": sf_dir.rstrip("/").split("sf")[-1]}))


if __name__ == "__main__":
    main()
