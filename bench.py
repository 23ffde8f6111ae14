"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

HEADLINE = (
    "a01_bucket_power", "a02_energy_to_next_sample", "a04_hourly_rollup", "a06_series_coverage", "w11_missing_ranges",
    "d02_merge_to_quarter_hours", "u03_allocate_to_mppt", "a10_runtime_plant_total", "x07_extract_vendor_payload", "s09_screen_raw_rows",
    "d01_weather_quality_control", "d11_detect_anomalies", "d12_root_cause_diagnosis", "d19_fault_events", "j06_match_events",
    "j07_bin_truth", "d26_tracker_rule_labels", "d28_node_features", "d03_expected_electrical_state", "d37_coverage_first_heatmap",
    "s12_upsert_rows",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("sunloom-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from sunloom.gallery import QUERIES

    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    spent: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        # the noop sink runs the whole plan, every column included, without moving rows to the driver
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "sunloom_headline_total", "value": round(sum(spent.values()), 3), "unit": "sec",
                      "queries": spent, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
