"""Merged quarter-hours and plant data → diagnostics and fault events, written for the range they cover.

    spark-submit --py-files sunloom.zip -m sunloom.jobs.detect_events --merged PATH --plants PATH --out PATH [--start TIME] [--end TIME]
"""
from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunloom.operators import power as PW
from sunloom.plans.detection import run_detection
from sunloom.session import checkpoint_ready, prepare
from sunloom.sources import tables as TB

KEYS = ["plant_id"]


def run(spark: SparkSession, merged: DataFrame, plants: DataFrame, out: str, start: str | None = None, end: str | None = None) -> None:
    """Replace the rows of every plant in the range: `out`/diagnostics by day, `out`/events by the day they begin."""
    checkpoint_ready(prepare(spark))
    if start:
        merged = merged.filter(F.col("ts_15") >= F.lit(start).cast("timestamp"))
    if end:
        merged = merged.filter(F.col("ts_15") < F.lit(end).cast("timestamp"))
    span = merged.groupBy(*KEYS).agg(F.min("ts_15").alias("range_start"), F.timestamp_seconds(F.unix_seconds(F.max("ts_15")) + 1).alias("range_end")).checkpoint(eager=True)
    diag, events = run_detection(merged, PW.plant_parameters(plants), KEYS)
    TB.replace_range_table(diag.withColumn("day", F.to_date("ts_15")), span, f"{out}/diagnostics", KEYS, "ts_15", ["day"])
    TB.replace_range_table(events.withColumn("day", F.to_date("ts_start_utc")), span, f"{out}/events", KEYS, "ts_start_utc", ["day"], end_time="ts_end_utc")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    for name in ("merged", "plants", "out"):
        parser.add_argument(f"--{name}", required=True)
    for name in ("start", "end"):
        parser.add_argument(f"--{name}")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("sunloom-detect-events").getOrCreate()
    run(spark, spark.read.parquet(args.merged), spark.read.parquet(args.plants), args.out, args.start, args.end)


if __name__ == "__main__":
    main()
