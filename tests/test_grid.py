"""Complete grids: every bin once, spread over the tasks, never taken for small."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from sunloom.operators import bins, report, series as S

LONG = dt.datetime(2024, 1, 1, 5, 7), dt.datetime(2025, 2, 4, 3, 59)


def ranges(spark):
    rows = [(None, *LONG), (2, dt.datetime(2024, 3, 1), dt.datetime(2024, 3, 1, 0, 14)), (3, dt.datetime(2024, 3, 2), dt.datetime(2024, 3, 1)), (4, dt.datetime(2024, 3, 1, 23, 50), dt.datetime(2024, 3, 2, 0, 30))]
    return spark.createDataFrame(rows, "plant_id int, range_start timestamp, range_end timestamp").coalesce(1)


def test_grid_has_every_bin_once(spark):
    for minutes in (15, 30, 60):
        rows = bins.grid_of(ranges(spark), "range_start", "range_end", minutes=minutes).collect()
        got = {(r[0], r[1]) for r in rows}
        step, want = dt.timedelta(minutes=minutes), set()
        for r in ranges(spark).collect():
            floor = lambda t: t - (t - dt.datetime(2024, 1, 1)) % step
            at, end = floor(r["range_start"]), floor(r["range_end"])
            while at < end:
                want.add((r["plant_id"], at))
                at += step
        assert got == want and len(rows) == len(want)


def test_grid_of_one_series_is_spread_and_not_taken_for_small(spark):
    one = ranges(spark).filter("plant_id IS NULL")
    days = one.select("plant_id", F.date_trunc("day", "range_start").alias("range_start"), F.date_trunc("day", "range_end").alias("range_end"))
    cells = spark.createDataFrame([], "plant_id int, day date, bin long, state int, label string")
    for grid in (bins.grid_of(one, "range_start", "range_end"), report.dense_heatmap(cells, days, ["plant_id"])):
        sizes = [r[0] for r in grid.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert max(sizes) <= sum(sizes) / 3
    grid = bins.grid_of(one, "range_start", "range_end")
    assert grid._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() >= 8 * grid.count()


def test_positions_with_null_keys(spark):
    d = spark.range(40).select(F.when(F.col("id") % 2 == 0, F.lit(1)).alias("a"), F.when(F.col("id") % 4 < 2, F.lit("x")).alias("b"),
                               F.timestamp_seconds(F.col("id") * 40000).alias("t"), "id")
    got: dict = {}
    for r in sorted(S.number_rows(d, S.Series(("a", "b"), "t")).collect(), key=lambda r: r["id"]):
        got.setdefault((r["a"], r["b"]), []).append(r["_pos"])
    assert len(got) == 4 and all(v == list(range(10)) for v in got.values())


def test_tasks_after_a_shuffle_take_few_bytes_whatever_the_input(spark):
    # 32 MB of random numbers: by the size alone, without regard to the cores, they were one task of the default 64 MB
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.parallelismFirst")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    try:
        dealt = spark.range(4_000_000).select(F.rand(7).alias("x")).repartition("x")
        assert dealt.rdd.getNumPartitions() >= 2
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", kept)
