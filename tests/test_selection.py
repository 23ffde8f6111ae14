"""Exact medians against plain ones, and clocks that are hours off."""
import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from sunloom.operators.selection import medians
from sunloom.sources import landing as L


def test_medians_of_odd_series(spark):
    rng = random.Random(11)
    series = {
        "one": [5], "two": [-3, 4], "ties": [7] * 9 + [1], "none": [None, None], "wide": [rng.randint(-(10**15), 10**15) for _ in range(301)],
        "near": [rng.randint(-50, 50) for _ in range(400)], "borders": [-1, 0, 99_999, 100_000, 10**9, -(10**9)], None: [3, None, 8, 8],
    }
    df = spark.createDataFrame([(k, i, v) for k, vs in series.items() for i, v in enumerate(vs)], "k string, i int, v long").repartition(7)
    got = {r.k: (r.m, r.a) for r in medians(df, ["k"], {"m": F.col("v"), "a": F.abs("v")}).collect()}
    want = {}
    for k, vs in series.items():
        if known := [v for v in vs if v is not None]:
            want[k] = (statistics.median(known), statistics.median(map(abs, known)))
    assert got.keys() == want.keys()
    for k, pair in want.items():
        assert got[k] == pytest.approx(pair, rel=1e-15)
    assert medians(df.limit(0), ["k"], {"m": F.col("v")}).count() == 0


def test_one_hot_series_is_never_gathered(spark):
    """A million unlike values: the middle one, and no aggregate or window over a whole series."""
    n = 1_000_000
    df = spark.range(n, numPartitions=8).select(F.lit("hot").alias("k"), ((F.col("id") * 7919) % n * 1000 + 13).alias("v"))
    found = medians(df, ["k"], {"m": F.col("v")})
    assert found.first().m == statistics.median(range(n)) * 1000 + 13
    assert "percentile" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("hours", [-5, 0, 7])
def test_scan_mends_clocks_that_are_hours_off(spark, hours):
    """The buffer brings in rows whose stored instant lies outside the range; after the repair the exact range is cut again."""
    start = dt.datetime(2024, 1, 6)
    rows = [("p", "UTC", start + dt.timedelta(minutes=15 * k - 60 * hours), '{"Data E Hora": "%s", "Potência ativa total": "%d"}' % (start + dt.timedelta(minutes=15 * k), k), "renovigi") for k in range(-8, 104)]
    df = spark.createDataFrame(rows, "plant_id string, tz string, ts_utc timestamp, payload string, provedor string")
    lo, hi = (F.lit(start + dt.timedelta(days=d)) for d in (0, 1))
    got = L.scan_telemetry(df, lo, hi, ["plant_id"], buffer_hours=8).select("ts_utc", "p_ac_w", "shift_minutes", "clock_mode").orderBy("ts_utc").collect()
    assert [r.p_ac_w for r in got] == [float(k) for k in range(96)] and {r.shift_minutes for r in got} == {60 * hours} and {r.clock_mode for r in got} == {"utc"}
    assert [r.ts_utc for r in got] == [start + dt.timedelta(minutes=15 * k) for k in range(96)]
