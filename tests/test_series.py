"""Block-parallel frames, totals, islands and filters against plain loops."""
import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sunloom.config import DetectConfig, EventConfig
from sunloom.operators import detect as D
from sunloom.operators import events as E
from sunloom.operators import series as S

T0 = dt.datetime(2024, 1, 1)


def table(spark, rows):
    return spark.createDataFrame(rows, "p int, t long, z double, ok boolean").withColumn("ts", F.timestamp_seconds("t"))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    out = []
    for p, n in ((0, 700), (1, 30), (2, 1)):
        for i in range(n):
            jump = 86400 * 50 if i > 20 else 0
            z = None if rnd.random() < 0.05 else rnd.gauss(0.1, 1.2)
            out.append((p, 1_700_000_000 + i * 900 + jump, z, rnd.random() > 0.15))
    return out


SER = S.Series(("p",), "ts", block_rows=64)


def test_frames_equal_whole_series_window(spark, rows):
    df = table(spark, rows)
    w = Window.partitionBy("p").orderBy("ts")
    exact = df.withColumn("m", F.percentile("z", 0.5).over(w.rowsBetween(-4, 4)))
    got = S.core(S.blocks(df, SER, 4, 4).withColumn("g", F.percentile("z", 0.5).over(SER.blocked.rowsBetween(-4, 4))))
    assert got.count() == len(rows)
    assert got.join(exact.select("p", "ts", "m"), ["p", "ts"]).filter("NOT (g <=> m)").isEmpty()


def test_running_and_islands(spark, rows):
    df = table(spark, rows)
    w = Window.partitionBy("p").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    lag = F.lag("ok").over(Window.partitionBy("p").orderBy("ts"))
    exact = df.withColumn("mx", F.max("z").over(w)).withColumn("isl", F.sum(F.when(F.coalesce(lag != F.col("ok"), F.lit(True)), 1).otherwise(0)).over(w))
    got = S.islands(S.previous(df, SER, {"was": "ok"}), SER, F.col("was") != F.col("ok"))
    got = S.running(got, SER, {"g": ("max", F.col("z"))})
    assert got.join(exact.select("p", "ts", "mx", "isl"), ["p", "ts"]).filter("NOT (g <=> mx) OR island <> isl").isEmpty()


def test_filters_equal_recursion(spark, rows):
    lam, k = 0.2, 0.5
    got = {(r.p, r.t): r for r in S.add_filters(S.blocks(table(spark, rows), SER), SER, "z", F.col("ok"), lam, k).collect()}
    for p in (0, 1, 2):
        e, up, dn = None, 0.0, 0.0
        for _, t, z, ok in [r for r in rows if r[0] == p]:
            r = got[(p, t)]
            if ok and z is not None:
                e = z if e is None else (1 - lam) * e + lam * z
                up, dn = max(0.0, up + z - k), max(0.0, dn - z - k)
                assert r.ewma == pytest.approx(e, abs=1e-12) and r.cusum_score == pytest.approx(max(up, dn), abs=1e-12)
                assert r.cusum_pos >= 0 and r.cusum_neg >= 0
            else:
                up = dn = 0.0
                assert r.ewma is None and r.cusum_score is None


@pytest.mark.parametrize("lam", [0.01, 0.9, 1.0])
def test_ewma_other_weights(spark, rows, lam):
    s = S.for_ewma(SER, lam)
    got = {(r.p, r.t): r.ewma for r in S.add_filters(S.blocks(table(spark, rows), s), s, "z", F.col("ok"), lam).collect()}
    e = None
    for _, t, z, ok in [r for r in rows if r[0] == 0]:
        if ok and z is not None:
            e = z if e is None else (1 - lam) * e + lam * z
            assert got[(0, t)] == pytest.approx(e, abs=1e-9)


def test_gap_exactly_at_limit_joins_and_above_splits(spark):
    mins = [0, 30, 61, 76, 200]
    df = spark.createDataFrame([(1, T0 + dt.timedelta(minutes=m)) for m in mins], "plant_id int, ts_15 timestamp")
    s = S.Series(("plant_id",), "ts_15")
    got = sorted(r.island for r in E.sessions(df, s, EventConfig()).collect())
    assert got == [1, 1, 2, 2, 3]
    wide = E.sessions(df, s, EventConfig(), dt="first_gap")      # first gap 30 min → limit 60 min
    assert sorted(r.island for r in wide.collect()) == [1, 1, 1, 1, 2]


def bins(spark, n, plants=(1, 2)):
    rnd = random.Random(9)
    rows = []
    for p in plants:
        for i in range(n):
            g = 800.0 + rnd.uniform(-5, 5) if i % 7 else 400.0
            mm = rnd.gauss(-0.02, 0.05) - (0.8 if p == 2 and i > n // 2 else 0.0)
            rows.append((p, T0 + dt.timedelta(minutes=15 * i), g, mm, True, False, False, False, False, 1.0))
    return spark.createDataFrame(rows, "plant_id int, ts_15 timestamp, g_poa double, mismatch_rel double, valid_model boolean, flag_meteo_missing boolean, "
                                       "flag_meteo_low_confidence boolean, flag_meteo_interpolated boolean, flag_inv_missing boolean, inv_coverage double")


def test_detector_flags_the_faulty_plant_only_and_plants_do_not_leak(spark):
    s = S.Series(("plant_id",), "ts_15", block_rows=32)
    both = D.detect_anomalies(bins(spark, 200), s, cfg=DetectConfig(max_cv=0.5, max_ramp=1000.0))
    n = {r.plant_id: r.n for r in both.filter("anomaly").groupBy("plant_id").agg(F.count("*").alias("n")).collect()}
    assert n.get(2, 0) > 50 and n.get(1, 0) < 10
    alone = D.detect_anomalies(bins(spark, 200).filter("plant_id = 2"), s, cfg=DetectConfig(max_cv=0.5, max_ramp=1000.0))
    a = both.filter("plant_id = 2").select("ts_15", F.round("z", 9).alias("z"), "anomaly")
    assert a.exceptAll(alone.select("ts_15", F.round("z", 9).alias("z"), "anomaly")).isEmpty()


def test_empty_series(spark):
    s = S.Series(("plant_id",), "ts_15")
    assert D.detect_anomalies(bins(spark, 0), s).isEmpty()
    assert E.sessions(bins(spark, 0), s).isEmpty()


def test_legacy_thresholds_on_the_edge(spark):
    df = spark.createDataFrame([(-0.40,), (-0.399,), (0.25,), (0.40,), (-0.90,), (-0.899,), (None,)], "m double")
    got = [r[0] for r in df.select(D.legacy_label(F.col("m"), F.lit(180.0), F.lit(True))).collect()]
    assert got == ["degradation", "normal", "normal", "meteo_error", "string_disconnected", "degradation", "invalid"]


def test_filters_carry_unread_columns_as_one_value(spark):
    """Columns of any name come back in their place, and the windows see the read ones and one struct."""
    df = spark.range(50).selectExpr("id % 2 as k", "timestamp_seconds(id * 900) as t", "cast(id % 7 as double) as z", "if(id % 3 = 0, null, id) as `a b`", "cast(id as string) as `x.y`")
    s = S.Series(("k",), "t", block_rows=16)
    b = S.blocks(df, s)
    out = S.add_filters(b, s, "z", F.col("z") > 0, 0.2, 0.5)
    assert out.columns[: len(b.columns)] == b.columns and out.columns[len(b.columns):] == ["ewma", "cusum_pos", "cusum_neg", "cusum_score"]
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "AS _row" in plan and all("x.y" not in line for line in plan.split("\n") if " Window " in line)
    assert sorted(map(str, out.select("k", "`a b`", "`x.y`", "z").collect())) == sorted(map(str, df.select("k", "`a b`", "`x.y`", "z").collect()))
