"""Parsers, payloads, catalogue and screening on hand-made rows."""
import datetime as dt
import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sunloom.functions import timegrid as tg
from sunloom.functions import values as V
from sunloom.operators import keys as K
from sunloom.sources import landing as L


@pytest.mark.parametrize("text,want", [
    ("1.234,56", 1234.56), ("1234.56", 1234.56), ("1,234.56", 1234.56), ("20 V", 20.0), (" -3,5", -3.5), ("", None), ("-", None), (None, None),
    ("1.2.3", None), ("1,2,3", None), ("abc", None), ("1.234.567,8", 1234567.8),
])
def test_local_number(spark, text, want):
    assert spark.createDataFrame([(text,)], "s string").select(V.parse_local_number("s")).first()[0] == want


@pytest.mark.parametrize("text,tz,want", [
    ("2018-11-04 01:30:00", "America/Sao_Paulo", "2018-11-04 03:30:00"),     # first hour of summer time
    ("2024-10-27 03:30:00", "Europe/Madrid", "2024-10-27 02:30:00"),
    ("2024-06-01T12:00:00+02:00", "UTC", "2024-06-01 10:00:00"), ("01/06/2024 09:05", "UTC", "2024-06-01 09:05:00"),
    ("1717236000", "Europe/Madrid", "2024-06-01 10:00:00"), ("1717236000000", "Europe/Madrid", "2024-06-01 10:00:00"), ("soon", "UTC", None),
])
def test_instants(spark, text, tz, want):
    got = spark.createDataFrame([(text, tz)], "s string, tz string").select(tg.plain(tg.parse_instant("s", F.col("tz")))).first()[0]
    assert (str(got) if got else None) == want


def test_clock_change_days_have_92_and_100_bins(spark):
    df = spark.createDataFrame([(dt.date(2024, 3, 31),), (dt.date(2024, 10, 27),)], "d date")
    lo, hi = tg.local_range_to_utc(F.col("d"), F.col("d"), "Europe/Madrid")
    assert [r[0] for r in df.select(F.size(tg.grid(lo, hi))).collect()] == [92, 100]


def test_nan_and_infinity_become_null(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.5,)], "x double")
    assert [r[0] for r in V.clean_doubles(df).collect()] == [None, None, 1.5]


def test_unknown_vendor_gives_nulls(spark):
    df = spark.createDataFrame([("OTHER", json.dumps({"Potência ativa total": "5"}))], "provedor string, payload string")
    r = L.extract_payload(df).first()
    assert r.p_ac_w is None and r.v_dc_v is None


def test_payload_phases_ignore_zero_and_trackers_weight_by_current(spark):
    body = {"potência ativa total": "1.000,5 W", "Tensão CC MPPT1": "300", "Corrente CC MPPT1": "1", "Tensão CC MPPT2": "400", "Corrente CC MPPT2": "3",
            "Corrente CC MPPT3": "-1", "Tensão CC MPPT3": "9", "Tensão de fase R": "220", "Tensão de fase S": "0,1", "Tensão de fase T": "230"}
    r = L.extract_payload(spark.createDataFrame([("RENOVIGI", json.dumps(body))], "provedor string, payload string")).first()
    assert (r.p_ac_w, r.v_dc_v, r.i_dc_a, r.v_ac_v, r.mppt2_p_dc_w, r.mppt3_p_dc_w) == (1000.5, 375.0, 4.0, 225.0, 1200.0, None)


def test_present_null_key_wins(spark):
    df = spark.createDataFrame([('{"a": null, "b": 2}',)], "j string")
    assert df.select(L.first_present(L.payload_map("j"), ["a", "b"])).first()[0] is None


def test_table_payload_shapes(spark):
    rows = [json.dumps({"titles": ["t", "v"], "rows": [{"field": ["1", "2", "3"]}, ["4"], {"filed": []}]}), json.dumps({"row": [["x", "y"]]})]
    got = [r.record for r in L.table_payload(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, payload string")).orderBy("id", "row_no").collect()]
    assert got == [{"t": "1", "v": "2"}, {"t": "4", "v": None}, {"field_0": "x", "field_1": "y"}]


def test_weather_csv_file_and_bad_timestamp(spark, tmp_path):
    head = "Source,Loc\nNSRDB,1\nYear,Month,Day,Hour,Minute,GHI,Wind Speed\n"
    (tmp_path / "a.csv").write_text(head + "2024,1,1,0,0,5,1.5\n2024,1,1,0,30,,2\n")
    df = L.read_weather_csv(spark, str(tmp_path), F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-01 00:30:00").cast("timestamp"))
    assert sorted((r.ghi is None, r.wind_speed) for r in df.collect()) == [(False, 1.5), (True, 2.0)]
    (tmp_path / "b.csv").write_text(head + "2024,13,1,0,0,5,1.5\n")
    with pytest.raises(PySparkException, match="bad timestamp"):
        L.read_weather_csv(spark, str(tmp_path)).collect()


def test_weather_csv_finds_columns_once_per_file(spark):
    head = [("a", "Year,Month,Day,Hour,Minute,DNI,GHI"), ("b", "Year,Month,Day,Hour,Minute,RH,GHI")]
    body = [("a", "2024,1,1,0,0,7,5,surplus"), ("b", "2024,1,1,0,0,60,6")]
    df = L.csv_lines_to_weather(spark.createDataFrame(head + body, "file string, value string"))
    assert {r.file: (r.ghi, r.dni, r.rh) for r in df.collect()} == {"a": (5.0, 7.0, None), "b": (6.0, None, 60.0)}
    # no map of names is built for every line
    assert "map_from_arrays" not in df._jdf.queryExecution().optimizedPlan().toString()
    for rows, fault in ((head + [("a", "2024,1,1,0,0,7")], "cells are missing"), ([("c", "Year,Month,Day,Hour,Minute,GHI,GHI"), ("c", "2024,1,1,0,0,7,5")], "named twice")):
        with pytest.raises(PySparkException, match=fault):
            L.csv_lines_to_weather(spark.createDataFrame(rows, "file string, value string")).collect()


def test_catalogue_needs_its_headers(spark):
    with pytest.raises(ValueError, match="lacks headers"):
        L.check_catalogue(spark.createDataFrame([("x",)], "nome string"))


def test_device_match_prefers_exact_then_inclusion_then_prefix(spark):
    dev = spark.createDataFrame([(1, "ABC-1", 0), (1, "abc1xyz", 1), (1, "abz", 2)], "plant_id int, device_key string, device_order int")
    src = spark.createDataFrame([(1, "abc 1"), (1, "c1xy"), (1, "abq"), (1, "###")], "plant_id int, source_oper string")
    got = {r.source_oper: r.device_key for r in K.match_device_keys(src, dev, ["plant_id"]).collect()}
    assert got == {"abc 1": "ABC-1", "c1xy": "abc1xyz", "abq": "abz", "###": None}


def test_tied_dominant_source_is_alphabetical(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (1, "a"), (1, "c")], "plant_id int, source_oper string")
    assert K.dominant(df, ["plant_id"], ["source_oper"]).first().source_oper == "a"


def test_clock_repair_rounds_and_ignores_small_shifts(spark):
    t = dt.datetime(2024, 1, 1, 12)
    rows = [(1, "UTC", t + dt.timedelta(minutes=15 * i), str(t + dt.timedelta(minutes=15 * i + 44))) for i in range(5)]
    rows += [(2, "UTC", t, str(t + dt.timedelta(minutes=20))), (3, "America/Sao_Paulo", t, "2024-01-01 09:00:00"), (4, "UTC", t, None)]
    df = spark.createDataFrame(rows, "plant_id int, tz string, ts_utc timestamp, payload_time string")
    got = {r.plant_id: (r.clock_mode, r.shift_minutes) for r in L.repair_clock(df, ["plant_id"]).collect()}
    assert got == {1: ("utc", 45), 2: ("utc", 0), 3: ("plant_local", 0), 4: ("none", 0)}


def test_device_match_equals_brute_force(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("ab1") for _ in range(rnd.randrange(1, 7)))
    dev = [(p, word().upper(), i) for p in (1, 2) for i in range(25)]
    src = list({(p, word()) for p in (1, 2) for _ in range(60)})

    def prefix(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    def best(s, names):
        low = [(n, n.lower()) for n in names]
        exact = [n for n, d in low if d == s]
        inside = [(min(len(s), len(d)) / max(len(s), len(d)), n) for n, d in low if s in d or d in s]
        stem = [(prefix(s, d) / max(len(s), len(d)), n) for n, d in low]
        for group in (inside, stem):
            if exact:
                return exact[0]
            if group and max(group, key=lambda g: g[0])[0] > 0:
                return max(group, key=lambda g: g[0])[1]
        return None

    d = spark.createDataFrame(dev, "plant_id int, device_key string, device_order int")
    s = spark.createDataFrame(src, "plant_id int, source_oper string")
    got = {(r.plant_id, r.source_oper): r.device_key for r in K.match_device_keys(s, d, ["plant_id"]).collect()}
    assert got == {(p, x): best(x, [n for q, n, _ in dev if q == p]) for p, x in src}


def test_pages_equal_offset_paging_at_any_depth(spark):
    """Ties in time, a hot minute, rows without a time, and pages up to and behind the end."""
    rows = spark.range(4000).select(
        F.col("id").alias("event_id"),
        F.when(F.col("id") % 97 == 0, None).when(F.col("id") < 2500, F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 40)).otherwise(F.timestamp_seconds(F.lit(1_700_000_000) - F.col("id") * 977)).alias("ts_utc"),
    ).repartition(6)
    whole = [r.event_id for r in rows.orderBy(F.col("ts_utc").desc_nulls_last(), F.col("event_id").desc()).collect()]
    for page, size in ((1, 7), (3, 100), (60, 40), (24, 100), (98, 40), (100, 40), (101, 40), (500, 40)):
        got = [r.event_id for r in L.raw_page(rows, page=page, size=size).collect()]
        assert got == whole[(page - 1) * size : page * size], (page, size)


def test_a_deep_page_reads_its_slice_only(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(20000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("ts_utc")).write.parquet(path)
    page = L.raw_page(spark.read.parquet(path), page=150, size=100)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts_utc" in plan and "LessThan(ts_utc" in plan
    assert [r.event_id for r in page.collect()] == list(range(20000 - 149 * 100 - 1, 20000 - 150 * 100 - 1, -1))
