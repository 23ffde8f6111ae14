"""Sinks, artefacts and streaming jobs against their batch twins."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from sunloom.operators import bins as B
from sunloom.operators import series as S
from sunloom.plans import classifier as CL
from sunloom.sources import tables as TB
from sunloom.sources.versions import VersionedTable
from sunloom.streaming import filters as X, jobs as J

T0 = dt.datetime(2024, 5, 1)


def rows(spark, items):
    return spark.createDataFrame([(p, T0 + dt.timedelta(hours=h), v) for p, h, v in items], "plant_id int, ts timestamp, v double").withColumn("day", F.to_date("ts"))


def read(spark, path):
    return sorted((r.plant_id, int((r.ts - T0).total_seconds() // 3600), r.v) for r in spark.read.parquet(path).collect())


def test_upsert_counts_and_content(spark, tmp_path):
    path = str(tmp_path / "t")
    assert TB.upsert_table(rows(spark, [(1, 0, 1.0), (1, 30, 2.0)]), path, ["plant_id", "ts"], ["day"]) == {"insert": 2, "update": 0}
    assert TB.upsert_table(rows(spark, [(1, 30, 9.0), (2, 31, 3.0)]), path, ["plant_id", "ts"], ["day"]) == {"insert": 1, "update": 1}
    assert read(spark, path) == [(1, 0, 1.0), (1, 30, 9.0), (2, 31, 3.0)]


def test_replace_range_keeps_the_rest_and_can_empty_a_day(spark, tmp_path):
    path = str(tmp_path / "t")
    TB.write_partitions(rows(spark, [(1, 0, 1.0), (1, 30, 2.0), (2, 30, 5.0), (3, 60, 6.0)]), path, ["day"])
    new = rows(spark, [(1, 31, 7.0)])
    r = spark.createDataFrame([(1, T0, T0 + dt.timedelta(hours=40))], "plant_id int, range_start timestamp, range_end timestamp")
    TB.replace_range_table(new, r, path, ["plant_id"], "ts", ["day"])
    assert read(spark, path) == [(1, 31, 7.0), (2, 30, 5.0), (3, 60, 6.0)]


def test_provenance_row(spark, tmp_path):
    path = str(tmp_path / "audit")
    for n in (10, 20):
        TB.append_provenance(spark, path, {"source": "weather", "rows": n})
    assert sorted(r.rows for r in spark.read.parquet(path).collect()) == [10, 20]


def test_report_file(spark, tmp_path):
    TB.write_report(spark.range(3), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 3


def test_artifacts_round_trip(spark, tmp_path):
    d = spark.createDataFrame([([float(i % 3), float(i)], i % 3) for i in range(60)], "features array<double>, y int")
    model = CL.train(d, 2, CL.ClassifierConfig(kind="forest", trees=5))
    CL.save_artifacts(model, spark.createDataFrame([(1, 2.0)], "plant_id int, pac_p99 double"), {"samples": 60}, str(tmp_path), "v1")
    back, sc = CL.load_artifacts(spark, str(tmp_path), "v1")
    assert CL.score(back, d).filter("pred_code = y").count() > 55 and sc.first().pac_p99 == 2.0
    assert [r[0] for r in CL.list_versions(spark, str(tmp_path)).collect()] == ["v1"]


def test_perceptron_learns_on_balanced_rows(spark):
    d = spark.createDataFrame([([float(i % 2), 1.0 - i % 2], i % 2) for i in range(80)], "features array<double>, y int")
    out = CL.score(CL.train(d, 2, CL.ClassifierConfig(hidden=(4,), iterations=60)), d)
    assert out.filter("pred_code = y").count() == 80


def land(spark, path, parts):
    for n, part in enumerate(parts):
        spark.createDataFrame([(p, T0 + dt.timedelta(minutes=m), v, m) for p, m, v in part], "plant_id int, ts_utc timestamp, p_ac_w double, event_id long").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_buckets_equal_batch(spark, tmp_path):
    path = str(tmp_path / "in")
    s = land(spark, path, [[(1, m, float(m)) for m in range(0, 60, 5)], [(1, m, float(m)) for m in range(60, 400, 5)]])
    live = J.run_to_table(J.bucket_power(s, ["plant_id"]), "complete").select("ts_15", "p_ac_w", "inv_n")
    batch = B.bucket_power(spark.read.parquet(path), ["plant_id"]).select("ts_15", "p_ac_w", "inv_n")
    assert live.exceptAll(batch).isEmpty() and live.count() == batch.count()
    closed = J.run_to_table(J.bucket_power(s, ["plant_id"]), "append")
    assert 0 < closed.count() < batch.count()


def filtered(spark, root, parts, **kw):
    """The finished rows of deliveries [(plant, minute, value)] and a closing row, by (series, minute)."""
    make = lambda items: spark.createDataFrame([(p, T0 + dt.timedelta(minutes=m), v, m) for p, m, v in items], "plant_id int, ts_utc timestamp, p_ac_w double, event_id long")
    everything = make([r for part in parts for r in part])
    for part in [*map(make, parts), J.closing_row(everything, "ts_utc")]:
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
        s = spark.readStream.schema(everything.schema).parquet(f"{root}/in")
        X.filter_state(s, str(root), "plant_id", "ts_utc", "p_ac_w", F.col("event_id") % 9 != 0, "event_id", **kw)
    return everything, {(r.series, r.tie): r for r in X.finished(spark, str(root)).collect()}


def test_stream_filters_equal_batch_whatever_the_cuts(spark, tmp_path):
    rows = [(p, m, None if m % 17 == 3 else (m * (p + 1) % 7) / 3.0 - 1) for p in (1, 2) for m in range(240)]
    # neighbours swapped across deliveries, all within the delay
    mixed = sorted(rows, key=lambda r: r[1] + 50 * (r[1] * 7 % 3))
    cuts = [[rows], [mixed[:100], mixed[100:230], mixed[230:]]]
    answers = [filtered(spark, tmp_path / str(n), parts) for n, parts in enumerate(cuts)]
    ok = F.col("event_id") % 9 != 0
    ser = S.for_ewma(S.Series(("plant_id",), "ts_utc"), 0.2)
    batch = S.add_filters(S.blocks(answers[0][0], ser), ser, "p_ac_w", ok, 0.2, 0.5).collect()
    for _, live in answers:
        assert len(live) == len(rows) and not any(r.late for r in live.values())
        for r in batch:
            got = live[str(r.plant_id), r.event_id]
            assert (got.ewma_z is None) == (r.ewma is None) and (got.cusum_score is None) == (r.cusum_score is None)
            if r.ewma is not None:
                assert abs(got.ewma_z - r.ewma) < 1e-9 and abs(got.cusum_score - r.cusum_score) < 1e-9


def test_stream_filters_late_rows_idle_series_and_replay(spark, tmp_path):
    day = 24 * 60
    parts = [[(1, m, 1.0) for m in range(1, 8)], [(2, 3 * day, 1.0), (1, 3 * day + 1, 0.0)], [(1, 2, 5.0), (None, 3 * day + 2, 1.0)], [(1, 9 * day + 2, 0.0)]]
    _, out = filtered(spark, tmp_path / "a", parts, idle_s=4 * 86400)
    late = X.finished(spark, str(tmp_path / "a")).filter("late").collect()
    assert [(r.series, r.tie, r.ewma_z, r.cusum_score) for r in late] == [("1", 2, None, None)]
    # 0.8 of the mean is left after a zero; after more than four idle days the series starts anew
    assert abs(out["1", 3 * day + 1].ewma_z - 0.8) < 1e-9 and out[None, 3 * day + 2].ewma_z == 1.0
    assert out["1", 9 * day + 2].ewma_z == 0.0
    _, once = filtered(spark, tmp_path / "b", [[r for n, part in enumerate(parts) for r in part if (n, r[1]) != (2, 2)]], idle_s=4 * 86400)
    later = lambda rows: {k: pytest.approx((r.ewma_z, r.cusum_score), nan_ok=True) for k, r in rows.items() if k[1] > 2 * day}
    assert len(later(out)) == 4 and later(out).keys() == later(once).keys()
    assert all((out[k].ewma_z, out[k].cusum_score) == v for k, v in later(once).items())
    n = len(X._finished(spark, str(tmp_path / "a")))
    assert n == 5 and len([p for p in (tmp_path / "a" / "carry").iterdir()]) == 2


def test_reprocess_replaces_its_range(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    s = land(spark, src, [[(1, 0, 1.0), (1, 15, 2.0)], [(1, 0, 5.0), (1, 15, 6.0)]]).withColumn("day", F.to_date("ts_utc"))
    J.reprocess(s, out, ["plant_id"], "ts_utc", ["day"], str(tmp_path / "log")).awaitTermination()
    table = VersionedTable(spark, out, s.schema, ("day",))
    got = sorted(r.p_ac_w for r in table.read().collect())
    assert got in ([1.0, 2.0], [5.0, 6.0]) and len(got) == 2 and table.commits() == [1, 2]


def readings(spark, items):
    day = lambda m: str((T0 + dt.timedelta(minutes=m)).date()) if m is not None else None
    at = lambda m: None if m is None else T0 + dt.timedelta(minutes=m)
    return spark.createDataFrame([(p, at(m), day(m), v) for p, m, v in items], "plant_id int, ts timestamp, day string, v double")


def spans(spark, *items):
    return spark.createDataFrame([(p, T0 + dt.timedelta(minutes=a), T0 + dt.timedelta(minutes=b)) for p, a, b in items], "plant_id int, range_start timestamp, range_end timestamp")


def test_replacement_lost_before_its_commit_leaves_the_table_whole(spark, tmp_path, monkeypatch):
    day = 24 * 60
    first = readings(spark, [(1, 0, 1.0), (1, day, 2.0), (1, 2 * day, 3.0), (2, 5, 4.0), (None, None, 5.0), (2, 5, 4.0)])
    table = VersionedTable(spark, str(tmp_path / "t"), first.schema, ("day",))
    values = lambda: sorted(r.v for r in table.read().collect())
    assert values() == []
    table.replace(first, spans(spark), ["plant_id"], "ts", batch="a")
    whole = [1.0, 2.0, 3.0, 4.0, 4.0, 5.0]
    assert values() == whole
    new, r = readings(spark, [(1, 10, 9.0)]), spans(spark, (1, 0, day + 1))

    def lost(*_args, **_kw):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "commit", lost)
        with pytest.raises(RuntimeError):
            table.replace(new, r, ["plant_id"], "ts", batch="b")
    assert values() == whole and table.commits() == [1] and not table.applied("b")
    assert table.replace(new, r, ["plant_id"], "ts", batch="b") == 2
    assert values() == [3.0, 4.0, 4.0, 5.0, 9.0]
    assert table.replace(new, r, ["plant_id"], "ts", batch="b") is None and table.replace(first, r, ["plant_id"], "ts", batch="a") is None
    assert values() == [3.0, 4.0, 4.0, 5.0, 9.0]
    assert table.replace(readings(spark, []), spans(spark, (2, 0, day)), ["plant_id"], "ts") == 3
    assert values() == [3.0, 5.0, 9.0]


def test_of_two_writers_on_one_commit_the_second_fails(spark, tmp_path):
    rows = readings(spark, [(1, 0, 1.0)])
    table = VersionedTable(spark, str(tmp_path / "t"), rows.schema, ("day",))
    table.commit(table.stage(rows), rows, rows, base=0)
    with pytest.raises(FileExistsError):
        table.commit(table.stage(rows), rows, rows, base=0)
    assert table.read().count() == 1


def test_deliveries_close_buckets_and_count_late_rows(spark):
    make = lambda ms: spark.createDataFrame([(p, T0 + dt.timedelta(minutes=m), float(m), m) for p, m in ms], "plant_id int, ts_utc timestamp, p_ac_w double, event_id long")
    on_time, late = [(p, m) for m in range(0, 300, 5) for p in (1, None)], [(1, 7), (1, 8), (None, 3), (2, 4)]
    job = lambda s: J.bucket_power(s, ["plant_id"])
    landed, closed = J.run_deliveries([make(on_time[:40]), make(on_time[40:]), J.closing_row(make(on_time), "ts_utc"), make(late)], job)
    landed = landed.filter("event_id IS NOT NULL")
    out = J.count_late(landed.select("plant_id", F.window("ts_utc", "15 minutes").start.alias("ts_15")), closed, ["plant_id", "ts_15"], "inv_n")
    rows = {(r.plant_id, (r.ts_15 - T0).seconds // 60): r for r in out.collect()}
    assert {k: r.late_n for k, r in rows.items() if r.late_n} == {(1, 0): 2, (None, 0): 1, (2, 0): 1}
    assert rows[2, 0].inv_n is None and len(rows) == 41
    batch = B.bucket_power(make(on_time), ["plant_id"]).select("plant_id", "ts_15", "p_ac_w", "inv_n")
    live = out.filter("inv_n IS NOT NULL").select("plant_id", "ts_15", "p_ac_w", "inv_n")
    assert live.exceptAll(batch).isEmpty() and batch.exceptAll(live).isEmpty()
    assert J.closing_row(make([(1, 1)]).limit(0), "ts_utc").isEmpty()


def test_ingest_state_writer(spark, tmp_path):
    path = str(tmp_path / "state")
    write = J.record_state(["plant_id"], path)
    make = lambda items: spark.createDataFrame(items, "plant_id int, day date, error string")
    write(make([(1, dt.date(2024, 5, 1), None)]), 0)
    write(make([(1, dt.date(2024, 5, 2), "x" * 6000)]), 1)
    r = spark.read.parquet(path).first()
    assert r.status == "error" and len(r.error) == 6000 and r.last_ok_day == dt.date(2024, 5, 1)


def test_upsert_takes_the_last_update_and_moves_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda items: spark.createDataFrame(items, "id int, day string, v double, seq int")
    TB.upsert_table(make([(1, "a", 1.0, 1), (2, "a", 2.0, 1), (3, "b", 3.0, 1)]), path, ["id"], ["day"])
    counts = TB.upsert_table(make([(3, "a", 7.0, 3), (3, "c", 9.0, 2), (4, "c", 4.0, 1)]), path, ["id"], ["day"], order=["seq"])
    got = sorted((r.id, r.day, r.v) for r in spark.read.parquet(path).collect())
    assert counts == {"insert": 1, "update": 1} and got == [(1, "a", 1.0), (2, "a", 2.0), (3, "a", 7.0), (4, "c", 4.0)]
    assert not (tmp_path / "t" / "day=b").exists()


def test_replaced_range_drops_only_the_empty_partition(spark, tmp_path):
    path = str(tmp_path / "r")
    at = lambda d, h: dt.datetime(2024, 5, d, h)
    make = lambda items: spark.createDataFrame([(1, t, str(t.date()), v) for t, v in items], "plant_id int, ts timestamp, day string, v double")
    TB.write_partitions(make([(at(1, 1), 1.0), (at(2, 1), 2.0), (at(3, 1), 3.0)]), path, ["day"])
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "r" / "day=2024-05-03").iterdir()}
    r = spark.createDataFrame([(1, at(2, 0), at(2, 23))], "plant_id int, range_start timestamp, range_end timestamp")
    TB.replace_range_table(make([(at(1, 5), 5.0)]), r, path, ["plant_id"], "ts", ["day"])
    assert sorted(x.v for x in spark.read.parquet(path).collect()) == [1.0, 3.0, 5.0] and not (tmp_path / "r" / "day=2024-05-02").exists()
    assert before == {p: p.stat().st_mtime_ns for p in (tmp_path / "r" / "day=2024-05-03").iterdir()}


def test_only_a_missing_path_is_an_absent_table(spark, tmp_path):
    assert TB._stored(spark, str(tmp_path / "none"), spark.range(1)) is None
