"""Rankings, event classifier, matching and training data on small inputs and against brute force."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sunloom.operators import confidence as C
from sunloom.operators import events as E
from sunloom.operators import mppt as M
from sunloom.operators import validation as VA
from sunloom.plans import sweep as SW

T0 = dt.datetime(2024, 5, 1)


def at(m):
    return T0 + dt.timedelta(minutes=m)


def test_greedy_matching_equals_sorted_scan(spark):
    rnd = random.Random(3)
    preds = [(i, 1, at(s), at(s + rnd.randrange(0, 300)), rnd.choice("ab")) for i in range(60) for s in [rnd.randrange(0, 4000)]]
    truths = [(i, 1, at(s), at(s + rnd.randrange(0, 300)), rnd.choice(["confirmed", "confirmed", "normal"]), rnd.choice("ab"), rnd.choice([None, None, None, rnd.randrange(60)]))
              for i in range(60) for s in [rnd.randrange(0, 4000)]]
    p = spark.createDataFrame(preds, "pred_id int, plant_id int, ts_start_utc timestamp, ts_end_utc timestamp, pred_label string")
    t = spark.createDataFrame(truths, "truth_id int, plant_id int, ts_start_utc timestamp, ts_end_utc timestamp, truth_state string, truth_label string, linked_pred_id int")
    got = {(r.pred_id, r.truth_id) for r in VA.match_events(p, t, ["plant_id"]).collect()}
    cand = []
    for a in preds:
        for b in truths:
            if b[4] != "confirmed":
                continue
            ov = max(0.0, (min(a[3], b[3]) - max(a[2], b[2])).total_seconds())
            link = b[6] == a[0]
            if ov <= 0 and not link:
                continue
            union = (a[3] - a[2]).total_seconds() + (b[3] - b[2]).total_seconds() - ov
            cand.append((-int(link), -(ov / union if ov > 0 and union > 0 else 0.0), -ov, a[2], a[0], b[2], b[0]))
    want, up, ut = set(), set(), set()
    for c in sorted(cand):
        if c[4] not in up and c[6] not in ut:
            want.add((c[4], c[6]))
            up.add(c[4])
            ut.add(c[6])
    assert got == want
    assert len({a for a, _ in got}) == len(got) == len({b for _, b in got})


def test_matching_without_candidates(spark):
    p = spark.createDataFrame([(1, 1, at(0), at(10), "a")], "pred_id int, plant_id int, ts_start_utc timestamp, ts_end_utc timestamp, pred_label string")
    t = spark.createDataFrame([], "truth_id int, plant_id int, ts_start_utc timestamp, ts_end_utc timestamp, truth_state string, truth_label string, linked_pred_id int")
    assert VA.match_events(p, t, ["plant_id"]).isEmpty()


def test_zero_novelty_ranks_like_one(spark):
    df = spark.createDataFrame([("mppt_imbalance", 0.5, 0.0), ("mppt_imbalance", 0.5, 1.0), ("mppt_imbalance", 0.5, 0.5), ("unknown_fault", 0.5, 0.5)], "l string, c double, n double")
    r = [x[0] for x in df.select(E.prediction_rank(F.col("l"), F.col("c"), F.col("n"))).collect()]
    assert r[0] == r[1] < r[2] and r[3] == r[2] - 1e5


def test_pass_through_labels_become_unknown_fault(spark):
    df = spark.createDataFrame([("dc_shading_soiling_probable", 0.0), ("grid_fault", 0.0), ("persistent_underperformance", 0.0)], "event_label_prelim string, clip_frac double")
    df = df.withColumns({c: F.lit(0.0) for c in ("outage_frac", "low_i_frac", "share_low_frac", "g_mean")} | {c: F.lit(1.0) for c in ("i_rel_med", "pac_ratio_mean")})
    got = {r.event_label_prelim: (r.pred_label, round(r.confidence, 2), r.pred_code) for r in M.classify_events(df).collect()}
    assert got == {"dc_shading_soiling_probable": ("unknown_fault", 0.55, 99), "grid_fault": ("grid_fault", 0.92, 4), "persistent_underperformance": ("unknown_fault", 0.58, 99)}


def test_event_confidence_bonus_steps(spark):
    rows = [(n, "a", 0.5, None, 0.5) for n in (1, 2, 4, 8) for _ in range(n)]
    df = spark.createDataFrame(rows, "e int, diagnosis_label string, data_score double, detect_score double, diag_score double")
    got = {r.e: (round(r.diag_score, 2), r.detect_score) for r in C.event_confidence(df, ["e"]).collect()}
    assert got == {1: (0.58, None), 2: (0.61, None), 4: (0.64, None), 8: (0.68, None)}


def test_no_positive_rows_gives_null_rates(spark):
    df = spark.createDataFrame([(0, 0, 3), (2, 0, 0)], "tp int, fp int, fn int").withColumns(VA.rates())
    a, b = df.orderBy("tp").collect()
    assert (a.precision, a.recall, a.f1) == (None, 0.0, None) and (b.precision, b.recall, b.f1) == (1.0, 1.0, 1.0)


def tracker_day(spark):
    rows = []
    for d in (1, 2, 3):
        for q in range(96):
            g = max(0.0, 900.0 * (1 - ((q - 48) / 24.0) ** 2))
            for k in (1, 2, 3, 4):
                rows.append((1, dt.datetime(2024, 5, d) + dt.timedelta(minutes=15 * q), d, k, 300.0, g / 200, g * 5.9, g * 6.0, 0.0, g))
    return spark.createDataFrame(rows, "plant_id int, ts_15 timestamp, day int, mppt int, v double, i double, p_ac_w double, pac_model_w double, mismatch_rel double, g_poa double")


def test_fault_injection_is_repeatable_and_consistent(spark):
    base = tracker_day(spark)
    a = M.inject_faults(base, ["plant_id"], copies=20)
    cols = ["day", "copy", "ts_15", "mppt", "fault", "y", "i", "p_ac_w"]
    assert a.select(cols).exceptAll(M.inject_faults(base, ["plant_id"], copies=20).select(cols)).isEmpty()
    faults = {r.fault for r in a.select("fault").distinct().collect()}
    assert faults == {1, 2, 3, 4, 5} and a.count() == base.count() * 20
    night = a.filter("g_poa < 120").join(base.select("ts_15", "mppt", F.col("i").alias("i0"), F.col("p_ac_w").alias("p0")), ["ts_15", "mppt"])
    assert night.filter("i <> i0 OR p_ac_w <> p0").isEmpty()
    assert a.filter("fault IN (1, 3) AND y <> 0 AND mppt <> hit").isEmpty()
    wrong = a.filter(F.abs(F.col("mismatch_rel") - (F.col("p_ac_w") - F.col("pac_model_w")) / F.greatest(F.abs("pac_model_w"), F.lit(50.0))) > 1e-9)
    assert wrong.isEmpty()


def test_day_vector_length(spark):
    d = tracker_day(spark).withColumns({c: F.lit(1.0) for c in ("v_dc_v", "i_ac_a", "temp_air", "v_ac_v", "freq_hz")} | {f"{c}_p99": F.lit(1.0) for c in ("mppt_vdc", "mppt_idc", "mppt_pdc", "pac", "vdc_total", "iac", "pac_model", "g", "t")})
    v = M.day_vectors(M.node_features(d, ["plant_id"]), ["plant_id"])
    assert v.count() == 12 and {r[0] for r in v.select(F.size("features")).collect()} == {96 * 19}


def test_sweep_candidates_respect_order():
    for t in SW.trials(120):
        assert t["coarse_g"] >= t["gpoa_min"] and t["fine_g"] >= t["coarse_g"] and t["severe_rel"] >= t["degraded_rel"]
    assert SW.trials(5) == SW.trials(5) and len(SW.trials(1000)) == 1000


@pytest.mark.parametrize("n,held", [(1, 0), (2, 1), (10, 2), (13, 3)])
def test_holdout_size(spark, n, held):
    df = spark.createDataFrame([(1, d) for d in range(n)], "plant_id int, day int")
    got = M.temporal_split(df, ["plant_id"])
    assert got.filter("split = 'validation'").count() == held and got.count() == n


def test_listings_drop_nothing_by_default(spark):
    from sunloom.operators import bins as B
    from sunloom.operators import events as E

    events = spark.range(181).selectExpr("1 as plant_id", "id as pred_id", "timestamp_seconds(id * 900) as ts_start_utc")
    best = events.selectExpr("pred_id", "'x' as label")
    assert E.event_listing(events, best, ["plant_id"], "pred_id").count() == 181
    assert E.event_listing(events, best, ["plant_id"], "pred_id", limit=7).count() == 7
    have = spark.range(0, 404, 2).selectExpr("1 as plant_id", "timestamp_seconds(id * 900) as ts_15")
    span = spark.sql("select 1 as plant_id, timestamp_seconds(0) as range_start, timestamp_seconds(403 * 900) as range_end")
    assert B.missing_ranges(have, span, ["plant_id"]).count() == 201


def test_a_sixth_tracker_counts(spark):
    import json

    from sunloom.operators import bins as B
    from sunloom.operators import mppt as M
    from sunloom.operators import totals as TT
    from sunloom.sources import landing as L

    payload = json.dumps({"Tensão CC MPPT1": "300 V", "Corrente CC MPPT1": "2 A", "Tensão CC MPPT6": "600 V", "Corrente CC MPPT6": "4 A"}, ensure_ascii=False)
    raw = spark.createDataFrame([(1, "RENOVIGI", payload)], "plant_id int, provedor string, payload string").selectExpr("*", "timestamp_seconds(0) as ts_utc")
    assert L.payload_trackers(raw) == [1, 6]
    row = L.extract_payload(raw, trackers=L.payload_trackers(raw))
    r = row.first()
    assert (r.i_dc_a, r.v_dc_v, r.mppt6_p_dc_w) == (6.0, 500.0, 2400.0) and L.extract_payload(raw).first().i_dc_a == 6.0
    assert "mppt6_idc_a" in M.tracker_bins(row, ["plant_id"]).columns and TT.observed_trackers(row, ["plant_id"]).first().n_mppt == 6
    whole = row.selectExpr("*", "ts_utc as ts_15", "'INV' as source_oper", "3000.0D as e_ac_wh_15").withColumn("p_dc_w", row.mppt1_p_dc_w + row.mppt6_p_dc_w).drop("p_ac_w").selectExpr("*", "2700.0D as p_ac_w")
    assert sorted((x.mppt, x.p_ac_w) for x in B.allocate_to_mppt(whole).collect() if x.p_dc_w) == [(1, 540.0), (6, 2160.0)]


def test_a_sixth_tracker_comes_through_without_arguments(spark):
    import json

    from pyspark.sql import functions as F

    from sunloom.operators import bins as B
    from sunloom.operators import totals as TT
    from sunloom.sources import landing as L
    from sunloom.streaming import jobs as J

    payload = json.dumps({"Tensão CC MPPT1": "300 V", "Corrente CC MPPT1": "2 A", "Tensão CC MPPT6": "600 V", "Corrente CC MPPT6": "4 A"}, ensure_ascii=False)
    raw = spark.createDataFrame([(1, "UTC", "RENOVIGI", payload)], "plant_id int, tz string, provedor string, payload string").selectExpr("*", "timestamp_seconds(86400) as ts_utc")
    rows = L.scan_telemetry(raw, *[F.timestamp_seconds(F.lit(t)) for t in (0, 172800)], ["plant_id"])
    for bins in (B.bucket_power(rows, ["plant_id"]), J.bucket_power(rows, ["plant_id"])):
        r = bins.first()
        assert (r.mppt1_p_dc_w, r.mppt6_vdc_v, r.mppt6_idc_a, r.mppt6_p_dc_w) == (600.0, 600.0, 4.0, 2400.0)
    only = rows.selectExpr("mppt6_idc_a", "false as flag_inv_missing")
    assert only.select(TT.useful_merged(only).alias("u")).first().u


def test_fault_queries_run_the_default_job(spark, monkeypatch):
    from sunloom.gallery import QUERIES
    from sunloom.plans import classifier as CL

    assert QUERIES["d33_fault_injection"](spark, "/root/testdata/sf0.001").select("copy").distinct().count() == 6
    seen = {}
    monkeypatch.setattr(CL, "labelled_days", lambda tr, sc, keys, copies=6: seen.update(copies=copies) or tr)
    monkeypatch.setattr(CL, "train_and_report", lambda d, keys, width, cfg=CL.ClassifierConfig(): (seen.update(cfg=cfg), d))
    QUERIES["d35_train_and_score"](spark, "/root/testdata/sf0.001")
    assert seen == {"copies": 6, "cfg": CL.ClassifierConfig()}


def test_pages_have_the_asked_size(spark):
    import pytest

    from sunloom.sources import landing as L

    rows = spark.range(12).selectExpr("id as event_id", "timestamp_seconds(id) as ts_utc")
    assert [r.event_id for r in L.raw_page(rows, page=2, size=5).collect()] == [6, 5, 4, 3, 2]
    with pytest.raises(ValueError):
        L.raw_page(rows, size=0)


def test_faults_hit_the_trackers_that_are_there(spark):
    """Two trackers, or seven with gaps in their numbers: every single-tracker fault finds one, and all of them are hit."""
    day = "2024-05-01"
    rows = [("two", k, h) for k in (1, 2) for h in range(8)] + [("seven", k, h) for k in (1, 2, 3, 5, 6, 8, 9) for h in range(8)]
    df = spark.createDataFrame(rows, "plant_id string, mppt int, h int").select(
        "plant_id", "mppt", F.lit(day).cast("date").alias("day"), F.timestamp_seconds(F.lit(1_714_550_400) + F.col("h") * 900).alias("ts_15"),
        *[F.lit(x).alias(n) for n, x in (("v", 300.0), ("i", 5.0), ("p_ac_w", 1000.0), ("g_poa", 500.0), ("pac_model_w", 1000.0))])
    got = M.inject_faults(df, ["plant_id"], copies=200).select("plant_id", "copy", "fault", "hit").distinct().collect()
    assert {r.hit for r in got if r.plant_id == "two"} == {1, 2} and {r.hit for r in got if r.plant_id == "seven"} == {1, 2, 3, 5, 6, 8, 9}


def test_injected_copies_are_not_shuffled(spark):
    """One shuffle brings a day together before its copies are made; the power left is that of the changed trackers."""
    got = M.inject_faults(tracker_day(spark), ["plant_id"], copies=20)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    bins = got.filter("fault IN (1, 3) AND g_poa >= 120").groupBy("day", "copy", "ts_15").agg(F.sum(F.col("v") * F.col("i")).alias("p"), F.max("p_ac_w").alias("pac"))
    assert bins.filter("pac > p + 1e-6").isEmpty() and not bins.filter("abs(pac - p) < 1e-6").isEmpty()


def test_parameter_search_stores_every_bin_once(spark, monkeypatch):
    """Blocks are stored before the trials are multiplied out, with the columns that are read only."""
    import pytest

    from sunloom.gallery import QUERIES
    from sunloom.gallery.fixtures import Tables
    from sunloom.plans import mismatch as MM

    class Seen(Exception):
        pass

    def spy(df):
        raise Seen(df.columns, df.count())

    monkeypatch.setattr(MM, "stored", spy)
    with pytest.raises(Seen) as e:
        QUERIES["d24_parameter_search"](spark, "/root/testdata/sf0.001")
    columns, n = e.value.args
    assert n == Tables(spark, "/root/testdata/sf0.001").bin_state.count() and not {"trial", "dni", "pressure"} & set(columns)


def test_stored_tables_keep_their_columns(spark):
    from sunloom.session import stored

    df = spark.range(3).selectExpr("id", "null as nothing", "struct(id as `a b`, null as x) as s").select("id", "nothing", "s.`a b`")
    assert stored(df).columns == df.columns and stored(df).collect() == df.collect()


def test_batch_detection_stores_its_rows_compressed(spark, monkeypatch):
    import pytest

    from sunloom.gallery import QUERIES
    from sunloom.plans import detection as DE

    class Seen(Exception):
        pass

    def spy(df):
        raise Seen(df.columns)

    monkeypatch.setattr(DE, "stored", spy)
    with pytest.raises(Seen) as e:
        QUERIES["d18_batch_fault_events"](spark, "/root/testdata/sf0.001")
    assert {"plant_id", "ts_15", "source_oper"} <= set(e.value.args[0])


def test_node_features_shuffle_once_and_need_whole_keys(spark):
    scales = ["mppt_vdc_p99", "mppt_idc_p99", "mppt_pdc_p99", "pac_p99", "vdc_total_p99", "iac_p99", "pac_model_p99", "g_p99", "t_p99"]
    values = ["p_ac_w", "v_dc_v", "i_ac_a", "pac_model_w", "mismatch_rel", "g_poa", "temp_air", "v_ac_v"]
    n = F.col("id")
    rows = spark.range(8).select(
        F.when(n < 6, F.lit(1)).alias("plant_id"), F.floor(n / 100).alias("day"), F.timestamp_seconds(F.floor(n / 2) * 900).alias("ts_15"), (n % 2).alias("mppt"),
        (n + 10.0).alias("v"), (n + 1.0).alias("i"), (F.lit(49.0) + n % 2).alias("freq_hz"), *[F.lit(1.0).alias(c) for c in (*scales, *values)])
    out = M.node_features(rows, ["plant_id"])
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
    got = {(r["ts_15"].minute, r["mppt"]): r for r in out.collect()}
    assert len(got) == 6  # rows without a plant have no peers and are left out
    first = got[0, 0]
    # at the first instant currents are 1 and 2, voltages 10 and 11; the median frequency of the day is 49.5
    assert abs(first["i_rel"] - 1 / 1.5) < 1e-6 and first["v_rel"] < 0 and abs(first["share_p"] - 10 / 32) < 1e-6
    assert first["freq_n"] == -0.2 and first["dv_mppt"] == 0.0 and got[15, 0]["dv_mppt"] == 0.0


def test_parameter_search_never_stores_judged_rows(spark, monkeypatch):
    """Rows are multiplied by the trials on reading only; what is stored beside the bins are summaries."""
    from sunloom.gallery.fixtures import Tables
    from sunloom.gallery.report_queries import SER, TZ, channels, runtime_input
    from sunloom.plans import mismatch as MM
    from sunloom.plans import sweep as SW

    sizes = []

    def spy(df, stored=MM.stored):
        sizes.append((out := stored(df)).count())
        return out

    monkeypatch.setattr(MM, "stored", spy)
    t = Tables(spark, "/root/testdata/sf0.001")
    got = SW.parameter_search(runtime_input(t), SER, channels(), SW.trials(3), tz=TZ)
    bins = t.bin_state.count()
    assert sizes[0] == bins and max(sizes[1:]) < bins / 10
    assert got.agg(F.sum("total")).first()[0] == 3 * bins


def test_long_rule_chains_run_in_methods_the_jvm_compiles(spark):
    import pytest

    from sunloom.session import short_methods

    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    with pytest.raises(KeyError), short_methods(spark):
        assert spark.conf.get(name) == "8000"
        raise KeyError
    assert spark.conf.get(name) == before


def test_batch_detection_solves_a_bin_once_without_storing_it_before_its_blocks(spark, monkeypatch):
    import pytest

    from sunloom.gallery import QUERIES
    from sunloom.operators import detect as D
    from sunloom.plans import detection as DE

    class Seen(Exception):
        pass

    stores = []

    def spy(df, stored=DE.stored):
        stores.append(df.columns)
        return stored(df)

    def blocks(df):
        raise Seen(df._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(DE, "stored", spy)
    monkeypatch.setattr(D, "stored", blocks)
    name = "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    try:
        with pytest.raises(Seen) as e:
            QUERIES["d18_batch_detection"](spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.set(name, before)
    assert len(stores) == 1 and "p_dc_exp_w" not in stores[0]
    assert e.value.args[0].count("AS _mpp#") == 1
