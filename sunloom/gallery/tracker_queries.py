"""Tracker tables: rule labels, scalers, features, windows, event classification, training data."""
from __future__ import annotations

from pyspark.sql import functions as F

from sunloom.gallery.fixtures import SQL_TABLES
from sunloom.gallery.registry import query
from sunloom.gallery.source_queries import string_configs
from sunloom.operators import keys as K, mppt as M, series as S, totals as TT

P = ["plant_id"]
SER = S.Series(("plant_id",), "ts_15")
KS = (1, 2, 3, 4)

SQL_TABLES["trk_wide"] = "SELECT *, " + ", ".join(
    f"v_dc_v + {4 * k} AS mppt{k}_vdc_v, CASE WHEN (eid + {k}) % 5 = 0 THEN 0.0::DOUBLE WHEN (eid + {k}) % 7 = 0 THEN NULL ELSE i_dc_a * {k} / 4 END AS mppt{k}_idc_a" for k in KS
) + " FROM bin_state"
SQL_TABLES["trk"] = " UNION ALL ".join(
    f"SELECT plant_id, ts_15, d AS day, CAST({k} AS BIGINT) AS mppt, mppt{k}_vdc_v AS v, mppt{k}_idc_a AS i, p_ac_w, v_dc_v, v_ac_v, freq_hz, pac_model_w, mismatch_rel, g_poa, temp_air, eid FROM trk_wide" for k in KS)


def wide(t):
    e = F.col("eid")
    cols = {}
    for k in KS:
        cols[f"mppt{k}_vdc_v"] = F.col("v_dc_v") + 4 * k
        cols[f"mppt{k}_idc_a"] = F.when((e + k) % 5 == 0, 0.0).when((e + k) % 7 == 0, None).otherwise(F.col("i_dc_a") * k / 4)
    return t.bin_state.withColumns(cols)


def trackers(t):
    keep = ["plant_id", "ts_15", "day", "p_ac_w", "v_dc_v", "v_ac_v", "freq_hz", "pac_model_w", "mismatch_rel", "g_poa", "temp_air", "eid"]
    return M.long_trackers(wide(t).withColumn("day", F.col("d")), keep)


@query("a15_raw_tracker_bins",
       "SELECT plant_id, device_key, time_bucket(INTERVAL 15 MINUTE, ts_utc) AS ts_15, " + ", ".join(f"avg(v_dc_v + {k}) AS mppt{k}_vdc_v, avg(CASE WHEN event_id % {k + 1} = 0 THEN i_dc_a END) AS mppt{k}_idc_a" for k in KS)
       + ", avg(p_dc_w) AS p_dc_w FROM telemetry GROUP BY 1, 2, 3", [f"mppt{k}_{c}" for k in KS for c in ("vdc_v", "idc_a")] + ["p_dc_w"])
def raw_bins(t):
    s = t.telemetry.withColumns({**{f"mppt{k}_vdc_v": F.col("v_dc_v") + k for k in KS}, **{f"mppt{k}_idc_a": F.when(F.col("event_id") % (k + 1) == 0, F.col("i_dc_a")) for k in KS}})
    return M.tracker_bins(s, ["plant_id", "device_key"])


MW = "source_oper LIKE '%|MPPT%'"


@query("j12_merge_tracker_layouts",
       f"""WITH c AS (SELECT * FROM by_source WHERE source_oper = 'INV01'), l AS (SELECT plant_id, ts_15, {", ".join(f"max(i_dc_a) FILTER (source_oper = 'INV01|MPPT{k}') AS l{k}" for k in KS)}, sum(p_dc_w) AS pdc FROM by_source WHERE {MW} GROUP BY 1, 2),
       r AS (SELECT plant_id, ts_15, {", ".join(f"CASE WHEN eid % 2 = 0 AND eid % {k + 2} = 0 THEN i_dc_a END AS r{k}" for k in KS)} FROM power_15)
       SELECT coalesce(c.plant_id, l.plant_id) AS plant_id, coalesce(c.ts_15, l.ts_15) AS ts_15, {", ".join(f"CASE WHEN coalesce(r1, r2, r3, r4) IS NOT NULL THEN r{k} ELSE l{k} END AS mppt{k}_idc_a" for k in KS)}, CASE WHEN c.plant_id IS NOT NULL THEN c.p_dc_w ELSE pdc END AS p_dc_w
       FROM c FULL JOIN l ON l.plant_id = c.plant_id AND l.ts_15 = c.ts_15 LEFT JOIN r ON r.plant_id = coalesce(c.plant_id, l.plant_id) AND r.ts_15 = coalesce(c.ts_15, l.ts_15)""", [f"mppt{k}_idc_a" for k in KS] + ["p_dc_w"])
def layouts(t):
    from sunloom.operators import bins

    b = t.by_source
    e = F.col("eid")
    raw = bins.bucket_power(t.telemetry, P, extra={"eid": F.min("event_id")})
    # every second raw bin says nothing about its trackers
    raw = raw.withColumns({f"mppt{k}_idc_a": F.when((e % 2 == 0) & (e % (k + 2) == 0), F.col("i_dc_a")) for k in KS})
    return M.merge_layouts(b.filter("source_oper = 'INV01'"), b.filter(K.is_mppt("source_oper")), raw, P).select("plant_id", "ts_15", *[f"mppt{k}_idc_a" for k in KS], "p_dc_w")


@query("d26_tracker_rule_labels",
       """WITH b AS (SELECT * FROM trk_wide WHERE (coalesce(g_poa >= 50, false) OR coalesce(coalesce(p_dc_w, p_ac_w) >= 50, false)) AND (coalesce(mppt1_idc_a, mppt2_idc_a, mppt3_idc_a, mppt4_idc_a) IS NOT NULL OR i_dc_a IS NOT NULL)),
       k AS (SELECT *, unnest([1, 2, 3, 4]) AS mppt, list_filter([mppt1_idc_a, mppt2_idc_a, mppt3_idc_a, mppt4_idc_a], lambda x: x IS NOT NULL) AS al FROM b),
       m AS (SELECT *, len(al) > 0 AS rl, CASE WHEN len(al) > 0 THEN CASE mppt WHEN 1 THEN mppt1_idc_a WHEN 2 THEN mppt2_idc_a WHEN 3 THEN mppt3_idc_a ELSE mppt4_idc_a END ELSE i_dc_a / 4 END AS i,
         list_sort(list_filter([CASE WHEN mppt <> 1 THEN mppt1_idc_a END, CASE WHEN mppt <> 2 THEN mppt2_idc_a END, CASE WHEN mppt <> 3 THEN mppt3_idc_a END, CASE WHEN mppt <> 4 THEN mppt4_idc_a END], lambda x: x IS NOT NULL)) AS pe FROM k),
       s AS (SELECT *, coalesce(list_max(pe), 0) AS mx, coalesce(list_extract(pe, CAST(len(pe) // 2 + 1 AS INTEGER)), 0) AS md FROM m WHERE i IS NOT NULL)
       SELECT plant_id, ts_15, CAST(mppt AS BIGINT) AS mppt, CASE WHEN coalesce(g_poa >= 400, false) AND (coalesce(p_ac_w <= 25, false) OR coalesce(p_dc_w <= 25, false)) THEN 'inverter_off_under_sun'
         WHEN rl AND coalesce(g_poa >= 300, false) AND mx >= 0.5 AND (i <= 0.1 OR i <= 0.05 * mx) THEN 'mppt_disconnected' WHEN rl AND coalesce(g_poa >= 300, false) AND md >= 1 AND i <= 0.25 * md THEN 'mppt_imbalance' ELSE 'normal' END AS pred_label FROM s""")
def rule_labels(t):
    return M.rule_labels(wide(t), ["plant_id", "ts_15"]).select("plant_id", "ts_15", "mppt", "pred_label")


@query("a26_plant_scalers",
       """SELECT b.plant_id, greatest(quantile_cont(p_ac_w, 0.99), 1) AS pac_p99, greatest(quantile_cont(g_poa, 0.99), 50) AS g_p99, greatest(quantile_cont(temp_air, 0.99), 10) AS t_p99, greatest(quantile_cont(v_dc_v, 0.99), 1) AS vdc_total_p99, 1e0 AS iac_p99, greatest(quantile_cont(pac_model_w, 0.99), 1) AS pac_model_p99, any_value(mv) AS mppt_vdc_p99, any_value(mi) AS mppt_idc_p99, any_value(mp) AS mppt_pdc_p99
          FROM bin_state b JOIN (SELECT plant_id, greatest(quantile_cont(v, 0.99), 1) AS mv, greatest(quantile_cont(i, 0.99), 0.1) AS mi, greatest(quantile_cont(v * i, 0.99), 1) AS mp FROM trk GROUP BY 1) k ON k.plant_id = b.plant_id GROUP BY b.plant_id""",
       ["pac_p99", "g_p99", "t_p99", "vdc_total_p99", "iac_p99", "pac_model_p99", "mppt_vdc_p99", "mppt_idc_p99", "mppt_pdc_p99"])
def scalers(t):
    # no plant measures its AC current: an empty channel
    return M.scalers(t.bin_state.withColumn("i_ac_a", F.lit(None).cast("double")), trackers(t), P)


@query("x24_scaled_values",
       """SELECT plant_id, ts_15, greatest(least(coalesce(p_ac_w, 0) / 1500, 3), 0) AS pac_n, greatest(least(coalesce(mismatch_rel, 0), 2), -2) / 2 AS mm_n, greatest(least((coalesce(freq_hz, 50) - 50) / 5, 1), -1) AS freq_n FROM bin_state""", ["pac_n", "mm_n", "freq_n"])
def scaled(t):
    c = F.col
    return t.bin_state.select("plant_id", "ts_15", M.scaled(c("p_ac_w"), F.lit(1500.0)).alias("pac_n"), M.scaled_mismatch(c("mismatch_rel")).alias("mm_n"), M.scaled_frequency(c("freq_hz"), F.lit(50.1)).alias("freq_n"))


@query("x31_nominal_normalisation",
       "SELECT plant_id, ts_15, mppt, v / 720 AS v_norm, i / 18 AS i_norm, (v / 720) * (i / 18) AS p_norm, greatest(least(g_poa / 1000, 2), 0) * CASE WHEN g_poa IS NULL THEN NULL ELSE 1 END AS g_norm FROM trk", ["v_norm", "i_norm", "p_norm", "g_norm"])
def nominal(t):
    c = F.col
    v, i, p = M.nominal_normalise(c("v"), c("i"), F.lit(18), F.lit(2), F.lit(40.0), F.lit(9.0))
    g, _ = M.weather_inputs(c("g_poa"), c("temp_air"))
    return trackers(t).select("plant_id", "ts_15", "mppt", v.alias("v_norm"), i.alias("i_norm"), p.alias("p_norm"), g.alias("g_norm"))


@query("w17_first_differences", "SELECT plant_id, ts_15, mppt, coalesce(v - lag(v) OVER w, 0) AS dv, coalesce(i - lag(i) OVER w, 0) AS di FROM trk WINDOW w AS (PARTITION BY plant_id, mppt ORDER BY ts_15)", ["dv", "di"])
def differences(t):
    s = S.Series(("plant_id", "mppt"), "ts_15")
    d = S.previous(trackers(t), s, {"_v": "v", "_i": "i"})
    zero = lambda a, b: F.coalesce(F.col(a) - F.col(b), F.lit(0.0))
    return d.select("plant_id", "ts_15", "mppt", zero("v", "_v").alias("dv"), zero("i", "_i").alias("di"))


SQL_TABLES["trk_scales"] = """SELECT b.plant_id, greatest(quantile_cont(p_ac_w, 0.99), 1) AS pac, greatest(quantile_cont(v_dc_v, 0.99), 1) AS vdc, greatest(quantile_cont(pac_model_w, 0.99), 1) AS pmo, greatest(quantile_cont(g_poa, 0.99), 50) AS g,
   greatest(quantile_cont(temp_air, 0.99), 10) AS t, any_value(mv) AS mv, any_value(mi) AS mi, any_value(mp) AS mp FROM bin_state b
   JOIN (SELECT plant_id, greatest(quantile_cont(v, 0.99), 1) AS mv, greatest(quantile_cont(i, 0.99), 0.1) AS mi, greatest(quantile_cont(v * i, 0.99), 1) AS mp FROM trk GROUP BY 1) k ON k.plant_id = b.plant_id GROUP BY b.plant_id"""
SQL_TABLES["trk_peers"] = "SELECT plant_id, ts_15, coalesce(quantile_cont(i, 0.5), 0) AS im, coalesce(quantile_cont(v, 0.5), 0) AS vm, coalesce(sum(v * i), 0) AS ps FROM trk GROUP BY 1, 2"
SQL_TABLES["trk_mains"] = "SELECT plant_id, day, CASE WHEN quantile_cont(freq_hz, 0.5) IS NULL THEN NULL WHEN quantile_cont(freq_hz, 0.5) > 55 THEN 60 ELSE 50 END AS hz FROM trk GROUP BY 1, 2"


def level(value: str, scale: str) -> str:
    return f"greatest(least(coalesce({value}, 0) / {scale}, 3), 0)"


SQL_TABLES["nodes0"] = f"""SELECT t.plant_id, t.day, t.ts_15, t.mppt, {level('v', 'mv')} AS v_mppt_n, {level('i', 'mi')} AS i_mppt_n, {level('v * i', 'mp')} AS pdc_est_n,
   greatest(least(coalesce(i, 0) / (im + 1e-9), 5), 0) AS i_rel, greatest(least((coalesce(v, 0) - vm) / (mv + 1e-9), 3), -3) AS v_rel, greatest(least(coalesce(v * i, 0) / (ps + 1e-9), 1), 0) AS share_p,
   {level('p_ac_w', 'pac')} AS pac_n, {level('v_dc_v', 'vdc')} AS vdc_total_n, 0e0 AS iac_n, {level('pac_model_w', 'pmo')} AS pac_model_n, greatest(least(coalesce(mismatch_rel, 0), 2), -2) / 2 AS mismatch_n,
   {level('g_poa', 's.g')} AS g_n, {level('temp_air', 's.t')} AS t_n, {level('v_ac_v', '1000')} AS vac_n, CASE WHEN hz IS NULL THEN 0 ELSE greatest(least((coalesce(freq_hz, hz) - hz) / 5e0, 1), -1) END AS freq_n
   FROM trk t JOIN trk_peers q ON q.plant_id = t.plant_id AND q.ts_15 = t.ts_15 JOIN trk_scales s ON s.plant_id = t.plant_id JOIN trk_mains m ON m.plant_id = t.plant_id AND m.day = t.day"""
SQL_TABLES["nodes"] = """SELECT *, greatest(least(coalesce(v_mppt_n - lag(v_mppt_n) OVER w, 0), 1), -1) AS dv_mppt, greatest(least(coalesce(i_mppt_n - lag(i_mppt_n) OVER w, 0), 1), -1) AS di_mppt,
   coalesce(pac_n - lag(pac_n) OVER w, 0) AS dpac, coalesce(mismatch_n - lag(mismatch_n) OVER w, 0) AS dmm FROM nodes0 WINDOW w AS (PARTITION BY plant_id, mppt, day ORDER BY ts_15)"""


def nodes(t):
    tr = trackers(t).withColumn("i_ac_a", F.lit(None).cast("double"))
    sc = M.scalers(t.bin_state, tr, P).withColumn("iac_p99", F.lit(1.0))
    return M.node_features(tr.join(sc, P), P)


@query("d28_node_features", f"SELECT plant_id, ts_15, mppt, {', '.join(M.NODE_FEATURES)} FROM nodes", list(M.NODE_FEATURES), longs=["mppt"])
def node_features(t):
    return nodes(t).select("plant_id", "ts_15", "mppt", *M.NODE_FEATURES)


# every value of a vector counts, by its place in the step
@query("u08_day_vectors", f"SELECT plant_id, day, mppt, count(*) * 19 AS n_values, sum({' + '.join(f'{k + 1} * {n}' for k, n in enumerate(M.NODE_FEATURES))}) AS v_sum FROM nodes GROUP BY 1, 2, 3", ["v_sum"], longs=["mppt"])
def day_vectors(t):
    f = M.day_vectors(nodes(t), P)
    weighed = F.transform("features", lambda x, i: x * (i % len(M.NODE_FEATURES) + 1))
    return f.select("plant_id", "day", "mppt", F.size("features").alias("n_values"), F.aggregate(weighed, F.lit(0.0), lambda a, x: a + x).alias("v_sum"))


@query("w18_sliding_day_windows",
       """WITH b AS (SELECT plant_id, ts_15, row_number() OVER (PARTITION BY plant_id ORDER BY ts_15) AS rn, avg(CASE WHEN mppt1_vdc_v * mppt1_idc_a > 0.001 THEN 1 ELSE 0 END) OVER w AS a1, avg(CASE WHEN mppt2_vdc_v * mppt2_idc_a > 0.001 THEN 1 ELSE 0 END) OVER w AS a2,
            avg(CASE WHEN mppt3_vdc_v * mppt3_idc_a > 0.001 THEN 1 ELSE 0 END) OVER w AS a3, sum(mppt1_idc_a) OVER w AS s1 FROM trk_wide WINDOW w AS (PARTITION BY plant_id ORDER BY ts_15 ROWS BETWEEN 95 PRECEDING AND CURRENT ROW))
       SELECT plant_id, ts_15 AS ts_end, 96 AS n, coalesce(s1, 0) AS i1_sum FROM b WHERE rn >= 96 AND (rn - 96) % 4 = 0 AND (a1 >= 0.1)::INT + (a2 >= 0.1)::INT + (a3 >= 0.1)::INT >= 2""", ["i1_sum"], longs=["n"])
def windows(t):
    w = wide(t).withColumns({f"p{k}": F.col(f"mppt{k}_vdc_v") * F.col(f"mppt{k}_idc_a") for k in (1, 2, 3)})
    out = M.sliding_windows(w, SER, ["mppt1_idc_a", "g_poa"], stride=4, active=["p1", "p2", "p3"])
    total = F.aggregate("mppt1_idc_a", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return out.select("plant_id", "ts_end", F.size("mppt1_idc_a").alias("n"), total.alias("i1_sum"))


@query("d27_weak_window_labels",
       """WITH f AS (SELECT plant_id, ts_15, row_number() OVER (PARTITION BY plant_id ORDER BY ts_15) AS rn, count(*) FILTER (sun) OVER w AS s, """ + ", ".join(
           f"count(*) FILTER (sun AND i{k} IS NOT NULL) OVER w AS n{k}, count(*) FILTER (sun AND i{k} <= 0.02) OVER w AS l{k}, count(*) FILTER (sun AND i{k} >= 0.05) OVER w AS h{k}" for k in (1, 2, 3))
       + """ FROM (SELECT *, coalesce(g_poa >= 300, false) AS sun, mppt1_idc_a / 9 AS i1, mppt2_idc_a / 9 AS i2, CASE WHEN d % 3 <> 0 THEN 0.0::DOUBLE ELSE mppt3_idc_a / 9 END AS i3 FROM trk_wide) WINDOW w AS (PARTITION BY plant_id ORDER BY ts_15 ROWS BETWEEN 95 PRECEDING AND CURRENT ROW)),
       l AS (SELECT *, """ + ", ".join(f"coalesce(n{k} >= 12 AND h{k} / n{k} >= 0.5, false) AS o{k}" for k in (1, 2, 3)) + """ FROM f WHERE rn >= 96 AND (rn - 96) % 4 = 0)
       SELECT plant_id, ts_15 AS ts_end, """ + ", ".join(f"CASE WHEN NOT (s >= 12 AND n{k} >= 12) THEN -100 WHEN ({' OR '.join(f'o{m}' for m in (1, 2, 3) if m != k)}) AND l{k} / n{k} >= 0.7 THEN 1 ELSE 0 END AS y{k}" for k in (1, 2, 3)) + " FROM l", longs=["y1", "y2", "y3"])
def weak(t):
    w = wide(t).withColumns({"i1": F.col("mppt1_idc_a") / 9, "i2": F.col("mppt2_idc_a") / 9, "i3": F.when(F.col("d") % 3 != 0, 0.0).otherwise(F.col("mppt3_idc_a") / 9)})
    return M.weak_labels(w, SER, ["i1", "i2", "i3"], stride=4)


@query("d29_tracker_edges",
       """WITH c AS (SELECT p_partkey // 8 AS plant_id, p_partkey % 4 + 1 AS mppt, p_size % 5 + 1 AS strings_qty, p_size // 30 + 10 AS m FROM part),
       l AS (SELECT plant_id, mppt, m AS ns, row_number() OVER (PARTITION BY plant_id, mppt ORDER BY count(*) DESC, m) AS rn FROM c GROUP BY 1, 2, 3), n AS (SELECT c.plant_id, c.mppt, sum(strings_qty) AS np, any_value(ns) AS ns FROM c JOIN l ON l.plant_id = c.plant_id AND l.mppt = c.mppt AND rn = 1 GROUP BY 1, 2)
       SELECT a.plant_id, a.mppt AS mppt_a, b.mppt AS mppt_b, (a.ns - b.ns) / greatest(a.ns, b.ns, 1) AS d_series, (a.np - b.np) / greatest(a.np, b.np, 1) AS d_parallel FROM n a JOIN n b ON a.plant_id = b.plant_id AND a.mppt <> b.mppt""", ["d_series", "d_parallel"])
def edges(t):
    return M.edge_features(TT.tracker_nominals(string_configs(t))).drop("d_tilt", "d_azimuth")


SQL_TABLES["evt"] = """SELECT pred_id, plant_id, ts_start_utc, ts_end_utc, list_extract(['dc_side_partial_loss', 'persistent_underperformance', 'grid_fault', 'curtailment_clipping', 'other'], CAST(pred_id % 5 + 1 AS INTEGER)) AS pre, pred_label AS dom FROM pred_events"""
SQL_TABLES["evt_bins"] = "SELECT e.*, unnest(generate_series(ts_start_utc - INTERVAL 2 HOUR, ts_end_utc + INTERVAL 2 HOUR, INTERVAL 15 MINUTE)) AS ts_15 FROM evt e"
SQL_TABLES["evt_trk"] = "SELECT e.pred_id, e.ts_15, e.ts_15 BETWEEN ts_start_utc AND ts_end_utc AS ine, t.* EXCLUDE (plant_id, ts_15, eid) FROM evt_bins e LEFT JOIN trk t ON t.plant_id = e.plant_id AND t.ts_15 = e.ts_15"
SQL_TABLES["evt_feat"] = """SELECT x.pred_id, mppt, quantile_cont(ir, 0.5) AS i_rel_med, quantile_cont(vr, 0.5) AS v_rel_med, quantile_cont(sh, 0.5) AS share_p_med, avg((ir <= 0.15)::INT) AS outage_frac, avg((ir <= 0.5)::INT) AS low_i_frac, avg((vr <= 0.8)::INT) AS low_v_frac, avg((sh <= 0.125)::INT) AS share_low_frac FROM
   (SELECT a.pred_id, mppt, CASE WHEN i IS NULL THEN 0 ELSE i / greatest(im, 1e-9) END AS ir, CASE WHEN v IS NULL THEN 0 ELSE v / greatest(abs(vm), 1e-9) END AS vr, CASE WHEN v * i IS NULL THEN 0 ELSE v * i / greatest(ps, 1e-9) END AS sh FROM evt_trk a
    JOIN (SELECT pred_id, ts_15, quantile_cont(i, 0.5) AS im, quantile_cont(v, 0.5) AS vm, coalesce(sum(v * i), 0) AS ps FROM evt_trk WHERE ine GROUP BY 1, 2) b ON b.pred_id = a.pred_id AND b.ts_15 = a.ts_15 WHERE ine AND mppt IS NOT NULL) x GROUP BY 1, 2"""
SQL_TABLES["evt_plant"] = """SELECT a.pred_id, any_value(pre) AS pre, any_value(dom) AS dom, count(*) AS duration_bins, coalesce(avg(mismatch_rel), 0) AS mismatch_mean, avg(CASE WHEN p_ac_w IS NULL OR pac_model_w IS NULL THEN 0 ELSE p_ac_w / greatest(abs(pac_model_w), 50) END) AS pac_ratio_mean,
   avg((coalesce(p_ac_w, 0) <= greatest(100, 0.05 * cap))::INT) AS zero_power_frac, avg((coalesce(cap > 0 AND p_ac_w >= 0.98 * cap AND pac_model_w > p_ac_w * 1.02, false))::INT) AS clip_frac, coalesce(avg(g_poa), 0) AS g_mean
   FROM (SELECT e.*, p_ac_w, pac_model_w, mismatch_rel, g_poa FROM evt_bins e LEFT JOIN bin_state b ON b.plant_id = e.plant_id AND b.ts_15 = e.ts_15) a
   JOIN (SELECT e.pred_id, coalesce(quantile_cont(p_ac_w, 0.99), 0) AS cap FROM evt_bins e LEFT JOIN bin_state b ON b.plant_id = e.plant_id AND b.ts_15 = e.ts_15 GROUP BY 1) c ON c.pred_id = a.pred_id WHERE ts_15 BETWEEN ts_start_utc AND ts_end_utc GROUP BY 1"""
SQL_TABLES["evt_pred0"] = """SELECT f.*, pre, dom, CASE WHEN pre = 'grid_fault' THEN 'grid_fault' WHEN pre = 'curtailment_clipping' OR clip_frac >= 0.5 THEN 'curtailment_clipping' WHEN pre IN ('dc_side_partial_loss', 'persistent_underperformance') THEN
   CASE WHEN outage_frac >= 0.6 AND i_rel_med <= 0.2 THEN 'probable_mppt_disconnect' WHEN low_i_frac >= 0.6 AND share_low_frac >= 0.5 AND i_rel_med <= 0.65 THEN 'mppt_imbalance' WHEN pac_ratio_mean <= 0.75 AND g_mean >= 700 THEN 'dc_side_partial_loss' ELSE 'unknown_fault' END ELSE 'unknown_fault' END AS pred_label FROM evt_feat f JOIN evt_plant p ON p.pred_id = f.pred_id"""
SQL_TABLES["evt_pred"] = """SELECT *, CASE pred_label WHEN 'grid_fault' THEN 0.92 WHEN 'curtailment_clipping' THEN 0.9 WHEN 'probable_mppt_disconnect' THEN least(0.95, 0.72 + 0.2 * outage_frac) WHEN 'mppt_imbalance' THEN 0.78 WHEN 'dc_side_partial_loss' THEN 0.7 ELSE CASE WHEN pre IN ('dc_side_partial_loss', 'persistent_underperformance') THEN 0.58 ELSE 0.55 END END AS confidence FROM evt_pred0"""


def chosen_events(t):
    p = F.col("pred_id")
    pre = F.element_at(F.array(*[F.lit(x) for x in ("dc_side_partial_loss", "persistent_underperformance", "grid_fault", "curtailment_clipping", "other")]), (p % 5 + 1).cast("int"))
    return t.pred_events.select("pred_id", "plant_id", "ts_start_utc", "ts_end_utc", pre.alias("event_label_prelim"), F.col("pred_label").alias("dominant_diagnosis"))


def event_preds(t):
    ev = chosen_events(t)
    tr = M.event_windows(ev, trackers(t), P, "pred_id").filter(F.col("mppt").isNotNull())
    plant = M.event_plant_features(M.event_windows(ev, t.bin_state, P, "pred_id"), "pred_id")
    f = M.event_tracker_features(tr, "pred_id").join(plant, "pred_id").join(ev.select("pred_id", "event_label_prelim", "dominant_diagnosis"), "pred_id")
    return M.classify_events(f)


@query("w19_event_context_windows", "SELECT pred_id, count(*) AS n, count(*) FILTER (ine) AS n_in, count(p_ac_w) AS n_real FROM evt_trk GROUP BY 1")
def context(t):
    w = M.event_windows(chosen_events(t), trackers(t), P, "pred_id")
    return w.groupBy("pred_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("in_event").alias("n_in"), F.count("p_ac_w").alias("n_real"))


FEATS = ["i_rel_med", "v_rel_med", "share_p_med", "outage_frac", "low_i_frac", "low_v_frac", "share_low_frac"]


@query("d30_event_tracker_features", "SELECT pred_id, mppt, " + ", ".join(FEATS) + " FROM evt_feat", FEATS)
def event_features(t):
    tr = M.event_windows(chosen_events(t), trackers(t), P, "pred_id").filter(F.col("mppt").isNotNull())
    return M.event_tracker_features(tr, "pred_id").select("pred_id", "mppt", *FEATS)


@query("d30_event_plant_features", "SELECT pred_id, duration_bins, mismatch_mean, pac_ratio_mean, zero_power_frac, clip_frac, g_mean FROM evt_plant", ["mismatch_mean", "pac_ratio_mean", "zero_power_frac", "clip_frac", "g_mean"])
def plant_features(t):
    return M.event_plant_features(M.event_windows(chosen_events(t), t.bin_state, P, "pred_id"), "pred_id").select("pred_id", "duration_bins", "mismatch_mean", "pac_ratio_mean", "zero_power_frac", "clip_frac", "g_mean")


@query("d31_classify_events", "SELECT pred_id, mppt, pred_label, confidence FROM evt_pred", ["confidence"])
def classify(t):
    return event_preds(t).select("pred_id", "mppt", "pred_label", "confidence")


@query("d31_resolve_event_labels",
       """WITH s AS (SELECT pred_id, pre, dom, pred_label, sum(confidence) AS c, count(*) AS n FROM evt_pred GROUP BY 1, 2, 3, 4), g AS (SELECT pred_id, pre, dom, arg_min(pred_label, (-c, pred_label)) FILTER (pred_label <> 'unknown_fault') AS k, sum(c) FILTER (pred_label <> 'unknown_fault') / sum(n) FILTER (pred_label <> 'unknown_fault') AS kc,
         sum(c) FILTER (pred_label = 'unknown_fault') / sum(n) FILTER (pred_label = 'unknown_fault') AS uc FROM s GROUP BY 1, 2, 3)
       SELECT pred_id, CASE WHEN pre IN ('grid_fault', 'curtailment_clipping') THEN dom WHEN k IS NOT NULL THEN k WHEN pre IN ('dc_side_partial_loss', 'persistent_underperformance') THEN dom ELSE 'unknown_fault' END AS final_label,
         CASE WHEN pre = 'grid_fault' THEN 0.88 WHEN pre = 'curtailment_clipping' THEN 0.82 WHEN k IS NOT NULL THEN kc WHEN pre IN ('dc_side_partial_loss', 'persistent_underperformance') THEN 0.62 ELSE uc END AS confidence FROM g""", ["confidence"])
def resolve(t):
    return M.resolve_events(event_preds(t), "pred_id").select("pred_id", "final_label", "confidence")


DAYS = """WITH f AS (SELECT plant_id, d AS day, count(*) FILTER (sun) AS n, quantile_cont(p_ac_w, 0.9) FILTER (sun) AS p90, quantile_cont(abs(mismatch_rel), 0.9) FILTER (sun AND pac_model_w >= 80) AS m, count(mismatch_rel) FILTER (sun AND pac_model_w >= 80) AS k FROM
  (SELECT *, coalesce(g_poa >= 120, false) AND p_ac_w IS NOT NULL AS sun FROM bin_state) GROUP BY 1, 2), u AS (SELECT *, n >= 12 AND coalesce(p90 >= 80, false) AS usable FROM f),
  o AS (SELECT *, usable AND CASE WHEN k >= 12 THEN m <= 0.95 ELSE true END AS normal FROM u), a AS (SELECT *, CASE WHEN bool_or(normal) OVER (PARTITION BY plant_id) THEN normal ELSE usable END AS pick FROM o),
  r AS (SELECT *, pick AND row_number() OVER (PARTITION BY plant_id, pick ORDER BY day DESC) <= 10 AS base FROM a) """


@query("d32_training_days", DAYS + "SELECT plant_id, day, usable, normal, base FROM r")
def days(t):
    cfg = M.DayConfig(max_abs_p90=0.95, days=10)
    return M.training_days(t.bin_state.withColumn("day", F.col("d")), P, cfg=cfg)


@query("d33_fault_injection")
def injected(t):
    f = M.inject_faults(trackers(t), P)
    return f.groupBy("plant_id", "day", "copy", "mppt", "fault").agg(F.max("y").alias("y"), F.avg("mismatch_rel").alias("mm_mean"), F.sum("i").alias("i_sum"), F.count(F.lit(1)).alias("n"))


@query("d34_temporal_split",
       """WITH d AS (SELECT DISTINCT plant_id, d AS day FROM weather), r AS (SELECT *, row_number() OVER (PARTITION BY plant_id ORDER BY day DESC) AS k, count(*) OVER (PARTITION BY plant_id) AS n FROM d)
       SELECT plant_id, day, CASE WHEN n >= 2 AND k <= greatest(1, least(greatest(round_even(n * 0.2, 0), 1), n - 1)) THEN 'validation' ELSE 'train' END AS split FROM r""")
def split(t):
    return M.temporal_split(t.weather.select("plant_id", F.col("d").alias("day")).distinct(), P)


@query("d36_model_health",
       """SELECT p_partkey, CASE WHEN ms = 'validation' AND f1 IS NOT NULL THEN CASE WHEN vs < 50 OR vd < 5 OR vs / 4000 < 0.1 THEN 'atencao' WHEN f1 >= 0.75 AND f1 >= 0.7 AND vs >= 500 AND vd >= 14 THEN 'confiavel' WHEN f1 >= 0.6 AND vs >= 300 AND vd >= 10 THEN 'atencao' ELSE 'recalibrar' END
          WHEN ms = 'train' THEN 'atencao' ELSE 'recalibrar' END AS status FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'train' WHEN 1 THEN 'none' ELSE 'validation' END AS ms, CASE WHEN p_partkey % 17 <> 0 THEN p_size / 50 END AS f1, p_partkey % 1500 AS vs, p_partkey % 20 AS vd FROM part)""")
def health(t):
    k = F.col("p_partkey")
    f1 = F.when(k % 17 != 0, F.col("p_size") / 50)
    m = t.raw("part").select("p_partkey", F.when(k % 5 == 0, "train").when(k % 5 == 1, "none").otherwise("validation").alias("metrics_source"), f1.alias("f1_macro"), f1.alias("balanced_accuracy"),
                             (k % 1500).alias("validation_samples"), (k % 20).alias("validation_days"), F.lit(4000).alias("total_samples"), F.lit(10).alias("train_samples"))
    return M.model_health(m).select("p_partkey", "status")


@query("d35_train_and_score")
def train_and_score(t):
    from sunloom.plans import classifier as CL

    tr = trackers(t).withColumn("i_ac_a", F.lit(None).cast("double"))
    sc = M.scalers(t.bin_state, tr, P).withColumn("iac_p99", F.lit(1.0))
    days = CL.labelled_days(tr, sc, P)
    _, report = CL.train_and_report(days, P, 1824)
    return report
