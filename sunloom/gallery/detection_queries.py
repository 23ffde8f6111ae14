"""Weather QC, residuals, detection, root cause, confidences and events."""
from __future__ import annotations

from pyspark.sql import functions as F

from sunloom.config import DetectConfig
from sunloom.functions import labels as LB, values as V
from sunloom.gallery.fixtures import SQL_TABLES
from sunloom.gallery.registry import query
from sunloom.operators import confidence as C, detect as D, events as E, quality as Q, rca as RC, residuals as R, series as S
from sunloom.session import checkpointed

P = ["plant_id"]
SER = S.Series(("plant_id",), "ts_15")
WX = ["ghi", "dni", "dhi", "gti", "temp_air", "wind_speed", "rh", "pressure"]

SQL_TABLES["weather_raw"] = """SELECT * EXCLUDE (ghi, temp_air, wind_speed, dhi), CASE WHEN (d * 96 + q + plant_id) % 53 = 0 AND ghi > 0 THEN ghi + 640 ELSE ghi END AS ghi,
   CASE WHEN (d * 96 + q) % 71 = 0 THEN temp_air + 40 ELSE temp_air END AS temp_air, CASE WHEN (d * 96 + q) % 89 = 0 THEN 90 ELSE wind_speed END AS wind_speed,
   CASE WHEN (d * 96 + q) % 61 = 0 THEN dhi * 8 ELSE dhi END AS dhi, plant_id % 2 = 0 AS native FROM weather"""
SQL_TABLES["wq1"] = "SELECT *, " + ", ".join(
    f"CASE WHEN {c} BETWEEN {lo} AND {hi} THEN {c} END AS b_{c}" for c, (lo, hi) in
    {"ghi": (0, 1500), "dni": (0, 1500), "dhi": (0, 1200), "gti": (0, 1700), "temp_air": (-40, 65), "wind_speed": (0, 75), "rh": (0, 100), "pressure": (70000, 110000)}.items()
) + " FROM weather_raw"
SQL_TABLES["wq2"] = "SELECT * EXCLUDE (b_dhi), CASE WHEN NOT coalesce(b_dhi > b_ghi + 25, false) THEN b_dhi END AS b_dhi, " + " OR ".join(
    f"({c} IS NOT NULL AND b_{c} IS NULL)" for c in WX) + " OR coalesce(b_dhi > b_ghi + 25, false) AS bad0 FROM wq1"
SQL_TABLES["wq3"] = "SELECT *, coalesce(b_gti >= 50, false) AS daylight, " + ", ".join(
    f"CASE WHEN count(b_{c}) OVER w >= 4 THEN quantile_cont(b_{c}, 0.5) OVER w END AS m_{c}" for c in ("gti", "ghi", "dni", "dhi", "temp_air", "wind_speed")
) + " FROM wq2 WINDOW w AS (PARTITION BY plant_id ORDER BY ts_utc ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)"
SQL_TABLES["wq4"] = "SELECT *, " + ", ".join(
    f"CASE WHEN count(abs(b_{c} - m_{c})) OVER w >= 4 THEN quantile_cont(abs(b_{c} - m_{c}), 0.5) OVER w END AS a_{c}" for c in ("gti", "ghi", "dni", "dhi", "temp_air", "wind_speed")
) + " FROM wq3 WINDOW w AS (PARTITION BY plant_id ORDER BY ts_utc ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)"
SQL_TABLES["wq5"] = "SELECT *, " + ", ".join(
    f"coalesce(m_{c} IS NOT NULL AND a_{c} IS NOT NULL AND abs(b_{c} - m_{c}) > greatest(a_{c} * 1.4826 * {sg}, {fl}){day}, false) AS o_{c}"
    for c, sg, fl, day in [*[(c, 4.5, 80, " AND daylight") for c in ("gti", "ghi", "dni", "dhi")], ("temp_air", 4.0, 6, ""), ("wind_speed", 4.0, 6, "")]
) + " FROM wq4"
SQL_TABLES["wq6"] = "SELECT * EXCLUDE (ghi, dni, dhi, gti, temp_air, wind_speed, rh, pressure), " + ", ".join(
    f"CASE WHEN NOT o_{c} THEN b_{c} END AS {c}" for c in ("gti", "ghi", "dni", "dhi", "temp_air", "wind_speed")
) + ", b_rh AS rh, b_pressure AS pressure, bad0 OR " + " OR ".join(f"o_{c}" for c in ("gti", "ghi", "dni", "dhi", "temp_air", "wind_speed")) + " AS bad FROM wq5"
SQL_TABLES["wq7"] = """SELECT *, gti - lag(gti) OVER w AS d1 FROM wq6 WINDOW w AS (PARTITION BY plant_id ORDER BY ts_utc)"""
SQL_TABLES["wq8"] = """SELECT *, coalesce(gti >= 50 AND abs(d1 - lag(d1) OVER w) <= 0.5, false) AS ln FROM wq7 WINDOW w AS (PARTITION BY plant_id ORDER BY ts_utc)"""
SQL_TABLES["wq9"] = """SELECT *, ln AND coalesce(lag(ln) OVER w, false) AND coalesce(lead(ln) OVER w, false) AND NOT native AS art FROM wq8 WINDOW w AS (PARTITION BY plant_id ORDER BY ts_utc)"""
SQL_TABLES["weather_qc"] = """SELECT plant_id, ts_utc, ghi, dni, dhi, gti, temp_air, wind_speed, rh, pressure,
   greatest(least(1 - CASE WHEN bad THEN 0.55::DOUBLE ELSE 0 END - CASE WHEN art THEN 0.10::DOUBLE ELSE 0 END - CASE WHEN native THEN 0 ELSE 0.20::DOUBLE END
     - CASE WHEN coalesce(gti, ghi, dni, dhi, temp_air, wind_speed, rh, pressure) IS NULL THEN 0.35::DOUBLE ELSE 0 END, 1), 0) AS meteo_qc_score,
   NOT native AS flag_meteo_interpolated, bad AS flag_meteo_outlier, art AS flag_meteo_artifact FROM wq9"""


def weather_raw(t):
    d, q, p = F.col("d"), F.col("q"), F.col("plant_id")
    return t.weather.withColumns(
        {
            "ghi": F.when(((d * 96 + q + p) % 53 == 0) & (F.col("ghi") > 0), F.col("ghi") + 640).otherwise(F.col("ghi")),
            "temp_air": F.when((d * 96 + q) % 71 == 0, F.col("temp_air") + 40).otherwise(F.col("temp_air")),
            "wind_speed": F.when((d * 96 + q) % 89 == 0, 90.0).otherwise(F.col("wind_speed")),
            "dhi": F.when((d * 96 + q) % 61 == 0, F.col("dhi") * 8).otherwise(F.col("dhi")), "native": p % 2 == 0,
        }
    )


def checked_weather(t):
    return Q.weather_qc(weather_raw(t), S.Series(("plant_id",), "ts_utc"), native=F.col("native"))


@query("d01_weather_quality_control", "SELECT * EXCLUDE (meteo_qc_score), meteo_qc_score, meteo_qc_score < 0.75 AS flag_meteo_low_confidence FROM weather_qc", [*WX, "meteo_qc_score"])
def weather_qc(t):
    return checked_weather(t).drop("q", "d", "native")


@query("w04_hampel_outliers", "SELECT plant_id, count(*) FILTER (o_ghi) AS n_ghi, count(*) FILTER (o_temp_air) AS n_temp, sum(m_ghi) AS med_sum, sum(a_ghi) AS mad_sum FROM wq5 GROUP BY 1", ["med_sum", "mad_sum"])
def hampel(t):
    s = S.Series(("plant_id",), "ts_utc")
    b = S.blocks(Q.apply_bounds(weather_raw(t)), s, before=8, after=8).withColumn("_day", V.flag(F.col("gti") >= 50))
    steps, test = Q.hampel("ghi", s.blocked, 4.5, 80.0, 9, F.col("_day"))
    steps2, test2 = Q.hampel("temp_air", s.blocked, 4.0, 6.0, 9)
    for one in (steps, steps2):
        for n, e in one.items():
            b = b.withColumn(n, e)
    b = S.core(b.withColumns({"o1": test, "o2": test2}))
    return b.groupBy("plant_id").agg(F.count_if("o1").alias("n_ghi"), F.count_if("o2").alias("n_temp"), F.sum("_med_ghi").alias("med_sum"), F.sum("_mad_ghi").alias("mad_sum"))


@query("w05_interpolation_artifacts", "SELECT plant_id, count(*) FILTER (art) AS n_art FROM wq9 GROUP BY 1")
def artifacts(t):
    return checked_weather(t).groupBy("plant_id").agg(F.count_if("flag_meteo_artifact").alias("n_art"))


@query("a35_qc_summary",
       """SELECT plant_id, count(*) AS rows, count(*) FILTER (flag_meteo_outlier) AS flagged_outliers, count(*) FILTER (flag_meteo_artifact) AS flagged_artifacts,
          count(*) FILTER (meteo_qc_score < 0.75) AS flagged_low_confidence, avg(meteo_qc_score) AS qc_score_mean, min(meteo_qc_score) AS qc_score_min FROM weather_qc GROUP BY 1""", ["qc_score_mean", "qc_score_min"])
def qc_summary(t):
    return Q.qc_summary(checked_weather(t), P)


@query("a32_daily_qc", "SELECT plant_id, d AS day, avg(meteo_qc_score) AS qc_score_mean, min(meteo_qc_score) AS qc_score_min, bool_or(flag_meteo_outlier) AS flag_meteo_outlier FROM weather GROUP BY 1, 2", ["qc_score_mean", "qc_score_min"])
def daily_qc(t):
    return Q.qc_by_day(t.weather, P, F.col("d")).select("plant_id", "day", "qc_score_mean", "qc_score_min", "flag_meteo_outlier")


@query("x13_physical_bounds", "SELECT plant_id, ts_utc, b_ghi AS ghi, b_dhi AS dhi, b_wind_speed AS wind_speed, bad0 AS bad FROM wq2", ["ghi", "dhi", "wind_speed"])
def bounds(t):
    return Q.apply_bounds(weather_raw(t)).select("plant_id", "ts_utc", "ghi", "dhi", "wind_speed", F.col("_bad").alias("bad"))


STAB = """SELECT *, CASE WHEN count(g_poa) OVER w6 >= 3 AND abs(avg(g_poa) OVER w6) >= 1e-9 THEN stddev_pop(g_poa) OVER w6 / abs(avg(g_poa) OVER w6) END AS gpoa_cv,
   CASE WHEN row_number() OVER w = 1 THEN CASE WHEN g_poa IS NOT NULL THEN 0.0::DOUBLE END ELSE abs(g_poa - lag(g_poa) OVER w) END AS gpoa_ramp FROM bin_state
   WINDOW w AS (PARTITION BY plant_id ORDER BY ts_15), w6 AS (PARTITION BY plant_id ORDER BY ts_15 ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"""
SQL_TABLES["stab"] = STAB
SQL_TABLES["fuse0"] = """SELECT *, coalesce(gpoa_cv <= 0.08, false) AS stable_sky, coalesce(gpoa_cv <= 0.08 AND gpoa_ramp <= 120, false) AS meteo_quality_ok,
   CASE WHEN mismatch_rel IS NULL THEN 0 ELSE 0.45::DOUBLE * coalesce(c_p_ac, 1) END AS w1, CASE WHEN r_p_dc IS NULL THEN 0 ELSE 0.20::DOUBLE * coalesce(c_p_dc, 0.75) END AS w2,
   CASE WHEN r_v_dc IS NULL THEN 0 ELSE 0.15::DOUBLE * coalesce(c_v_dc, 0.75) END AS w3, CASE WHEN r_i_dc IS NULL THEN 0 ELSE 0.20::DOUBLE * coalesce(c_i_dc, 0.75) END AS w4 FROM stab"""
SQL_TABLES["fuse"] = """SELECT *, CASE WHEN valid_model AND w1 + w2 + w3 + w4 > 0 THEN CASE WHEN (w1 + w2 + w3 + w4) < 0.2 AND mismatch_rel IS NOT NULL THEN mismatch_rel ELSE
   (w1 * coalesce(mismatch_rel, 0) + w2 * coalesce(r_p_dc, 0) + w3 * coalesce(r_v_dc, 0) + w4 * coalesce(r_i_dc, 0)) / (w1 + w2 + w3 + w4) END END AS signal,
   CASE WHEN valid_model AND w1 + w2 + w3 + w4 > 0 THEN w1 + w2 + w3 + w4 ELSE 0 END AS signal_support,
   CASE WHEN valid_model AND w1 + w2 + w3 + w4 > 0 THEN (w1 + w2 + w3 + w4) / (CASE WHEN mismatch_rel IS NULL THEN 0 ELSE 0.45 END + CASE WHEN r_p_dc IS NULL THEN 0 ELSE 0.2 END + CASE WHEN r_v_dc IS NULL THEN 0 ELSE 0.15 END + CASE WHEN r_i_dc IS NULL THEN 0 ELSE 0.2 END) END AS signal_confidence FROM fuse0"""
SQL_TABLES["periods0"] = """SELECT *, NOT flag_meteo_missing AND NOT flag_inv_missing AND coalesce(inv_coverage >= 0.3, false) AND coalesce(g_poa >= 180, false) AS valid_period FROM fuse"""
SQL_TABLES["periods"] = """SELECT *, valid_period AND valid_model AND signal IS NOT NULL AND coalesce(g_poa >= 320, false) AS coarse_period,
   valid_period AND valid_model AND signal IS NOT NULL AND coalesce(g_poa >= 320, false) AND meteo_quality_ok AS residual_ready,
   valid_period AND valid_model AND signal IS NOT NULL AND coalesce(g_poa >= 500, false) AND meteo_quality_ok AND NOT flag_meteo_low_confidence AND NOT flag_meteo_interpolated AS fine_period,
   CASE WHEN g_poa >= 500 THEN 'A' WHEN g_poa >= 320 THEN 'B' WHEN g_poa IS NOT NULL THEN 'C' ELSE 'N' END AS irradiance_tier FROM periods0"""
SQL_TABLES["nready"] = "SELECT plant_id, count(*) FILTER (residual_ready) AS n_ready FROM periods GROUP BY 1"
SQL_TABLES["based"] = "SELECT p.*, CASE WHEN n_ready >= 24 THEN residual_ready ELSE coarse_period END AS base FROM periods p JOIN nready USING (plant_id)"
SQL_TABLES["med1"] = "SELECT plant_id, " + ", ".join(
    f"quantile_cont(signal, 0.5) FILTER (base{c}) AS m_{n}, stddev_pop(signal) FILTER (base{c}) AS s_{n}, count(signal) FILTER (base{c}) AS n_{n}"
    for n, c in (("a", ""), ("c", " AND g_poa < 500"), ("f", " AND g_poa >= 500"))) + " FROM based GROUP BY 1"
SQL_TABLES["med2"] = "SELECT b.plant_id, " + ", ".join(
    f"quantile_cont(abs(signal - m_{n}), 0.5) FILTER (base{c}) AS d_{n}" for n, c in (("a", ""), ("c", " AND g_poa < 500"), ("f", " AND g_poa >= 500"))
) + " FROM based b JOIN med1 USING (plant_id) GROUP BY 1"
SQL_TABLES["scales"] = "SELECT plant_id, n_a, n_c, n_f, " + ", ".join(
    f"coalesce(m_{n}, 0) AS m_{n}, CASE WHEN n_{n} > 0 THEN greatest(CASE WHEN d_{n} * 1.4826 >= 1e-6 THEN d_{n} * 1.4826 WHEN s_{n} >= 1e-6 THEN s_{n} ELSE 1 END, 0.08) ELSE 1.0 END AS g_{n}" for n in "acf"
) + " FROM med1 JOIN med2 USING (plant_id)"
SQL_TABLES["zs0"] = """SELECT b.*, CASE WHEN g_poa >= 500 AND n_f >= 12 THEN m_f WHEN g_poa IS NOT NULL AND n_c >= 12 THEN m_c ELSE m_a END AS ctx_median,
   CASE WHEN g_poa >= 500 AND n_f >= 12 THEN g_f WHEN g_poa IS NOT NULL AND n_c >= 12 THEN g_c ELSE g_a END AS ctx_sigma FROM based b JOIN scales USING (plant_id)"""
SQL_TABLES["zs"] = """SELECT *, (signal - ctx_median) / greatest(ctx_sigma * (1 + greatest(0, 1 - coalesce(signal_confidence, 0.75)) + CASE WHEN flag_meteo_low_confidence THEN 0.25 ELSE 0 END
   + CASE WHEN flag_meteo_interpolated THEN 0.15 ELSE 0 END), 0.08) AS z FROM zs0"""


def channels():
    c = F.col
    return {"p_ac": (c("mismatch_rel"), c("c_p_ac")), "p_dc": (c("r_p_dc"), c("c_p_dc")), "v_dc": (c("r_v_dc"), c("c_v_dc")), "i_dc": (c("r_i_dc"), c("c_i_dc"))}


def detected(t):
    return D.detect_anomalies(t.bin_state, SER, channels())


@query("w01_trailing_irradiance_cv", "SELECT plant_id, ts_15, gpoa_cv FROM stab", ["gpoa_cv"])
def cv(t):
    return D.sky_state(t.bin_state, SER).select("plant_id", "ts_15", "gpoa_cv")


@query("w02_irradiance_ramp", "SELECT plant_id, ts_15, gpoa_ramp FROM stab", ["gpoa_ramp"])
def ramp(t):
    return D.sky_state(t.bin_state, SER).select("plant_id", "ts_15", "gpoa_ramp")


@query("w03_hourly_irradiance_stability",
       """SELECT plant_id, ts_15, CASE WHEN n >= 4 THEN m END AS g_mean_60m, CASE WHEN n >= 4 THEN s END AS g_std_60m, CASE WHEN n >= 4 THEN s / greatest(m, 50) END AS g_cv_60m FROM
          (SELECT plant_id, ts_15, row_number() OVER (PARTITION BY plant_id ORDER BY ts_15) AS n, avg(g_poa) OVER w AS m, stddev_pop(g_poa) OVER w AS s FROM bin_state
           WINDOW w AS (PARTITION BY plant_id ORDER BY ts_15 ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))""", ["g_mean_60m", "g_std_60m", "g_cv_60m"])
def stability(t):
    b = S.blocks(t.bin_state, SER, before=4)
    return S.core(b.withColumns(D.hour_stability("g_poa", SER.blocked))).select("plant_id", "ts_15", "g_mean_60m", "g_std_60m", "g_cv_60m")


@query("d08_fused_signal", "SELECT plant_id, ts_15, signal, signal_support, signal_confidence FROM fuse", ["signal", "signal_support", "signal_confidence"])
def fused(t):
    cfg = DetectConfig()
    s, sup, conf = R.fused_signal(F.col("mismatch_rel"), channels(), F.col("valid_model"), dict(cfg.weights), 1.0, 0.75, cfg.min_support)
    return t.bin_state.select("plant_id", "ts_15", s.alias("signal"), sup.alias("signal_support"), conf.alias("signal_confidence"))


GATE = "valid_model AND coalesce(g_poa >= 150, false) AND coalesce(p_ac_w >= 100, false) AND NOT flag_meteo_missing AND NOT flag_inv_missing"


@query("f11_base_gate",
       f"""SELECT plant_id, ts_15, {GATE} AS base_gate, coalesce(nullif(concat_ws(';', CASE WHEN NOT valid_model THEN 'invalid_model' END, CASE WHEN NOT coalesce(g_poa >= 150, false) THEN 'low_gpoa' END,
          CASE WHEN NOT coalesce(p_ac_w >= 100, false) THEN 'low_pac' END, CASE WHEN flag_meteo_missing THEN 'meteo_missing' END, CASE WHEN flag_inv_missing THEN 'inv_missing' END), ''), 'ok') AS gate_reason FROM bin_state""")
def gate(t):
    c = F.col
    ok, why = D.base_gate(c("g_poa"), c("p_ac_w"), c("valid_model"), c("flag_meteo_missing"), c("flag_inv_missing"), 150.0, 100.0)
    return t.bin_state.select("plant_id", "ts_15", ok.alias("base_gate"), why.alias("gate_reason"))


@query("f12_plot_mismatch", """SELECT plant_id, ts_15, CASE WHEN mismatch_rel IS NOT NULL AND g_poa >= 200 AND abs(pac_model_w) >= 150 AND p_ac_w IS NOT NULL AND NOT (flag_meteo_missing OR flag_inv_missing)
   THEN greatest(least(mismatch_rel, 1.0), -1.0) END AS mismatch_plot FROM bin_state""", ["mismatch_plot"])
def plot(t):
    c = F.col
    v = D.plot_mismatch(c("mismatch_rel"), c("g_poa"), c("pac_model_w"), c("p_ac_w"), c("flag_meteo_missing") | c("flag_inv_missing"), 200.0, 150.0, 1.0)
    return t.bin_state.select("plant_id", "ts_15", v.alias("mismatch_plot"))


@query("d09_combined_signal",
       f"""SELECT plant_id, ts_15, CASE WHEN {GATE} THEN (0.40::DOUBLE * coalesce(mismatch_rel, 0) + 0.25::DOUBLE * coalesce(r_p_dc * coalesce(c_p_dc, 1), 0) + 0.15::DOUBLE * coalesce(r_v_dc * coalesce(c_v_dc, 1), 0) + 0.20::DOUBLE * coalesce(r_i_dc * coalesce(c_i_dc, 1), 0))
          / (CASE WHEN mismatch_rel IS NULL THEN 0 ELSE 0.40::DOUBLE END + CASE WHEN r_p_dc IS NULL THEN 0 ELSE 0.25::DOUBLE * coalesce(c_p_dc, 1) END + CASE WHEN r_v_dc IS NULL THEN 0 ELSE 0.15::DOUBLE * coalesce(c_v_dc, 1) END + CASE WHEN r_i_dc IS NULL THEN 0 ELSE 0.20::DOUBLE * coalesce(c_i_dc, 1) END) END AS signal FROM bin_state""", ["signal"])
def combined(t):
    c = F.col
    ok, _ = D.base_gate(c("g_poa"), c("p_ac_w"), c("valid_model"), c("flag_meteo_missing"), c("flag_inv_missing"), 150.0, 100.0)
    return t.bin_state.select("plant_id", "ts_15", R.combined_signal(c("mismatch_rel"), channels(), ok).alias("signal"))


@query("d10_residual_event_score",
       f"""WITH s AS (SELECT plant_id, ts_15, {GATE} AS gate, mismatch_rel, CASE WHEN (r_p_dc IS NOT NULL AND c_p_dc IS NOT NULL) OR (r_v_dc IS NOT NULL AND c_v_dc IS NOT NULL) OR (r_i_dc IS NOT NULL AND c_i_dc IS NOT NULL) THEN
            (CASE WHEN r_p_dc IS NULL OR c_p_dc IS NULL THEN 0 ELSE 0.40::DOUBLE * least(abs(r_p_dc), 2) / 2 * c_p_dc END + CASE WHEN r_v_dc IS NULL OR c_v_dc IS NULL THEN 0 ELSE 0.25::DOUBLE * least(abs(r_v_dc), 2) / 2 * least(c_v_dc, 1) END + CASE WHEN r_i_dc IS NULL OR c_i_dc IS NULL THEN 0 ELSE 0.35::DOUBLE * least(abs(r_i_dc), 2) / 2 * c_i_dc END)
            / (CASE WHEN r_p_dc IS NULL OR c_p_dc IS NULL THEN 0 ELSE 0.40::DOUBLE END + CASE WHEN r_v_dc IS NULL OR c_v_dc IS NULL THEN 0 ELSE 0.25::DOUBLE END + CASE WHEN r_i_dc IS NULL OR c_i_dc IS NULL THEN 0 ELSE 0.35::DOUBLE END) END AS score FROM bin_state)
       SELECT plant_id, ts_15, score, coalesce(score >= 0.45, false) AS trigger, CASE WHEN gate THEN CASE WHEN score IS NULL THEN least(coalesce(abs(mismatch_rel), 0), 2) / 2 ELSE 0.6 * least(coalesce(abs(mismatch_rel), 0), 2) / 2 + 0.4 * score END END AS combined FROM s""", ["score", "combined"])
def event_score(t):
    c = F.col
    ok, _ = D.base_gate(c("g_poa"), c("p_ac_w"), c("valid_model"), c("flag_meteo_missing"), c("flag_inv_missing"), 150.0, 100.0)
    score, trig = R.residual_event_score(channels())
    return t.bin_state.select("plant_id", "ts_15", score.alias("score"), trig.alias("trigger"), R.combined_event_score(c("mismatch_rel"), score, ok).alias("combined"))


@query("w08_contextual_baseline", "SELECT plant_id, ts_15, ctx_median, ctx_sigma FROM zs", ["ctx_median", "ctx_sigma"])
def contextual(t):
    return detected(t).select("plant_id", "ts_15", "ctx_median", "ctx_sigma")


RECURSE = """WITH RECURSIVE r AS MATERIALIZED (SELECT plant_id, ts_15, z, row_number() OVER (PARTITION BY plant_id ORDER BY ts_15) AS i FROM zs WHERE residual_ready AND z IS NOT NULL),
  a AS MATERIALIZED (SELECT plant_id, ts_15, CASE WHEN residual_ready THEN z END AS z, row_number() OVER (PARTITION BY plant_id ORDER BY ts_15) AS i FROM zs),
  ew(plant_id, i, e) AS (SELECT plant_id, i, z FROM r WHERE i = 1 UNION ALL SELECT r.plant_id, r.i, 0.2::DOUBLE * r.z + 0.8::DOUBLE * ew.e FROM ew JOIN r ON r.plant_id = ew.plant_id AND r.i = ew.i + 1),
  cu(plant_id, i, sp, sn) AS (SELECT plant_id, 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE FROM (SELECT DISTINCT plant_id FROM a)
    UNION ALL SELECT a.plant_id, a.i, CASE WHEN a.z IS NULL THEN 0 ELSE greatest(0, sp + a.z - 0.5) END, CASE WHEN a.z IS NULL THEN 0 ELSE greatest(0, sn - a.z - 0.5) END FROM cu JOIN a ON a.plant_id = cu.plant_id AND a.i = cu.i + 1) """


@query("w06_ewma_control", RECURSE + "SELECT r.plant_id, r.ts_15, e AS ewma_z FROM ew JOIN r USING (plant_id, i)", ["ewma_z"], recursive=True)
def ewma(t):
    return detected(t).filter("ewma_z IS NOT NULL").select("plant_id", "ts_15", "ewma_z")


@query("w07_two_sided_cusum", RECURSE + "SELECT a.plant_id, a.ts_15, greatest(sp, sn) AS cusum_score FROM cu JOIN a USING (plant_id, i) WHERE z IS NOT NULL", ["cusum_score"], recursive=True)
def cusum(t):
    return detected(t).filter("cusum_score IS NOT NULL").select("plant_id", "ts_15", "cusum_score")


SQL_DETECTED = RECURSE + """SELECT zs.plant_id, zs.ts_15, stable_sky, meteo_quality_ok, valid_period, coarse_period, fine_period, irradiance_tier, signal, zs.z,
   coalesce(abs(e) > 1.0, false) OR coalesce(residual_ready AND greatest(sp, sn) > 8, false) AS anomaly FROM zs JOIN a ON a.plant_id = zs.plant_id AND a.ts_15 = zs.ts_15
   JOIN cu ON cu.plant_id = a.plant_id AND cu.i = a.i LEFT JOIN (SELECT r.plant_id, r.ts_15, e FROM ew JOIN r USING (plant_id, i)) x ON x.plant_id = zs.plant_id AND x.ts_15 = zs.ts_15"""


@query("d11_detect_anomalies", SQL_DETECTED, ["signal", "z"], recursive=True)
def detect(t):
    return detected(t).select("plant_id", "ts_15", "stable_sky", "meteo_quality_ok", "valid_period", "coarse_period", "fine_period", "irradiance_tier", "signal", "z", "anomaly")


@query("x15_irradiance_tier", "SELECT plant_id, irradiance_tier, count(*) AS n FROM periods GROUP BY 1, 2")
def tiers(t):
    return t.bin_state.groupBy("plant_id", V.irradiance_tier(F.col("g_poa"), 320.0, 500.0).alias("irradiance_tier")).agg(F.count(F.lit(1)).alias("n"))


@query("x16_relative_residual", "SELECT plant_id, ts_15, p_ac_w - pac_model_w AS abs, (p_ac_w - pac_model_w) / greatest(abs(pac_model_w), 50) AS rel, CASE WHEN p_ac_w IS NOT NULL THEN greatest(least((p_ac_w - pac_model_w) / greatest(abs(pac_model_w), 50), 2), -2) END AS norm FROM bin_state", ["abs", "rel", "norm"])
def residual(t):
    rel = V.residual_rel(F.col("p_ac_w"), F.col("pac_model_w"))
    return t.bin_state.select("plant_id", "ts_15", V.residual_abs(F.col("p_ac_w"), F.col("pac_model_w")).alias("abs"), rel.alias("rel"), V.clip_abs(rel, 2.0).alias("norm"))


D07_SQL = """WITH e AS (SELECT *, pac_model_w AS xa, pac_model_w * 1.0625::DOUBLE AS xd, 320.0::DOUBLE AS xv, CASE WHEN q % 9 <> 0 THEN pac_model_w / 256 END AS xi FROM bin_state),
  s AS (SELECT *, CASE WHEN flag_inv_missing OR flag_meteo_missing THEN 'insufficient_input' WHEN gti IS NULL OR gti < 50 THEN 'low_irradiance' END AS st,
   0.35::DOUBLE * (greatest(least(meteo_qc_score, 1), 0) * CASE WHEN flag_meteo_interpolated THEN 0.9::DOUBLE ELSE 1 END * CASE WHEN flag_meteo_outlier OR flag_meteo_artifact THEN 0.7::DOUBLE ELSE 1 END) AS m,
   0.20::DOUBLE * CASE WHEN inv_coverage IS NULL THEN CASE WHEN flag_inv_missing THEN 0 ELSE 0.7 END ELSE inv_coverage END AS cv,
   0.25::DOUBLE * CASE WHEN temp_air IS NULL THEN 0.7::DOUBLE ELSE 1 END AS inp, 0.20::DOUBLE * CASE WHEN gti >= 800 THEN 1 WHEN gti >= 700 THEN 0.85::DOUBLE WHEN gti >= 150 THEN 0.7::DOUBLE WHEN gti >= 50 THEN 0.5::DOUBLE ELSE 0 END AS ir FROM e),
  k AS (SELECT *, CASE WHEN NOT valid_model THEN 'model_unavailable' ELSE coalesce(st, 'valid') END AS s_ac, CASE WHEN NOT valid_model THEN 'model_unavailable' ELSE coalesce(st, CASE WHEN gti < 150 THEN 'low_irradiance' END, 'valid') END AS s_v,
   CASE WHEN NOT valid_model OR xi IS NULL THEN 'model_unavailable' ELSE coalesce(st, 'valid') END AS s_i FROM s),
  c AS (SELECT *, CASE WHEN s_ac = 'valid' THEN m + cv + inp + ir ELSE 0 END AS ca, CASE WHEN s_v = 'valid' THEN m + cv + inp + ir ELSE 0 END AS cvv, CASE WHEN s_i = 'valid' THEN m + cv + inp + ir ELSE 0 END AS ci FROM k)
  SELECT plant_id, ts_15, s_ac AS p_ac_status, s_v AS v_dc_status, s_i AS i_dc_status, CASE WHEN s_ac = 'valid' THEN greatest(least((p_ac_w - xa) / greatest(abs(xa), 50), 2), -2) END AS p_ac_norm,
   CASE WHEN s_v = 'valid' THEN greatest(least((v_dc_v - xv) / 320, 2), -2) END AS v_dc_norm, CASE WHEN s_i = 'valid' THEN greatest(least((i_dc_a - xi) / greatest(abs(xi), 0.25), 2), -2) END AS i_dc_norm,
   (ca + ca + cvv + ci) / 4 AS bundle_confidence FROM c"""


@query("d07_residual_channels", D07_SQL, ["p_ac_norm", "v_dc_norm", "i_dc_norm", "bundle_confidence"])
def residual_channels(t):
    m = F.col("pac_model_w")
    b = t.bin_state.drop("r_p_dc", "r_v_dc", "r_i_dc").withColumns(
        {"p_ac_exp_w": m, "p_dc_exp_w": m * 1.0625, "v_dc_exp_v": F.lit(320.0), "i_dc_exp_a": F.when(F.col("q") % 9 != 0, m / 256), "model_valid": F.col("valid_model")})
    r = R.residual_channels(b)
    return r.select("plant_id", "ts_15", *[F.col(f"r_{n}.status").alias(f"{n}_status") for n in ("p_ac", "v_dc", "i_dc")],
                    *[F.col(f"r_{n}.norm").alias(f"{n}_norm") for n in ("p_ac", "v_dc", "i_dc")], "bundle_confidence")


@query("x26_effective_irradiance", """SELECT plant_id, ts_15, CASE WHEN plant_id % 2 = 0 THEN coalesce(gti, CASE WHEN plant_id % 4 = 0 THEN ghi * 1.25 END) ELSE ghi END AS g_poa FROM merged""", ["g_poa"])
def effective(t):
    p = F.col("plant_id")
    m = t.merged.withColumns({"gti": F.when(p % 2 == 0, F.col("gti")), "g_poa_transposed": F.when(p % 4 == 0, F.col("ghi") * 1.25)})
    return R.effective_poa(m, P).select("plant_id", "ts_15", "g_poa")


LEGACY = """CASE WHEN NOT coalesce(g_poa >= 180, false) OR NOT valid_model OR mismatch_rel IS NULL THEN 'invalid' WHEN abs(mismatch_rel) < 0.4 THEN 'normal' WHEN mismatch_rel >= 0.25 THEN 'meteo_error'
  WHEN mismatch_rel <= -0.9 THEN 'string_disconnected' ELSE 'degradation' END"""


def legacy(t):
    return t.bin_state.withColumn("label", D.legacy_label(F.col("mismatch_rel"), F.col("g_poa"), F.col("valid_model")))


@query("d13_legacy_classes", f"SELECT plant_id, ts_15, {LEGACY} AS label FROM bin_state")
def legacy_classes(t):
    return legacy(t).select("plant_id", "ts_15", "label")


@query("a18_counts_by_label", f"SELECT plant_id, {LEGACY} AS label, count(*) AS n FROM bin_state GROUP BY 1, 2")
def label_counts(t):
    return legacy(t).groupBy("plant_id", "label").agg(F.count(F.lit(1)).alias("n"))


@query("w10_merged_mismatch_events",
       f"""WITH l AS (SELECT plant_id, ts_15, mismatch_rel, {LEGACY} AS label FROM bin_state), a AS (SELECT *, label NOT IN ('invalid', 'normal') AS abn FROM l),
       r AS (SELECT *, lag(abn) OVER w AS pa, max(CASE WHEN abn THEN ts_15 END) OVER (PARTITION BY plant_id ORDER BY ts_15 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lt FROM a WINDOW w AS (PARTITION BY plant_id ORDER BY ts_15)),
       i AS (SELECT *, sum(CASE WHEN abn AND NOT coalesce(pa, false) AND (lt IS NULL OR ts_15 - lt > INTERVAL 30 MINUTE) THEN 1 ELSE 0 END) OVER (PARTITION BY plant_id ORDER BY ts_15) AS isl FROM r),
       m AS (SELECT plant_id, isl, label, count(*) AS n FROM i WHERE abn GROUP BY 1, 2, 3), d AS (SELECT plant_id, isl, arg_min(label, (-n, label)) AS dominant_label FROM m GROUP BY 1, 2)
       SELECT i.plant_id, min(ts_15) AS start_utc, max(ts_15) AS end_utc, count(*) AS n_points, max(abs(mismatch_rel)) AS max_abs_mismatch, avg(abs(mismatch_rel)) AS mean_abs_mismatch, any_value(d.dominant_label) AS dominant_label
       FROM i JOIN d ON d.plant_id = i.plant_id AND d.isl = i.isl WHERE abn GROUP BY i.plant_id, i.isl""", ["max_abs_mismatch", "mean_abs_mismatch"])
def merged_events(t):
    return D.legacy_events(legacy(t), SER).drop("dominant_code")


@query("w12_hysteresis",
       f"""WITH l AS (SELECT plant_id, ts_15, CASE {LEGACY} WHEN 'invalid' THEN -1 WHEN 'normal' THEN 0 WHEN 'degradation' THEN 2 ELSE 3 END AS code FROM bin_state),
       g AS (SELECT *, row_number() OVER (PARTITION BY plant_id ORDER BY ts_15) - row_number() OVER (PARTITION BY plant_id, code ORDER BY ts_15) AS r FROM l)
       SELECT plant_id, ts_15, CASE WHEN code > 0 AND count(*) OVER (PARTITION BY plant_id, code, r) < 4 THEN 0 ELSE code END AS code_stable FROM g""", longs=["code_stable"])
def hysteresis(t):
    code = V.lookup(F.col("label"), {"invalid": -1, "normal": 0, "degradation": 2}, F.lit(3))
    return D.persistent_faults(legacy(t).withColumn("code", code), SER).select("plant_id", "ts_15", "code_stable")


MED = ", ".join(f"quantile_cont({c}, 0.5) FILTER (coarse_period AND inv_coverage >= 0.3 AND NOT flag_inv_missing AND NOT flag_meteo_missing AND {{an}}) AS {{p}}_{c}" for c in ("v_dc_v", "i_dc_a", "v_ac_v", "freq_hz"))
D12_SQL = f"""WITH f AS (SELECT *, eid % 5 = 0 AS anomaly, CASE WHEN plant_id % 2 = 0 THEN v_ac_v + CASE WHEN eid % 37 = 0 THEN 40 WHEN eid % 41 = 0 THEN -40 ELSE 0 END ELSE v_ac_v END AS vac,
    CASE WHEN eid % 7 = 0 THEN 5.0::DOUBLE ELSE p_ac_w END AS pac, CASE WHEN eid % 6 = 0 THEN -0.5::DOUBLE WHEN eid % 6 = 1 THEN -0.25::DOUBLE ELSE r_v_dc END AS rv, CASE WHEN eid % 4 = 0 THEN -0.9::DOUBLE WHEN eid % 4 = 1 THEN -0.3::DOUBLE WHEN eid % 4 = 2 THEN -0.13::DOUBLE END AS ri FROM periods),
  n AS (SELECT plant_id, count(*) FILTER (coarse_period AND NOT coalesce(anomaly, false)) AS nc, quantile_cont(pac, 0.99) AS cap, {MED.format(an='NOT coalesce(anomaly, false)', p='c').replace('quantile_cont(v_ac_v', 'quantile_cont(vac')}, {MED.format(an='true', p='s').replace('quantile_cont(v_ac_v', 'quantile_cont(vac')} FROM f GROUP BY 1),
  b AS (SELECT f.*, cap, CASE WHEN nc < 24 THEN s_v_dc_v ELSE c_v_dc_v END AS mv, CASE WHEN nc < 24 THEN s_i_dc_a ELSE c_i_dc_a END AS mi, CASE WHEN nc < 24 THEN s_v_ac_v ELSE c_v_ac_v END AS ma, CASE WHEN nc < 24 THEN s_freq_hz ELSE c_freq_hz END AS mf FROM f JOIN n USING (plant_id)),
  e AS (SELECT *, coalesce(anomaly, false) AS an, flag_inv_missing OR flag_meteo_missing OR NOT coalesce(inv_coverage >= 0.3, false) AS bad, coalesce(g_poa >= 180, false) AS sun, coalesce(pac <= greatest(15, 0.02 * greatest(pac_model_w, 0)), false) AS zero,
    coalesce(pac_model_w >= 150 AND pac < 0.75 * pac_model_w, false) AS deg, coalesce(pac_model_w >= 150 AND pac < 0.35 * pac_model_w, false) AS sev,
    coalesce(ma > 0 AND vac < least(ma * 0.9, ma - 10), false) AS vl, coalesce(ma > 0 AND vac > greatest(ma * 1.1, ma + 10), false) AS vh, coalesce(mf > 0 AND freq_hz < mf - 1, false) AS fl, coalesce(mf > 0 AND freq_hz > mf + 1, false) AS fh,
    coalesce(pac >= 0.98 * cap AND pac_model_w > pac * 1.02, false) AS clip, CASE WHEN mi > 1e-6 THEN i_dc_a / mi END AS ir, CASE WHEN abs(mv) > 1e-6 THEN v_dc_v / mv END AS vr,
    coalesce(ri <= -0.85 AND (rv IS NULL OR rv >= -0.2), false) AS dopen, coalesce(rv <= -0.45 AND mismatch_rel <= -0.7, false) AS dshort, coalesce(ri <= -0.25 AND (rv IS NULL OR abs(rv) <= 0.18), false) AS dsh,
    coalesce(ri <= -0.12 AND mismatch_rel <= -0.15, false) AS ddeg, coalesce(rv <= -0.18 AND (ri IS NULL OR ri > -0.25), false) AS dmp, meteo_quality_ok AS mq, irradiance_tier AS t FROM b),
  k AS (SELECT *, NOT bad AND valid_period AND (vl OR vh OR fl OR fh) AS ge FROM e),
  o AS (SELECT *, CASE WHEN bad OR NOT valid_period THEN 'invalid' WHEN clip THEN 'curtailment_clipping'
    WHEN ge AND sun AND (zero OR deg OR an) THEN CASE WHEN vh THEN CASE WHEN zero THEN 'grid_overvoltage_trip' ELSE 'grid_overvoltage_derating' END WHEN vl THEN CASE WHEN zero THEN 'grid_undervoltage_trip' ELSE 'grid_undervoltage_derating' END WHEN fh THEN 'grid_overfrequency_trip' ELSE 'grid_underfrequency_trip' END
    WHEN zero AND dopen THEN 'dc_open_circuit_probable' WHEN zero AND dshort THEN 'dc_short_circuit_probable' WHEN zero AND (alarm_code IS NOT NULL OR coalesce(alarm_sev >= 2, false)) THEN 'inverter_off_under_sun' WHEN zero THEN 'unknown_shutdown_with_sun'
    WHEN deg AND dshort THEN 'dc_short_circuit_probable' WHEN deg AND dopen AND sev THEN 'dc_partial_open_circuit_probable' WHEN deg AND dsh THEN 'dc_shading_soiling_probable' WHEN deg AND ddeg THEN 'dc_degradation_probable' WHEN deg AND dmp THEN 'dc_mppt_tracking_anomaly_probable'
    WHEN deg AND t = 'A' AND fine_period AND coalesce(ir <= 0.35, false) THEN 'dc_side_partial_loss_probable' WHEN deg AND t = 'A' AND fine_period AND coalesce(vr <= 0.8, false) THEN 'dc_side_voltage_anomaly_probable'
    WHEN deg AND t IN ('A', 'B') THEN 'partial_generation_loss_probable' WHEN deg THEN 'persistent_underperformance' WHEN an AND t IN ('A', 'B') THEN 'persistent_underperformance' ELSE 'ok' END AS diagnosis_label FROM k)
  SELECT plant_id, ts_15, CASE WHEN bad THEN 'telemetry_invalid' WHEN NOT sun THEN 'low_irradiance' WHEN zero THEN 'sun_available_not_injecting' WHEN deg THEN 'injecting_degraded' ELSE 'injecting_normal' END AS state_label, diagnosis_label, ge AS grid_evidence, zero AS zero_injection,
    CASE WHEN diagnosis_label = 'invalid' THEN 0 WHEN clip THEN 0.55 + CASE WHEN mq THEN 0.1 ELSE 0 END + CASE WHEN t IN ('A', 'B') THEN 0.1 ELSE 0 END
    WHEN starts_with(diagnosis_label, 'grid_') THEN 0.9 + CASE WHEN zero OR sev THEN 0.05 ELSE 0 END + CASE WHEN alarm_code IS NOT NULL THEN 0.05 ELSE 0 END
    WHEN diagnosis_label = 'dc_open_circuit_probable' THEN 0.32 + CASE WHEN mq THEN 0.18 ELSE 0 END + CASE WHEN c_i_dc >= 0.6 THEN 0.12 ELSE 0.04 END + CASE WHEN t = 'A' THEN 0.08 ELSE 0.03 END
    WHEN diagnosis_label = 'dc_short_circuit_probable' AND zero THEN 0.32 + CASE WHEN mq THEN 0.18 ELSE 0 END + CASE WHEN c_v_dc >= 0.6 THEN 0.12 ELSE 0.04 END + CASE WHEN t = 'A' THEN 0.08 ELSE 0.03 END
    WHEN diagnosis_label = 'inverter_off_under_sun' THEN 0.65 + CASE WHEN t IN ('A', 'B') THEN 0.1 ELSE 0 END + CASE WHEN mq THEN 0.1 ELSE 0 END
    WHEN diagnosis_label = 'unknown_shutdown_with_sun' THEN 0.2 + CASE WHEN t IN ('A', 'B') THEN 0.1 ELSE 0 END + CASE WHEN mq THEN 0.1 ELSE 0 END
    WHEN diagnosis_label = 'dc_short_circuit_probable' THEN 0.28 + CASE WHEN mq THEN 0.16 ELSE 0 END + CASE WHEN c_v_dc >= 0.6 THEN 0.12 ELSE 0.05 END + CASE WHEN t IN ('A', 'B') THEN 0.06 ELSE 0.02 END
    WHEN diagnosis_label = 'dc_partial_open_circuit_probable' THEN 0.26 + CASE WHEN mq THEN 0.16 ELSE 0 END + CASE WHEN c_i_dc >= 0.6 THEN 0.12 ELSE 0.05 END + CASE WHEN t IN ('A', 'B') THEN 0.06 ELSE 0.02 END
    WHEN diagnosis_label = 'dc_shading_soiling_probable' THEN 0.24 + CASE WHEN mq THEN 0.14 ELSE 0 END + CASE WHEN c_i_dc >= 0.6 THEN 0.08 ELSE 0.03 END + CASE WHEN t IN ('A', 'B') THEN 0.06 ELSE 0.02 END
    WHEN diagnosis_label = 'dc_degradation_probable' THEN 0.2 + CASE WHEN mq THEN 0.12 ELSE 0 END + CASE WHEN c_i_dc >= 0.6 THEN 0.08 ELSE 0.03 END + CASE WHEN fine_period THEN 0.05 ELSE 0 END
    WHEN diagnosis_label = 'dc_mppt_tracking_anomaly_probable' THEN 0.22 + CASE WHEN mq THEN 0.1 ELSE 0 END + CASE WHEN c_v_dc >= 0.6 THEN 0.1 ELSE 0.03 END + CASE WHEN fine_period THEN 0.05 ELSE 0 END
    WHEN diagnosis_label = 'dc_side_partial_loss_probable' THEN 0.55 + CASE WHEN ir <= 0.15 THEN 0.15 ELSE 0.05 END + CASE WHEN mq THEN 0.15 ELSE 0 END
    WHEN diagnosis_label = 'dc_side_voltage_anomaly_probable' THEN 0.45 + CASE WHEN vr <= 0.6 THEN 0.15 ELSE 0.05 END + CASE WHEN mq THEN 0.15 ELSE 0 END
    WHEN diagnosis_label = 'partial_generation_loss_probable' THEN 0.2 + CASE WHEN t = 'A' THEN 0.1 ELSE 0.05 END + CASE WHEN mq THEN 0.1 ELSE 0 END + CASE WHEN an THEN 0.1 ELSE 0 END
    WHEN deg AND diagnosis_label = 'persistent_underperformance' THEN 0.12 + CASE WHEN an THEN 0.08 ELSE 0 END
    WHEN diagnosis_label = 'persistent_underperformance' THEN 0.15 + CASE WHEN mq THEN 0.1 ELSE 0 END + CASE WHEN t = 'A' THEN 0.1 ELSE 0.05 END ELSE 0.2 END AS diagnosis_base_conf FROM o"""


def rca_input(t):
    """Bins with planted signatures: voltage steps, dead bins and DC residual patterns."""
    e = F.col("eid")
    b = D.period_flags(_with_signal(t), DetectConfig())
    return b.withColumns(
        {
            "anomaly": e % 5 == 0,
            "v_ac_v": F.when(F.col("plant_id") % 2 == 0, F.col("v_ac_v") + F.when(e % 37 == 0, 40).when(e % 41 == 0, -40).otherwise(0)).otherwise(F.col("v_ac_v")),
            "p_ac_w": F.when(e % 7 == 0, 5.0).otherwise(F.col("p_ac_w")),
            "r_v_dc": F.when(e % 6 == 0, -0.5).when(e % 6 == 1, -0.25).otherwise(F.col("r_v_dc")),
            "r_i_dc": F.when(e % 4 == 0, -0.9).when(e % 4 == 1, -0.3).when(e % 4 == 2, -0.13),
        }
    )


def _with_signal(t):
    cfg = DetectConfig()
    s, _, _ = R.fused_signal(F.col("mismatch_rel"), channels(), F.col("valid_model"), dict(cfg.weights), 1.0, 0.75, cfg.min_support)
    return S.without_marks(D.sky_state(t.bin_state, SER).withColumn("signal", s))


def diagnosed(t):
    b = checkpointed(rca_input(t))      # read by the baseline and by the rules
    ch = {**channels(), "p_ac": (F.col("mismatch_rel"), F.col("c_p_ac"))}
    return RC.diagnose(b.join(RC.rca_baseline(b, P), P), ch)


@query("d12_root_cause_diagnosis", D12_SQL, ["diagnosis_base_conf"])
def diagnosis(t):
    return diagnosed(t).select("plant_id", "ts_15", "state_label", "diagnosis_label", "grid_evidence", "zero_injection", "diagnosis_base_conf")


@query("d05_ratio_cause",
       """WITH r AS (SELECT plant_id, ts_15, valid_model AS v, mismatch_rel AS m, v_dc_v / 330 AS vr, i_dc_a / 5 AS ir, q % 3 = 0 AS sk FROM bin_state),
       u AS (SELECT *, v AND m IS NOT NULL AS ok, v AND coalesce(m < -0.05, false) AND vr IS NOT NULL AND ir IS NOT NULL AS ls FROM r)
       SELECT plant_id, ts_15, CASE WHEN ls AND vr < 0.95 AND ir < 0.95 THEN CASE WHEN sk THEN 'degradation_like' ELSE 'partial_shading' END WHEN ls AND abs(ir - 1) <= 0.05 AND vr < 0.9 THEN 'short_or_bypass'
       WHEN ls AND abs(vr - 1) <= 0.05 AND ir < 0.9 AND sk THEN 'soiling' WHEN ls AND abs(vr - 1) <= 0.05 AND abs(ir - 0.75) <= 0.06 THEN 'string_disconnected' WHEN ok AND m >= -0.05 THEN 'normal' WHEN ok THEN 'unknown' ELSE 'invalid' END AS cause FROM u""")
def ratio_cause(t):
    c = F.col
    return t.bin_state.select("plant_id", "ts_15", RC.ratio_cause(c("mismatch_rel"), c("valid_model"), c("v_dc_v") / 330, c("i_dc_a") / 5, c("q") % 3 == 0, F.lit(4)).alias("cause"))


@query("d06_model_features", "SELECT plant_id, ts_15, g_poa, temp_air AS tcell_c, mismatch_rel, NULL::DOUBLE AS csi, v_ac_v, valid_model AND g_poa IS NOT NULL AND temp_air IS NOT NULL AS valid_ml FROM bin_state", ["g_poa", "tcell_c", "mismatch_rel", "csi", "v_ac_v"])
def features(t):
    b = t.bin_state.withColumns({"tcell_c": F.col("temp_air"), "valid": F.col("valid_model")})
    return RC.model_features(b, ["plant_id", "ts_15"]).select("plant_id", "ts_15", "g_poa", "tcell_c", "mismatch_rel", "csi", "v_ac_v", "valid_ml")


SQL_TABLES["conf_in"] = """SELECT *, eid % 4 = 0 AS anomaly, CASE WHEN eid % 8 <> 0 THEN CAST(eid % 9 AS DOUBLE) / 2 - 2 END AS ewma_z, CASE WHEN eid % 8 <> 0 THEN CAST(eid % 11 AS DOUBLE) END AS cusum_score,
   list_extract(['ok', 'persistent_underperformance', 'grid_overvoltage_trip', 'dc_side_partial_loss_probable', 'unknown_shutdown_with_sun', 'curtailment_clipping', 'invalid', 'dc_shading_soiling_probable'], CAST(coalesce(eid, 6) % 8 + 1 AS INTEGER)) AS diagnosis_label,
   CAST(coalesce(eid, 0) % 16 AS DOUBLE) / 16 AS bc, coalesce(eid % 12 = 0, false) AS ge FROM periods"""
SQL_TABLES["conf1"] = """SELECT *, 0.30::DOUBLE * CASE WHEN inv_coverage IS NOT NULL THEN inv_coverage WHEN flag_inv_missing THEN 0 ELSE 0.85 END + 0.20::DOUBLE * CASE WHEN flag_meteo_missing THEN 0 ELSE 1 END + 0.25::DOUBLE * meteo_qc_score
   + 0.15::DOUBLE * CASE WHEN p_ac_w IS NOT NULL AND mismatch_rel IS NOT NULL THEN 1 WHEN p_ac_w IS NOT NULL AND coalesce(gti, ghi) IS NOT NULL THEN 0.4::DOUBLE ELSE 0 END
   + 0.10::DOUBLE * greatest(0, 1 - CASE WHEN flag_low_coverage THEN 0.2::DOUBLE ELSE 0 END - CASE WHEN flag_meteo_low_confidence THEN 0.2::DOUBLE ELSE 0 END - CASE WHEN flag_meteo_interpolated THEN 0.1::DOUBLE ELSE 0 END - CASE WHEN flag_meteo_outlier THEN 0.2::DOUBLE ELSE 0 END - CASE WHEN flag_meteo_artifact THEN 0.25::DOUBLE ELSE 0 END) AS data_score,
   least(coalesce(abs(mismatch_rel), 0) / 0.5, 1) AS sv, least(coalesce(abs(ewma_z), 0) / 3, 1) AS ez, least(coalesce(abs(cusum_score), 0) / 8, 1) AS cz FROM conf_in"""
SQL_TABLES["conf2"] = """SELECT *, (0.35::DOUBLE * data_score + 0.35::DOUBLE * (CASE WHEN valid_period THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN coarse_period THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN fine_period THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN meteo_quality_ok THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN stable_sky THEN 0.1::DOUBLE ELSE 0 END)
   + 0.30::DOUBLE * CASE WHEN coalesce(anomaly, false) THEN 0.45::DOUBLE * sv + 0.2::DOUBLE * ez + 0.35::DOUBLE * cz ELSE 0.45::DOUBLE * greatest(0, 1 - greatest(sv, ez, cz / 1.2)) END) * CASE WHEN coalesce(anomaly, false) AND NOT valid_period THEN 0.35::DOUBLE ELSE 1 END AS detect_score FROM conf1"""

def confident(t):
    e = F.col("eid")
    b = D.period_flags(_with_signal(t), DetectConfig()).withColumns(
        {
            "anomaly": e % 4 == 0, "ewma_z": F.when(e % 8 != 0, (e % 9).cast("double") / 2 - 2), "cusum_score": F.when(e % 8 != 0, (e % 11).cast("double")),
            "diagnosis_label": F.element_at(F.array(*[F.lit(x) for x in ("ok", "persistent_underperformance", "grid_overvoltage_trip", "dc_side_partial_loss_probable", "unknown_shutdown_with_sun", "curtailment_clipping", "invalid", "dc_shading_soiling_probable")]), (F.coalesce(e, F.lit(6)) % 8 + 1).cast("int")),
            "diagnosis_base_conf": (F.coalesce(e, F.lit(0)) % 16).cast("double") / 16, "grid_evidence": V.flag(e % 12 == 0), "zero_injection": F.lit(False),
        }
    )
    return C.with_confidences(b, anomaly="anomaly")


LEVEL = "CASE WHEN {c} >= 0.85 THEN 'very_high' WHEN {c} >= 0.7 THEN 'high' WHEN {c} >= 0.5 THEN 'moderate' WHEN {c} >= 0.3 THEN 'low' ELSE 'very_low' END"


@query("d14_data_reliability", f"SELECT plant_id, ts_15, data_score FROM conf1", ["data_score"])
def data_score(t):
    return confident(t).select("plant_id", "ts_15", "data_score")


@query("d15_detection_confidence", "SELECT plant_id, ts_15, detect_score FROM conf2", ["detect_score"])
def detect_score(t):
    return confident(t).select("plant_id", "ts_15", "detect_score")


@query("d16_diagnosis_confidence",
       """WITH s AS (SELECT *, diagnosis_label IN ('grid_overvoltage_trip', 'curtailment_clipping') AS dl, 0.45::DOUBLE * bc + 0.2::DOUBLE * data_score + 0.2::DOUBLE * detect_score + 0.15::DOUBLE * CASE WHEN ge OR diagnosis_label IN ('grid_overvoltage_trip', 'curtailment_clipping') THEN 1 WHEN fine_period THEN 0.85::DOUBLE WHEN irradiance_tier IN ('A', 'B') THEN 0.55::DOUBLE ELSE 0.3::DOUBLE END AS s0 FROM conf2),
       c AS (SELECT *, least(s0, CASE diagnosis_label WHEN 'unknown_shutdown_with_sun' THEN 0.7::DOUBLE WHEN 'persistent_underperformance' THEN 0.65::DOUBLE WHEN 'dc_side_partial_loss_probable' THEN 0.8::DOUBLE ELSE 1 END) AS s1 FROM s)
       SELECT plant_id, ts_15, CASE WHEN diagnosis_label = 'invalid' THEN 0 WHEN dl AND (ge OR fine_period) THEN greatest(s1, 0.7) ELSE s1 END AS diag_score FROM c""", ["diag_score"])
def diag_score(t):
    return confident(t).select("plant_id", "ts_15", "diag_score")


@query("x14_confidence_levels", "SELECT plant_id, data_level, count(*) AS n FROM (SELECT plant_id, " + LEVEL.format(c="data_score") + " AS data_level FROM diag) GROUP BY 1, 2")
def levels(t):
    return t.diag.groupBy("plant_id", V.confidence_level(F.col("data_score")).alias("data_level")).agg(F.count(F.lit(1)).alias("n"))


SQL_TABLES["anoms"] = """SELECT *, sum(CASE WHEN p IS NULL OR ts_15 - p > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY plant_id ORDER BY ts_15) AS isl FROM
   (SELECT *, lag(ts_15) OVER (PARTITION BY plant_id ORDER BY ts_15) AS p FROM diag WHERE anomaly_flag)"""


@query("w09_gap_sessions", "SELECT plant_id, min(ts_15) AS ts_start, max(ts_15) AS ts_end, count(*) AS n_bins FROM anoms GROUP BY plant_id, isl HAVING count(*) >= 2")
def sessions(t):
    rows = E.sessions(t.diag.filter("anomaly_flag"), SER)
    return rows.groupBy("plant_id", "island").agg(F.min("ts_15").alias("ts_start"), F.max("ts_15").alias("ts_end"), F.count(F.lit(1)).alias("n_bins")).filter("n_bins >= 2").drop("island")


GROUPS = "CASE WHEN {x} LIKE 'grid_%' THEN 'grid_fault' WHEN {x} = 'unknown_shutdown_with_sun' THEN 'inverter_shutdown' WHEN {x} = 'dc_side_partial_loss_probable' THEN 'dc_side_partial_loss' ELSE {x} END"


@query("d19_fault_events",
       f"""WITH c AS (SELECT plant_id, isl, diagnosis_label AS l, count(*) AS n FROM anoms GROUP BY 1, 2, 3), d AS (SELECT plant_id, isl, arg_min(l, (-n, l)) AS dominant_diagnosis, arg_min(l, (-n, l)) FILTER (l NOT IN ('ok', 'invalid')) AS f FROM c GROUP BY 1, 2),
       s AS (SELECT plant_id, isl, domain_label AS l, count(*) AS n FROM anoms GROUP BY 1, 2, 3), m AS (SELECT plant_id, isl, arg_min(l, (-n, l)) AS domain_prelim FROM s GROUP BY 1, 2),
       e AS (SELECT plant_id, isl, min(ts_15) AS ts_start_utc, max(ts_15) AS ts_end_utc, count(*) AS n_bins, max(abs(detector_score)) AS detector_score_max, avg(detector_score) AS detector_score_mean, max(abs(mismatch_rel)) AS severity_score,
         sum(CASE WHEN pac_model_w IS NOT NULL THEN greatest(pac_model_w - pac_real_w, 0) * 0.25 END) AS energy_loss_wh FROM anoms GROUP BY 1, 2 HAVING count(*) >= 2)
       SELECT e.plant_id, ts_start_utc, ts_end_utc, n_bins, detector_score_max, detector_score_mean, severity_score, energy_loss_wh, dominant_diagnosis, domain_prelim, {GROUPS.format(x="coalesce(f, 'unknown')")} AS event_label_prelim
       FROM e JOIN d ON d.plant_id = e.plant_id AND d.isl = e.isl JOIN m ON m.plant_id = e.plant_id AND m.isl = e.isl""", ["detector_score_max", "detector_score_mean", "severity_score", "energy_loss_wh"])
def fault_events(t):
    return E.fault_events(t.diag, SER).drop("state_prelim", "status", "known_vs_unknown")


@query("a17_dominant_diagnosis", "SELECT plant_id, arg_min(l, (-n, l)) AS label FROM (SELECT plant_id, diagnosis_label AS l, count(*) AS n FROM diag GROUP BY 1, 2) GROUP BY 1")
def dominant(t):
    return t.diag.groupBy("plant_id").agg(F.mode("diagnosis_label", True).alias("label"))


@query("d17_event_confidence",
       """WITH l AS (SELECT plant_id, isl, diagnosis_label, count(*) AS n FROM anoms GROUP BY 1, 2, 3), r AS (SELECT plant_id, isl, max(n) / sum(n) AS ratio FROM l GROUP BY 1, 2),
       e AS (SELECT plant_id, isl, min(ts_15) AS ts_start, count(*) AS n_bins, avg(data_score) AS ds, avg(detect_score) AS t, avg(diag_score) AS g FROM anoms GROUP BY 1, 2),
       b AS (SELECT *, CASE WHEN n_bins >= 8 THEN 0.1::DOUBLE WHEN n_bins >= 4 THEN 0.06::DOUBLE WHEN n_bins >= 2 THEN 0.03::DOUBLE ELSE 0 END AS pb FROM e)
       SELECT b.plant_id, ts_start, n_bins, ratio AS dominant_label_ratio, ds AS data_score, CASE WHEN t IS NOT NULL THEN least(t + pb, 1) END AS detect_score, least(g + pb + 0.08::DOUBLE * ratio, 1) AS diag_score FROM b JOIN r ON r.plant_id = b.plant_id AND r.isl = b.isl""",
       ["dominant_label_ratio", "data_score", "detect_score", "diag_score"])
def event_confidence(t):
    rows = E.sessions(t.diag.filter("anomaly_flag"), SER)
    start = rows.groupBy("plant_id", "island").agg(F.min("ts_15").alias("ts_start"))
    return C.event_confidence(rows, ["plant_id", "island"]).join(start, ["plant_id", "island"]).select("plant_id", "ts_start", "n_bins", "dominant_label_ratio", "data_score", "detect_score", "diag_score")


@query("t03_top_reasons",
       """WITH r AS (SELECT plant_id, ts_15, 0 AS i, diagnosis_label AS reason FROM diag UNION ALL SELECT plant_id, ts_15, 1, domain_label FROM diag WHERE eid % 2 = 0),
       c AS (SELECT plant_id, reason, count(*) AS n, min((epoch_us(ts_15), i)) AS f FROM r GROUP BY 1, 2)
       SELECT plant_id, reason, n, rank FROM (SELECT plant_id, reason, n, row_number() OVER (PARTITION BY plant_id ORDER BY n DESC, f) AS rank FROM c) WHERE rank <= 5""")
def reasons(t):
    d = t.diag.withColumn("why", F.when(F.col("eid") % 2 == 0, F.array("diagnosis_label", "domain_label")).otherwise(F.array("diagnosis_label")))
    return C.top_reasons(d, P, "why", "ts_15")


@query("d20_runtime_severity",
       """SELECT plant_id, severity, count(*) AS n FROM (SELECT plant_id, CASE WHEN diagnosis_label = 'ok' OR state_label = 'injecting_normal' THEN 'ok' WHEN diagnosis_label IN ('grid_overvoltage_trip', 'unknown_shutdown_with_sun') THEN 'crit'
          WHEN diagnosis_label IN ('persistent_underperformance', 'dc_side_partial_loss_probable', 'curtailment_clipping') OR state_label = 'injecting_degraded' THEN 'warn' WHEN eid % 5 = 0 AND state_label = 'sun_available_not_injecting' THEN 'crit'
          WHEN diagnosis_label = 'invalid' THEN 'none' WHEN anomaly_flag THEN 'warn' ELSE 'none' END AS severity FROM diag) GROUP BY 1, 2""")
def severity(t):
    c = F.col
    return t.diag.groupBy("plant_id", LB.runtime_severity(c("state_label"), c("diagnosis_label"), c("eid") % 5 == 0, c("anomaly_flag")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))
