"""Heatmap, report tables, chart tables, complete jobs and the parameter search."""
from __future__ import annotations

from pyspark.sql import functions as F

from sunloom.gallery.detection_queries import channels
from sunloom.gallery.fixtures import SQL_TABLES
from sunloom.gallery.physics_queries import expected, plant_plates
from sunloom.gallery.registry import query
from sunloom.gallery.validation_queries import scored, score
from sunloom.operators import detect as D, events as E, power as PW, rca as RC, report as RP, series as S
from sunloom.plans import sweep as SW
from sunloom.plans.detection import run_detection
from sunloom.plans.mismatch import class_summary, mismatch_bins

SER = S.Series(("plant_id",), "ts_15")
P = ["plant_id"]
TZ = "America/Sao_Paulo"

SQL_TABLES["pts0"] = """SELECT *, CASE WHEN NOT valid_period THEN 0 WHEN diagnosis_label IN ('ok', 'invalid') THEN 1 WHEN starts_with(diagnosis_label, 'grid_') OR diagnosis_label = 'unknown_shutdown_with_sun' THEN 3 ELSE 2 END AS state,
   (ts_15 AT TIME ZONE 'UTC') AT TIME ZONE 'America/Sao_Paulo' AS wall, eid % 6 = 0 AS grid_evidence, eid % 7 = 0 AS zero_injection FROM diag"""
SQL_TABLES["pts"] = """SELECT *, wall::DATE::TIMESTAMP AS day, strftime(wall, '%Y-%m') AS month, CASE WHEN state = 0 AND diagnosis_label = 'ok' THEN 'invalid' WHEN state = 3 AND diagnosis_label IN ('ok', 'invalid') THEN 'critical_operational_anomaly'
   WHEN state = 2 AND diagnosis_label IN ('ok', 'invalid') THEN 'operational_anomaly_warning' ELSE diagnosis_label END AS label FROM pts0"""
LOUD = "state <> 0 AND lower(label) NOT IN ('', '-', 'invalid', 'normal', 'ok')"
STATES = "count(*) FILTER (state = 1) AS n_ok, count(*) FILTER (state = 2) AS n_warn, count(*) FILTER (state = 3) AS n_crit, count(*) FILTER (state = 0) AS n_none"
DOM = "SELECT plant_id, {k}, arg_min(label, (-n, t, label)) AS dominant_label FROM (SELECT plant_id, {k}, label, count(*) AS n, epoch(min(ts_15)) AS t FROM pts WHERE {w} GROUP BY 1, 2, 3) GROUP BY 1, 2"


def points(t):
    from sunloom.functions.labels import diagnosis_code

    e = F.col("eid")
    d = t.diag.withColumns({"diagnosis_code": diagnosis_code(F.col("diagnosis_label")), "grid_evidence": e % 6 == 0, "zero_injection": e % 7 == 0})
    return RP.report_points(d, TZ)


def stamp(df, c="day"):
    return df.withColumn(c, F.col(c).cast("timestamp"))


@query("d39_report_points", "SELECT plant_id, ts_15, state, label, day, month FROM pts", longs=["state"])
def report_points(t):
    return stamp(points(t)).select("plant_id", "ts_15", "state", "label", "day", "month")


@query("x28_quality_words", "SELECT plant_id, CASE WHEN detect_score IS NULL THEN 'indeterminado' WHEN detect_score >= 0.8 THEN 'alta' WHEN detect_score >= 0.55 THEN 'média' WHEN detect_score >= 0.3 THEN 'baixa' ELSE 'muito baixa' END AS word, count(*) AS n FROM diag GROUP BY 1, 2")
def words(t):
    return t.diag.groupBy("plant_id", RP.quality_word(F.col("detect_score")).alias("word")).agg(F.count(F.lit(1)).alias("n"))


@query("a29_monthly_rollup", f"SELECT p.plant_id, p.month, {STATES}, avg(data_score) FILTER (state <> 0) AS data_score_mean, avg(detect_score) FILTER (state <> 0) AS detect_score_mean, avg(diag_score) FILTER (state <> 0) AS diag_score_mean, coalesce(any_value(d.dominant_label), '-') AS dominant_label FROM pts p LEFT JOIN ({DOM.format(k='month', w=LOUD)}) d ON d.plant_id = p.plant_id AND d.month = p.month GROUP BY 1, 2",
       ["data_score_mean", "detect_score_mean", "diag_score_mean"])
def monthly(t):
    return RP.monthly_rows(points(t), P)


@query("a30_daily_rollup", f"SELECT p.plant_id, p.day, {STATES}, any_value(d.dominant_label) AS dominant_label FROM pts p LEFT JOIN ({DOM.format(k='day', w='true')}) d ON d.plant_id = p.plant_id AND d.day = p.day GROUP BY 1, 2")
def daily(t):
    return stamp(RP.daily_rows(points(t), P))


@query("a31_period_summary", f"""SELECT plant_id, count(*) AS n_points, {STATES}, count(*) FILTER (state <> 0) AS valid_points, count(*) FILTER ({LOUD}) AS diag_points, count(*) FILTER (state <> 0 AND data_score < 0.55) AS low_data_points,
   count(*) FILTER (state <> 0 AND diag_score < 0.55) AS low_diag_points, avg(data_score) FILTER (state <> 0) AS data_mean, avg(detect_score) FILTER (state <> 0) AS detect_mean, avg(diag_score) FILTER (state <> 0) AS diag_mean,
   count(*) FILTER ({LOUD} AND grid_evidence) AS direct_grid_points, count(*) FILTER ({LOUD} AND zero_injection) AS zero_injection_points FROM pts GROUP BY 1""", ["data_mean", "detect_mean", "diag_mean"])
def summary(t):
    return RP.period_summary(points(t), P)


@query("a31_top_labels", f"SELECT plant_id, label AS value, n, rank FROM (SELECT plant_id, label, count(*) AS n, row_number() OVER (PARTITION BY plant_id ORDER BY count(*) DESC, min(ts_15), label) AS rank FROM pts WHERE {LOUD} GROUP BY 1, 2) WHERE rank <= 5")
def top_labels(t):
    return RP.top_values(points(t), P, "label")


@query("t01_worst_bins", "SELECT plant_id, eid, rank FROM (SELECT plant_id, eid, row_number() OVER (PARTITION BY plant_id ORDER BY state DESC, abs(mismatch_rel) DESC, diag_score DESC, ts_15) AS rank FROM pts WHERE state IN (2, 3)) WHERE rank <= 5")
def worst(t):
    return RP.worst_bins(points(t), P, 5).select("plant_id", "eid", "rank")


DAYS = f"""WITH d AS (SELECT p.plant_id, p.day, count(*) FILTER (state = 3) AS n_crit, count(*) FILTER (state = 2) AS n_warn, coalesce(max(abs(mismatch_rel)) FILTER (state <> 0), 0) AS max_mismatch, avg(diag_score) FILTER (state <> 0) AS diag_mean, coalesce(any_value(d.dominant_label), '-') AS dominant_label
   FROM pts p LEFT JOIN ({DOM.format(k='day', w=LOUD)}) d ON d.plant_id = p.plant_id AND d.day = p.day GROUP BY 1, 2) """


@query("t02_critical_days", DAYS + "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plant_id ORDER BY n_crit DESC, n_warn DESC, max_mismatch DESC, floor(coalesce(diag_mean, 0) * 1e9) DESC, day) AS rank FROM d) WHERE rank <= 18", ["max_mismatch", "diag_mean"])
def critical(t):
    return stamp(RP.critical_days(points(t), P))


@query("t02_critical_days_weighted", DAYS + "SELECT plant_id, day, rank FROM (SELECT *, row_number() OVER (PARTITION BY plant_id ORDER BY n_crit * 100 + n_warn DESC, max_mismatch DESC, floor(coalesce(diag_mean, 0) * 1e9) DESC, day) AS rank FROM d) WHERE rank <= 12")
def critical_weighted(t):
    return stamp(RP.critical_days(points(t), P, 12, True)).select("plant_id", "day", "rank")


SQL_TABLES["hd"] = """SELECT d.*, w.flag_meteo_interpolated, w.flag_meteo_low_confidence, w.ghi IS NULL AS flag_meteo_missing, w.meteo_qc_score, eid % 9 <> 0 AS stable_sky FROM diag d LEFT JOIN weather w ON w.plant_id = d.plant_id AND w.ts_utc = d.ts_15"""
SQL_TABLES["warn0"] = """SELECT plant_id, ((ts_15 AT TIME ZONE 'UTC') AT TIME ZONE 'America/Sao_Paulo') AS w, -mismatch_rel AS u, flag_meteo_interpolated AS it FROM hd WHERE valid_period AND pac_real_w IS NOT NULL AND NOT coalesce(flag_meteo_missing, false) AND NOT coalesce(flag_meteo_low_confidence, false) AND coalesce(meteo_qc_score >= 0.6, true) AND -mismatch_rel >= 0.1 AND coalesce(g_poa >= 700, true) AND stable_sky"""
SQL_TABLES["warn1"] = "SELECT plant_id, w::DATE::TIMESTAMP AS day, (hour(w) * 60 + minute(w)) // 15 AS bin, u, it FROM warn0"
SQL_TABLES["warn2"] = "SELECT *, coalesce(bin - lag(bin) OVER w = 1, false) OR coalesce(lead(bin) OVER w - bin = 1, false) AS persistent FROM warn1 WINDOW w AS (PARTITION BY plant_id, day ORDER BY bin)"
SQL_TABLES["warn3"] = "SELECT *, CASE WHEN it THEN 'warn_mismatch_interp' ELSE 'warn_mismatch' END AS warn_label FROM warn2 WHERE persistent OR u >= 0.2"


def heat_diag(t):
    w = t.weather.select("plant_id", F.col("ts_utc").alias("ts_15"), "flag_meteo_interpolated", "flag_meteo_low_confidence", F.col("ghi").isNull().alias("flag_meteo_missing"), "meteo_qc_score")
    return t.diag.join(w, ["plant_id", "ts_15"], "left").withColumn("stable_sky", F.col("eid") % 9 != 0)


@query("w13_warning_bins", "SELECT plant_id, day, bin, u AS underperformance, it AS interp, persistent, warn_label FROM warn3", ["underperformance"])
def warnings(t):
    return stamp(RP.warn_bins(heat_diag(t), P, TZ))


SQL_TABLES["hcov"] = "SELECT plant_id, ((ts_15 AT TIME ZONE 'UTC') AT TIME ZONE 'America/Sao_Paulo')::DATE::TIMESTAMP AS day, (hour((ts_15 AT TIME ZONE 'UTC') AT TIME ZONE 'America/Sao_Paulo') * 60 + minute(ts_15)) // 15 AS bin, bool_or(NOT flag_inv_missing) AS cov FROM merged GROUP BY 1, 2, 3"
SQL_TABLES["hdg"] = "SELECT plant_id, ((ts_15 AT TIME ZONE 'UTC') AT TIME ZONE 'America/Sao_Paulo')::DATE::TIMESTAMP AS day, (hour((ts_15 AT TIME ZONE 'UTC') AT TIME ZONE 'America/Sao_Paulo') * 60 + minute(ts_15)) // 15 AS bin, CASE WHEN anomaly_flag THEN 3 ELSE 1 END AS st, diagnosis_label AS lb, NOT coalesce(flag_meteo_missing, false) AND NOT coalesce(flag_meteo_low_confidence, false) AS gr FROM hd"
SQL_TABLES["hev0"] = "SELECT plant_id, pred_id, label, conf, score, ts_start_utc, unnest(generate_series((ts_start_utc AT TIME ZONE 'UTC') AT TIME ZONE 'America/Sao_Paulo', (ts_end_utc AT TIME ZONE 'UTC') AT TIME ZONE 'America/Sao_Paulo', INTERVAL 15 MINUTE)) AS w FROM scored2"
SQL_TABLES["hev"] = "SELECT plant_id, w::DATE::TIMESTAMP AS day, (hour(w) * 60 + minute(w)) // 15 AS bin, arg_max({'i': pred_id, 'l': label, 'c': conf}, (score, -epoch(ts_start_utc), pred_id)) AS e FROM hev0 GROUP BY 1, 2, 3"
SQL_TABLES["hj"] = """SELECT plant_id, day, bin, coalesce(st, CASE WHEN cov THEN 1 ELSE 0 END) AS s0, coalesce(lb, CASE WHEN cov THEN 'coverage_only' ELSE '' END) AS l0, coalesce(gr, false) AS gr, e.i AS event_id, e.l AS el, e.c AS ec, CASE WHEN e.l IN ('normal', 'curtailment_clipping') THEN 1 WHEN e.l IS NOT NULL THEN 3 END AS es, warn_label
   FROM hcov FULL JOIN hdg USING (plant_id, day, bin) FULL JOIN hev USING (plant_id, day, bin) FULL JOIN warn3 USING (plant_id, day, bin)"""
SQL_TABLES["hk"] = """SELECT *, CASE WHEN es = 3 THEN 3 WHEN es = 1 AND s0 = 3 AND ec >= 0.7 AND gr THEN 1 WHEN es = 1 AND s0 = 3 AND ec >= 0.45 AND gr THEN 2 WHEN es = 1 AND s0 = 0 THEN 1 ELSE s0 END AS s1,
   CASE WHEN es = 3 THEN el WHEN es = 1 AND s0 = 3 AND ec >= 0.7 AND gr THEN el WHEN es = 1 AND s0 = 3 AND ec >= 0.45 AND gr THEN 'warn_refined_guard' WHEN es = 1 AND s0 <> 3 THEN el WHEN es = 1 THEN coalesce(nullif(l0, ''), el) ELSE l0 END AS l1 FROM hj"""
SQL_TABLES["heat"] = """SELECT plant_id, day, bin, CASE WHEN warn_label IS NOT NULL AND s1 = 1 THEN 2 ELSE s1 END AS state, coalesce(nullif(CASE WHEN warn_label IS NOT NULL AND s1 = 1 AND l1 IN ('', 'coverage_only', 'normal', 'curtailment_clipping', 'meteo_bias') THEN warn_label ELSE l1 END, ''),
   CASE WHEN s1 = 0 THEN 'sem_diagnostico' WHEN s1 = 1 THEN 'normal' WHEN s1 = 2 THEN 'warn_mismatch' ELSE 'anomaly' END) AS label, event_id FROM hk"""


def heat(t):
    ev = scored(t)
    cells = E.event_bins(ev, P, score(), ["pred_id", "label", "conf"], TZ, tie="pred_id").select(
        "plant_id", "day", "bin", "label", E.label_state(F.col("label")).alias("state"), F.col("conf").alias("confidence"), F.col("pred_id").alias("event_id"))
    return RP.heatmap(t.merged, heat_diag(t), cells, P, TZ)


@query("d37_coverage_first_heatmap", "SELECT plant_id, day, bin, state, label, event_id FROM heat", longs=["state"])
def heatmap(t):
    return stamp(heat(t))


@query("j14_layered_overlay_counts", "SELECT plant_id, state, label, count(*) AS n FROM heat GROUP BY 1, 2, 3", longs=["state"])
def layered(t):
    return heat(t).groupBy("plant_id", "state", "label").agg(F.count(F.lit(1)).alias("n"))


@query("u06_dense_day_matrix",
       """WITH g AS (SELECT plant_id, unnest(generate_series(range_start, range_end - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS day FROM plant_ranges), m AS (SELECT *, unnest(range(0, 96)) AS bin FROM g)
       SELECT m.plant_id, m.day, m.bin, coalesce(h.state, 0) AS state, coalesce(h.label, 'sem_diagnostico') AS label FROM m LEFT JOIN heat h ON h.plant_id = m.plant_id AND h.day = m.day AND h.bin = m.bin""", longs=["state"])
def dense(t):
    return stamp(RP.dense_heatmap(heat(t), t.ranges, P)).select("plant_id", "day", "bin", "state", "label")


@query("a27_reliability_gauge", """SELECT plant_id, g AS gcv_stat, CAST(round_even(100 * (1 - greatest(least((g - 0.1) / (0.4 - 0.1), 1), 0)), 0) AS BIGINT) AS score, CASE WHEN g <= 0.1 THEN 'Alta' WHEN g >= 0.4 THEN 'Baixa' ELSE 'Média' END AS label FROM
   (SELECT plant_id, quantile_cont(CASE WHEN rn >= 4 THEN s / greatest(m, 50) END, 0.5) AS g FROM (SELECT plant_id, row_number() OVER (PARTITION BY plant_id ORDER BY ts_15) AS rn, avg(g_poa) OVER w AS m, stddev_pop(g_poa) OVER w AS s FROM bin_state WINDOW w AS (PARTITION BY plant_id ORDER BY ts_15 ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) GROUP BY 1)""", ["gcv_stat"])
def gauge(t):
    b = S.core(S.blocks(t.bin_state, SER, before=4).withColumns(D.hour_stability("g_poa", SER.blocked)))
    return RP.reliability_gauge(b, P)


WF = """SELECT plant_id, sum(CASE WHEN u THEN 18 * 300 END) * 0.25 / 1000 AS e_stc, sum(CASE WHEN u THEN 18 * 300 * g_poa / 1000 END) * 0.25 / 1000 AS e_after_g, sum(CASE WHEN u THEN greatest(pac_model_w, 0) * 1.125 END) * 0.25 / 1000 AS e_after_t,
   sum(CASE WHEN u THEN greatest(pac_model_w, 0) / 0.9375 END) * 0.25 / 1000 AS e_after_sys, sum(CASE WHEN u THEN greatest(pac_model_w, 0) END) * 0.25 / 1000 AS e_ac FROM (SELECT *, valid_model AND g_poa > 0 AS u FROM bin_state) GROUP BY 1"""


def waterfall_table(t):
    b = t.bin_state.withColumns({"valid": F.col("valid_model"), "p_stc_w": F.lit(5400.0), "p_dc_exp_w": F.col("pac_model_w") * 1.125, "p_ac_exp_w": F.col("pac_model_w"), "eta_inv": F.lit(0.9375)})
    return RP.loss_waterfall(b, P)


@query("a28_loss_waterfall", f"SELECT *, greatest(e_stc - e_after_g, 0) AS loss_irradiance, greatest(e_after_g - e_after_t, 0) AS loss_temperature, greatest(e_after_t - e_after_sys, 0) AS loss_system, greatest(e_after_sys - e_ac, 0) AS loss_inverter FROM ({WF})",
       ["e_stc", "e_after_g", "e_after_t", "e_after_sys", "e_ac", "loss_irradiance", "loss_temperature", "loss_system", "loss_inverter"])
def waterfall(t):
    return waterfall_table(t)


@query("a28_waterfall_links", f"SELECT plant_id, CAST(l.s AS BIGINT) AS source, CAST(l.t AS BIGINT) AS target, l.v AS value FROM (SELECT plant_id, unnest([{{'s': 0, 't': 1, 'v': e_after_g}}, {{'s': 1, 't': 2, 'v': e_after_t}}, {{'s': 2, 't': 3, 'v': e_after_sys}}, {{'s': 3, 't': 4, 'v': e_ac}}, {{'s': 4, 't': 5, 'v': e_ac}}, {{'s': 0, 't': 6, 'v': greatest(e_stc - e_after_g, 0)}}, {{'s': 1, 't': 7, 'v': greatest(e_after_g - e_after_t, 0)}}, {{'s': 2, 't': 8, 'v': greatest(e_after_t - e_after_sys, 0)}}, {{'s': 3, 't': 9, 'v': greatest(e_after_sys - e_ac, 0)}}]) AS l FROM ({WF}))", ["value"])
def links(t):
    return RP.waterfall_links(waterfall_table(t), P)


CAUSE = "CASE WHEN NOT valid_model THEN 0 WHEN mismatch_rel IS NULL THEN 0 WHEN mismatch_rel >= -0.05 THEN 1 ELSE 2 END"


@query("d38_diagnostic_codes", f"""WITH c AS (SELECT plant_id, ts_15, {CAUSE} AS code FROM bin_state), r AS (SELECT *, row_number() OVER (PARTITION BY plant_id ORDER BY ts_15) - row_number() OVER (PARTITION BY plant_id, code ORDER BY ts_15) AS g FROM c)
   SELECT plant_id, ts_15, code, CASE WHEN code NOT IN (0, 1) AND count(*) OVER (PARTITION BY plant_id, code, g) < 4 THEN 1 ELSE code END AS code_stable FROM r""", longs=["code", "code_stable"])
def codes(t):
    c = F.col
    none = F.lit(None).cast("double")
    cause = RC.ratio_cause(c("mismatch_rel"), c("valid_model"), none, none, F.lit(False), F.lit(4))
    d = t.bin_state.withColumn("code", RP.diagnostic_code(cause, c("valid_model")))
    return D.persistent_faults(d, SER, normal=1, invalid=0).select("plant_id", "ts_15", "code", "code_stable")


@query("w20_scoring_rates",
       """SELECT plant_id, sum((diagnosis_label = 'unknown_shutdown_with_sun' AND hour(w) * 60 + minute(w) >= 990 AND coalesce(g_poa >= 120, false))::INT) / greatest(count(*) FILTER (valid_period), 1) AS late_unknown_rate, count(*) FILTER (diag_score < 0.6) / count(*) AS low_conf_rate FROM
          (SELECT *, (ts_15 AT TIME ZONE 'UTC') AT TIME ZONE 'America/Sao_Paulo' AS w FROM diag) GROUP BY 1""", ["late_unknown_rate", "low_conf_rate"])
def scoring_rates(t):
    from sunloom.functions import timegrid as tg

    c = F.col
    late = (c("diagnosis_label") == "unknown_shutdown_with_sun") & RP.late_day(tg.local("ts_15", TZ)) & F.coalesce(c("g_poa") >= 120, F.lit(False))
    return t.diag.groupBy("plant_id").agg((F.count_if(late) / F.greatest(F.count_if("valid_period"), F.lit(1))).alias("late_unknown_rate"),
                                          (F.count_if(c("diag_score") < 0.6) / F.count(F.lit(1))).alias("low_conf_rate"))


@query("u09_bin_records", """SELECT m.plant_id, m.ts_15, strftime((m.ts_15 AT TIME ZONE 'UTC') AT TIME ZONE 'America/Sao_Paulo', '%Y-%m-%dT%H:%M') AS tkey, coalesce(n, 0) AS n_sources, p AS first_pac FROM power_15 m JOIN (SELECT plant_id, ts_15, count(*) AS n, arg_min(p_ac_w, source_oper) AS p FROM by_source GROUP BY 1, 2) s ON s.plant_id = m.plant_id AND s.ts_15 = m.ts_15""", ["first_pac"])
def records(t):
    from sunloom.operators import bins

    b = t.by_source
    r = RP.bin_records(b, bins.bucket_power(t.telemetry, P), P, ["p_ac_w", "p_dc_w", "v_dc_v"], {"total": ["p_ac_w", "e_ac_wh_15"], "quality": ["inv_n", "inv_coverage"]}, TZ)
    src = F.from_json(F.get_json_object("record", "$.sources"), "map<string, struct<p_ac_w: double>>")
    r = r.withColumn("s", src)
    return r.select("plant_id", "ts_15", "tkey", F.size("s").alias("n_sources"), F.element_at(F.array_sort(F.map_entries("s")), 1)["value"]["p_ac_w"].alias("first_pac"))


@query("d38_scatter_points", f"""SELECT plant_id, ts_15, x AS x_gcv, mismatch_rel AS y_mismatch, {CAUSE} AS code FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY plant_id ORDER BY ts_15) >= 4 THEN stddev_pop(g_poa) OVER w / greatest(avg(g_poa) OVER w, 50) END AS x FROM bin_state
   WINDOW w AS (PARTITION BY plant_id ORDER BY ts_15 ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) WHERE valid_model AND x IS NOT NULL AND mismatch_rel IS NOT NULL""", ["x_gcv", "y_mismatch"], longs=["code"])
def scatter(t):
    c = F.col
    none = F.lit(None).cast("double")
    cause = RC.ratio_cause(c("mismatch_rel"), c("valid_model"), none, none, F.lit(False), F.lit(4))
    b = S.core(S.blocks(t.bin_state, SER, before=4).withColumns(D.hour_stability("g_poa", SER.blocked)))
    return RP.scatter_points(b.withColumns({"valid": c("valid_model"), "code": RP.diagnostic_code(cause, c("valid_model"))}), P)


@query("d18_batch_detection")
def batch_detection(t):
    diag, _ = run_detection(t.merged.withColumn("i_ac_a", F.lit(None).cast("double")), PW.plant_parameters(plant_plates(t)))
    return diag.select("plant_id", "ts_15", "source_oper", "source_meteo", "anomaly_flag", "detector_score", "state_label", "diagnosis_label", "data_score", "detect_score", "diag_score")


@query("d18_batch_fault_events")
def batch_events(t):
    _, ev = run_detection(t.merged.withColumn("i_ac_a", F.lit(None).cast("double")), PW.plant_parameters(plant_plates(t)))
    return ev


def runtime_input(t):
    return t.bin_state.withColumns({"model_valid": F.col("valid_model"), "i_ac_a": F.lit(None).cast("double")})


@query("d21_mismatch_table")
def mismatch_table(t):
    return mismatch_bins(runtime_input(t), SER, channels()).select("plant_id", "ts_15", "base_gate", "gate_reason", "detection_signal", "combined_event_score", "anomaly", "diagnosis_label", "typology_class", "mismatch_class", "mismatch_reason", "data_score", "detect_score", "diag_score")


@query("d21_class_summary")
def mismatch_summary(t):
    return class_summary(mismatch_bins(runtime_input(t), SER, channels()), P)


@query("d24_parameter_search")
def parameter_search(t):
    return SW.parameter_search(runtime_input(t), SER, channels(), SW.trials(), tz=TZ)


@query("t04_top_trials", """SELECT p_brand, p_partkey, rank FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice % 7 DESC, p_partkey) AS rank FROM part) WHERE rank <= 10""")
def top_trials(t):
    p = t.raw("part").select("p_brand", "p_partkey", (F.col("p_retailprice") % 7).alias("score"), F.col("p_partkey").alias("trial"))
    return SW.top_trials(p, ["p_brand"]).select("p_brand", "p_partkey", "rank")


@query("d38_expected_waterfall")
def expected_waterfall(t):
    return RP.loss_waterfall(expected(t), P)
