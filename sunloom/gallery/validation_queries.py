"""Event matching, bin truth, metrics, confusion tables, event look-ups and reviews."""
from __future__ import annotations

from pyspark.sql import functions as F

from sunloom.functions import labels as LB, timegrid as tg
from sunloom.gallery.fixtures import SQL_TABLES
from sunloom.gallery.registry import query
from sunloom.operators import events as E, keys as K, validation as VA

KS = ["plant_id", "source_oper"]
P = ["plant_id"]

SQL_TABLES["cand"] = """SELECT p.plant_id, p.source_oper, pred_id, truth_id, CASE WHEN linked_pred_id = pred_id THEN 1 ELSE 0 END AS linked, p.ts_start_utc AS p0, t.ts_start_utc AS t0, pred_label, truth_label,
   greatest(0, epoch(least(p.ts_end_utc, t.ts_end_utc)) - epoch(greatest(p.ts_start_utc, t.ts_start_utc))) AS ov,
   epoch(p.ts_end_utc) - epoch(p.ts_start_utc) + epoch(t.ts_end_utc) - epoch(t.ts_start_utc) AS tot
   FROM pred_events p JOIN truth_events t ON p.plant_id = t.plant_id AND p.source_oper = t.source_oper AND truth_state = 'confirmed'
   AND (least(p.ts_end_utc, t.ts_end_utc) > greatest(p.ts_start_utc, t.ts_start_utc) OR linked_pred_id = pred_id)"""
SQL_TABLES["cands"] = "SELECT *, CASE WHEN ov > 0 AND tot - ov > 0 THEN ov / (tot - ov) ELSE 0 END AS iou FROM cand"
SQL_TABLES["ranked"] = """SELECT *, row_number() OVER (PARTITION BY plant_id, source_oper ORDER BY linked DESC, iou DESC, ov DESC, p0, pred_id, t0, truth_id) AS rk FROM cands"""
MATCH = """WITH RECURSIVE rr AS MATERIALIZED (SELECT * FROM ranked), g(plant_id, source_oper, rk, pu, tu, hit) AS (
   SELECT plant_id, source_oper, 0::BIGINT, []::BIGINT[], []::BIGINT[], false FROM (SELECT DISTINCT plant_id, source_oper FROM rr) UNION ALL
   SELECT r.plant_id, r.source_oper, r.rk, CASE WHEN list_contains(pu, pred_id) OR list_contains(tu, truth_id) THEN pu ELSE list_append(pu, pred_id) END,
     CASE WHEN list_contains(pu, pred_id) OR list_contains(tu, truth_id) THEN tu ELSE list_append(tu, truth_id) END, NOT (list_contains(pu, pred_id) OR list_contains(tu, truth_id))
   FROM g JOIN rr r ON r.plant_id = g.plant_id AND r.source_oper = g.source_oper AND r.rk = g.rk + 1),
  matched AS (SELECT r.*, CASE WHEN pred_label = truth_label THEN 'TP' ELSE 'PARTIAL' END AS match_type, greatest(0, (epoch(p0) - epoch(t0)) / 60) AS delay FROM g JOIN rr r ON r.plant_id = g.plant_id AND r.source_oper = g.source_oper AND r.rk = g.rk WHERE hit) """


def matches(t):
    return VA.match_events(t.pred_events, t.truth_events, KS)


@query("j06_match_events", MATCH + "SELECT pred_id, truth_id, CAST(linked AS BIGINT) AS linked, iou AS iou_time, ov / 60 AS overlap_minutes, delay AS detection_delay_min, match_type FROM matched",
       ["iou_time", "overlap_minutes", "detection_delay_min"], recursive=True)
def match_events(t):
    return matches(t).select("pred_id", "truth_id", "linked", "iou_time", "overlap_minutes", "detection_delay_min", "match_type")


@query("a22_delay_statistics", MATCH + "SELECT plant_id, avg(delay) AS mean_detection_delay_min, quantile_cont(delay, 0.5) AS median_detection_delay_min, quantile_cont(delay, 0.9) AS p90_detection_delay_min FROM matched GROUP BY 1",
       ["mean_detection_delay_min", "median_detection_delay_min", "p90_detection_delay_min"], recursive=True)
def delays(t):
    return VA.delay_stats(matches(t), P)


@query("a19_event_metrics", MATCH + """SELECT n_pred, n_confirmed, tp, tp_strict, n_pred - tp AS fp, n_confirmed - tp AS fn, tp / n_pred AS precision, tp / n_confirmed AS recall, 2 * (tp / n_pred) * (tp / n_confirmed) / (tp / n_pred + tp / n_confirmed) AS f1, plant_id FROM
   (SELECT plant_id, count(*) AS n_pred FROM pred_events GROUP BY 1) p JOIN (SELECT plant_id, count(*) FILTER (truth_state = 'confirmed') AS n_confirmed FROM truth_events GROUP BY 1) t USING (plant_id)
   JOIN (SELECT plant_id, count(*) AS tp, count(*) FILTER (match_type = 'TP') AS tp_strict FROM matched GROUP BY 1) m USING (plant_id)""", ["precision", "recall", "f1"], recursive=True)
def event_metrics(t):
    return VA.event_metrics(t.pred_events, t.truth_events, matches(t), P).select("plant_id", "n_pred", "n_confirmed", "tp", "tp_strict", "fp", "fn", "precision", "recall", "f1")


SQL_TABLES["sbins"] = "SELECT DISTINCT plant_id, 'S' || user_id AS source_oper, time_bucket(INTERVAL 15 MINUTE, ts_utc) AS ts_15, min(event_id) OVER (PARTITION BY user_id, time_bucket(INTERVAL 15 MINUTE, ts_utc)) AS eid FROM samples"
SQL_TABLES["truth_bin0"] = """SELECT b.plant_id, b.source_oper, b.ts_15, b.eid, count(t.truth_id) AS n, coalesce(bool_or(truth_state IN ('uncertain', 'dismissed')), false) AS skip, count(DISTINCT truth_label) FILTER (truth_state = 'confirmed') AS nl,
   min(truth_label) FILTER (truth_state = 'confirmed') AS lab, coalesce(bool_or(truth_state = 'normal'), false) AS ok, arg_min(truth_id, (epoch(ts_start_utc), truth_id)) FILTER (truth_state = 'confirmed') AS fid, arg_min(truth_id, (epoch(ts_start_utc), truth_id)) FILTER (truth_state = 'normal') AS nid
   FROM sbins b LEFT JOIN truth_events t ON t.plant_id = b.plant_id AND t.source_oper = b.source_oper AND b.ts_15 BETWEEN ts_start_utc AND ts_end_utc GROUP BY ALL"""
SQL_TABLES["truth_bin"] = """SELECT *, CASE WHEN n = 0 THEN 'unlabeled' WHEN skip OR (nl > 0 AND ok) OR nl > 1 THEN 'ignore' WHEN nl > 0 THEN 'fault' WHEN ok THEN 'normal' ELSE 'ignore' END AS bin_truth_state FROM truth_bin0"""


def source_bins(t):
    s = t.samples
    return s.groupBy("plant_id", F.concat(F.lit("S"), F.col("user_id")).alias("source_oper"), tg.floor_to("ts_utc").alias("ts_15")).agg(F.min("event_id").alias("eid"))


def truth_bins(t):
    b = source_bins(t)
    return b.join(VA.bin_truth(b, t.truth_events, KS, "ts_15"), [*KS, "ts_15"])


@query("j07_bin_truth", """SELECT plant_id, source_oper, ts_15, bin_truth_state, CASE bin_truth_state WHEN 'fault' THEN lab WHEN 'normal' THEN 'normal' END AS bin_truth_label, CASE bin_truth_state WHEN 'fault' THEN fid WHEN 'normal' THEN nid END AS truth_event_id FROM truth_bin""")
def bin_truth(t):
    return truth_bins(t).drop("eid")


@query("j08_first_event_overlay", """SELECT b.plant_id, b.source_oper, b.ts_15, arg_min(pred_id, (epoch(ts_start_utc), pred_id)) AS pred_id, arg_min(pred_label, (epoch(ts_start_utc), pred_id)) AS pred_label
   FROM sbins b LEFT JOIN pred_events p ON p.plant_id = b.plant_id AND p.source_oper = b.source_oper AND b.ts_15 BETWEEN ts_start_utc AND ts_end_utc GROUP BY 1, 2, 3""")
def overlay(t):
    return E.first_event_per_bin(source_bins(t), t.pred_events, KS, "ts_15", ["pred_id", "pred_label"], "pred_id")


FLAGS = "eid % 2 = 0 AS fl, CASE WHEN eid % 13 <> 0 THEN CAST(eid % 900 AS DOUBLE) END AS g, eid % 3 = 0 AS mq"
SQL_TABLES["judged"] = f"""SELECT *, {FLAGS}, list_extract(['ok', 'persistent_underperformance', 'grid_overvoltage_trip', 'dc_side_partial_loss_probable'], CAST(eid % 4 + 1 AS INTEGER)) AS diagnosis_label FROM truth_bin WHERE bin_truth_state IN ('fault', 'normal')"""
METRICS = """count(*) FILTER (bin_truth_state = 'fault' AND fl) AS tp, count(*) FILTER (bin_truth_state = 'normal' AND fl) AS fp, count(*) FILTER (bin_truth_state = 'fault' AND NOT fl) AS fn, count(*) FILTER (bin_truth_state = 'normal' AND NOT fl) AS tn"""
BUCKET = "CASE WHEN g IS NULL THEN 'unknown' WHEN g < 180 THEN '<180' WHEN g < 320 THEN '180-320' WHEN g < 500 THEN '320-500' WHEN g < 700 THEN '500-700' ELSE '>=700' END"


def judged(t):
    e = F.col("eid")
    return truth_bins(t).withColumns(
        {"anomaly_flag": e % 2 == 0, "g_poa": F.when(e % 13 != 0, (e % 900).cast("double")), "meteo_quality_ok": e % 3 == 0,
         "diagnosis_label": F.element_at(F.array(*[F.lit(x) for x in ("ok", "persistent_underperformance", "grid_overvoltage_trip", "dc_side_partial_loss_probable")]), (e % 4 + 1).cast("int"))})


@query("a20_metrics_by_slice",
       f"""WITH u AS (SELECT plant_id, 'total' AS slice, 'all' AS bucket, * EXCLUDE (plant_id) FROM judged UNION ALL SELECT plant_id, 'irradiance', {BUCKET}, * EXCLUDE (plant_id) FROM judged UNION ALL SELECT plant_id, 'meteo', CASE WHEN mq THEN 'meteo_ok' ELSE 'meteo_low_quality' END, * EXCLUDE (plant_id) FROM judged),
       m AS (SELECT plant_id, slice, bucket, {METRICS} FROM u GROUP BY 1, 2, 3), r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall FROM m)
       SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) END AS f1 FROM r""", ["precision", "recall", "f1"])
def slices(t):
    return VA.bin_metrics(judged(t), P)


@query("a21_bin_confusion", "SELECT plant_id, lab AS truth, CASE WHEN fl THEN diagnosis_label ELSE 'normal' END AS pred, count(*) AS n FROM judged WHERE bin_truth_state = 'fault' GROUP BY 1, 2, 3")
def confusion(t):
    return VA.bin_confusion(judged(t), P)


@query("a21_event_confusion", MATCH + "SELECT plant_id, truth_label AS truth, pred_label AS pred, count(*) AS n FROM matched GROUP BY 1, 2, 3", recursive=True)
def event_confusion(t):
    return VA.multiclass_counts(matches(t), P, "truth_label", "pred_label")


@query("a23_false_alarm_rates",
       MATCH + """, b AS (SELECT plant_id, count(DISTINCT CAST((ts_15 AT TIME ZONE 'UTC') AT TIME ZONE 'America/Sao_Paulo' AS DATE)) FILTER (bin_truth_state IN ('fault', 'normal')) AS ld, count(DISTINCT CAST((ts_15 AT TIME ZONE 'UTC') AT TIME ZONE 'America/Sao_Paulo' AS DATE)) AS ad, count(*) FILTER (bin_truth_state = 'normal' AND eid % 2 = 0) AS fb FROM truth_bin GROUP BY 1),
       f AS (SELECT plant_id, (SELECT count(*) FROM pred_events p WHERE p.plant_id = b.plant_id) - (SELECT count(*) FROM matched m WHERE m.plant_id = b.plant_id) AS fe, greatest(1, CASE WHEN ld > 0 THEN ld ELSE ad END) AS d, fb FROM b)
       SELECT plant_id, d AS monitored_days, fb / d AS false_alarm_bins_per_day, fe / d AS false_alarm_events_per_day, fe / ceil(d / 7.0) AS false_alarm_events_per_week FROM f""",
       ["false_alarm_bins_per_day", "false_alarm_events_per_day", "false_alarm_events_per_week"], recursive=True)
def alarms(t):
    counts = VA.event_metrics(t.pred_events, t.truth_events, matches(t), P)
    return VA.false_alarm_rates(judged(t), counts, P, "ts_15", "America/Sao_Paulo")


@query("d23_validation_report",
       MATCH + f"""SELECT 'bins' AS part, CAST(plant_id AS VARCHAR) AS plant, bin_truth_state AS name, count(*) AS n FROM truth_bin GROUP BY 1, 2, 3 UNION ALL SELECT 'matches', CAST(plant_id AS VARCHAR), match_type, count(*) FROM matched GROUP BY 1, 2, 3
       UNION ALL SELECT 'truth', CAST(plant_id AS VARCHAR), truth_state, count(*) FROM truth_events GROUP BY 1, 2, 3""", recursive=True)
def report(t):
    from sunloom.plans.validate import validation_report

    r = validation_report(judged(t), t.pred_events, t.truth_events, KS, truth_ready=True)
    part = lambda name, df, c: df.groupBy(F.lit(name).alias("part"), F.col("plant_id").cast("string").alias("plant"), F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return part("bins", r["bins"], "bin_truth_state").unionByName(part("matches", r["matches"], "match_type")).unionByName(part("truth", t.truth_events, "truth_state"))


@query("a24_multiclass_summary",
       """WITH c AS (SELECT diagnosis_label AS t, list_extract(['ok', 'persistent_underperformance', 'grid_overvoltage_trip', 'dc_side_partial_loss_probable', 'invalid', 'curtailment_clipping', 'unknown_shutdown_with_sun', 'dc_shading_soiling_probable'], CAST(CASE WHEN eid % 5 < 3 THEN eid % 8 ELSE (eid // 3) % 8 END + 1 AS INTEGER)) AS p FROM diag),
       l AS (SELECT DISTINCT x FROM (SELECT t AS x FROM c UNION ALL SELECT p FROM c)), r AS (SELECT x, (SELECT count(*) FROM c WHERE t = x AND p = x) AS tp, (SELECT count(*) FROM c WHERE t = x) AS s, (SELECT count(*) FROM c WHERE p = x) AS q FROM l),
       f AS (SELECT *, CASE WHEN q > 0 THEN tp / q ELSE 0 END AS pr, CASE WHEN s > 0 THEN tp / s ELSE 0 END AS re FROM r), g AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM f)
       SELECT sum(tp) / sum(s) AS accuracy, avg(re) FILTER (s > 0) AS balanced_accuracy, avg(f1) AS f1_macro, sum(f1 * s) / sum(s) AS f1_weighted, CAST(sum(s) AS BIGINT) AS n FROM g""", ["accuracy", "balanced_accuracy", "f1_macro", "f1_weighted"])
def multiclass(t):
    e = F.col("eid")
    names = ("ok", "persistent_underperformance", "grid_overvoltage_trip", "dc_side_partial_loss_probable", "invalid", "curtailment_clipping", "unknown_shutdown_with_sun", "dc_shading_soiling_probable")
    at = F.when(e % 5 < 3, e % 8).otherwise(F.floor(e / 3) % 8) + 1
    d = t.diag.withColumn("pred", F.element_at(F.array(*[F.lit(n) for n in names]), at.cast("int")))
    return VA.multiclass_summary(VA.multiclass_counts(d, [], "diagnosis_label", "pred"), [])


@query("a24_normalised_confusion", "SELECT plant_id, diagnosis_label AS truth, domain_label AS pred, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY plant_id, diagnosis_label) AS share FROM diag GROUP BY 1, 2, 3", ["share"])
def normalised(t):
    return VA.normalised_confusion(VA.multiclass_counts(t.diag, P, "diagnosis_label", "domain_label"), P)


@query("a24_probability_quality", "SELECT plant_id, avg(-ln(greatest(least(CASE WHEN eid % 7 = 0 THEN 0 ELSE data_score * 0.5 + 0.25 END, 1 - 1e-15), 1e-15))) AS log_loss, avg(greatest(CASE WHEN eid % 7 = 0 THEN 0 ELSE data_score * 0.5 + 0.25 END, 0.4)) AS mean_confidence FROM diag GROUP BY 1", ["log_loss", "mean_confidence"])
def probability(t):
    p = F.when(F.col("eid") % 7 == 0, 0.0).otherwise(F.col("data_score") * 0.5 + 0.25)
    return VA.probability_quality(t.diag.withColumn("proba", F.create_map(F.col("diagnosis_label"), p, F.lit("other"), F.lit(0.4))), P, "diagnosis_label", "proba")


@query("a25_balanced_weights", "SELECT eid, w AS weight FROM diag JOIN (SELECT diagnosis_label, (SELECT count(*) FROM diag) / ((SELECT count(DISTINCT diagnosis_label) FROM diag) * count(*)) AS w FROM diag GROUP BY 1) USING (diagnosis_label)", ["weight"])
def weights(t):
    return VA.balanced_weights(t.diag.select("eid", "diagnosis_label"), "diagnosis_label").select("eid", "weight")


SEV = "CASE {l} WHEN 'normal' THEN 0 WHEN 'invalid' THEN 0 WHEN 'curtailment_clipping' THEN 1 WHEN 'meteo_bias' THEN 1 WHEN 'mppt_disconnected' THEN 3 ELSE 2 END"
EVL = "list_extract(['mppt_disconnected', 'normal', 'unknown_fault', 'curtailment_clipping', 'grid_fault'], CAST(pred_id % 5 + 1 AS INTEGER))"
SQL_TABLES["scored"] = f"""SELECT *, {EVL} AS label, CAST(pred_id % 16 AS DOUBLE) / 8 AS sev, CASE WHEN pred_id % 6 <> 0 THEN CAST(pred_id % 9 AS DOUBLE) / 8 END AS conf, CASE WHEN pred_id % 5 <> 0 THEN CAST(pred_id % 11 AS DOUBLE) / 16 END AS nov FROM pred_events"""
SQL_TABLES["scored2"] = f"""SELECT *, {SEV.format(l='label')} * 1e9 + sev * 1e6 + coalesce(conf, 0) * 1e4 - CASE WHEN nov IS NULL OR nov = 0 THEN 1 ELSE nov END * 1e3 AS score FROM scored"""


def scored(t):
    p = F.col("pred_id")
    lab = F.element_at(F.array(*[F.lit(x) for x in ("mppt_disconnected", "normal", "unknown_fault", "curtailment_clipping", "grid_fault")]), (p % 5 + 1).cast("int"))
    return t.pred_events.withColumns({"label": lab, "sev": (p % 16).cast("double") / 8, "conf": F.when(p % 6 != 0, (p % 9).cast("double") / 8), "nov": F.when(p % 5 != 0, (p % 11).cast("double") / 16)})


def score():
    return E.event_score(F.col("label"), F.col("sev"), F.col("conf"), F.col("nov"))


@query("j09_event_bins", """WITH b AS (SELECT plant_id, source_oper, pred_id, label, score, ts_start_utc, unnest(generate_series((ts_start_utc AT TIME ZONE 'UTC') AT TIME ZONE 'America/Sao_Paulo', (ts_end_utc AT TIME ZONE 'UTC') AT TIME ZONE 'America/Sao_Paulo', INTERVAL 15 MINUTE)) AS w FROM scored2)
   SELECT plant_id, source_oper, w::DATE::TIMESTAMP AS day, (hour(w) * 60 + minute(w)) // 15 AS bin, arg_max(pred_id, (score, -epoch(ts_start_utc), pred_id)) AS pred_id, max(score) AS score FROM b GROUP BY 1, 2, 3, 4""", ["score"])
def event_bins(t):
    return E.event_bins(scored(t), KS, score(), ["pred_id"], "America/Sao_Paulo", tie="pred_id").withColumn("day", F.col("day").cast("timestamp"))


@query("t07_best_event_at_instant", """SELECT b.plant_id, b.source_oper, b.ts_15, arg_max(pred_id, (score, -pred_id)) AS pred_id FROM sbins b JOIN scored2 p ON p.plant_id = b.plant_id AND p.source_oper = b.source_oper AND b.ts_15 BETWEEN ts_start_utc AND ts_end_utc GROUP BY 1, 2, 3""")
def best_at(t):
    return E.event_at(source_bins(t), scored(t), KS, "ts_15", score(), ["pred_id"], "pred_id")


SQL_TABLES["tpreds"] = f"""SELECT pred_id, unnest([1, 2, 3]) AS mppt FROM pred_events"""
SQL_TABLES["tpreds2"] = f"""SELECT pred_id, mppt, list_extract(['normal', 'unknown_fault', 'mppt_imbalance', 'mppt_disconnected'], CAST((pred_id + mppt) % 4 + 1 AS INTEGER)) AS pred_label, CAST((pred_id * mppt) % 7 AS DOUBLE) / 8 AS confidence, CAST((pred_id + mppt) % 3 AS DOUBLE) / 4 AS novelty_score FROM tpreds"""
SQL_TABLES["bestp"] = f"""SELECT pred_id, mppt, pred_label FROM (SELECT *, row_number() OVER (PARTITION BY pred_id ORDER BY CASE pred_label WHEN 'normal' THEN 0 WHEN 'mppt_disconnected' THEN 3 ELSE 2 END * 1e6 + CASE WHEN pred_label <> 'unknown_fault' THEN 1e5 ELSE 0 END + confidence * 1e4 - CASE WHEN novelty_score = 0 THEN 1 ELSE novelty_score END * 100 DESC, mppt) AS rn FROM tpreds2) WHERE rn = 1"""


def tracker_preds(t):
    p = t.pred_events.select("pred_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("mppt"))
    i, m = F.col("pred_id"), F.col("mppt")
    lab = F.element_at(F.array(*[F.lit(x) for x in ("normal", "unknown_fault", "mppt_imbalance", "mppt_disconnected")]), ((i + m) % 4 + 1).cast("int"))
    return p.withColumns({"pred_label": lab, "confidence": ((i * m) % 7).cast("double") / 8, "novelty_score": ((i + m) % 3).cast("double") / 4})


def best_preds(t):
    c = F.col
    return E.best_predictions(tracker_preds(t), "pred_id", E.prediction_rank(c("pred_label"), c("confidence"), c("novelty_score")), "mppt")


@query("j13_best_prediction_per_event", "SELECT pred_id, CAST(mppt AS BIGINT) AS mppt, pred_label FROM bestp")
def best_prediction(t):
    return best_preds(t).select("pred_id", "mppt", "pred_label")


@query("t05_event_listing", "SELECT e.plant_id, e.pred_id, rank, b.pred_label AS best_label FROM (SELECT *, row_number() OVER (PARTITION BY plant_id ORDER BY ts_start_utc, pred_id) AS rank FROM pred_events) e JOIN bestp b USING (pred_id)")
def listing(t):
    best = best_preds(t).select("pred_id", F.col("pred_label").alias("best_label"))
    return E.event_listing(t.pred_events, best, P, "pred_id").select("plant_id", "pred_id", "rank", "best_label")


SQL_TABLES["reviews"] = """SELECT pred_id, list_extract(['confirmed', 'dismissed', 'uncertain', 'pending'], CAST(pred_id % 4 + 1 AS INTEGER)) AS rs, CASE WHEN pred_id % 3 = 0 THEN 'grid_overvoltage_trip' WHEN pred_id % 3 = 1 THEN 'unknown' ELSE '' END AS fl FROM pred_events WHERE pred_id % 2 = 0"""
SQL_TABLES["reviewed"] = """SELECT e.pred_id, e.plant_id, pred_label, CASE WHEN rs = 'dismissed' THEN 'dismissed' WHEN rs IN ('confirmed', 'uncertain') THEN 'reviewed' WHEN rs = 'pending' THEN 'open' ELSE e.status END AS status,
   CASE WHEN rs = 'dismissed' THEN 'dismissed' WHEN rs = 'confirmed' THEN CASE WHEN fl NOT IN ('', 'unknown') THEN 'known' ELSE 'unknown' END WHEN rs = 'uncertain' THEN 'unknown' ELSE 'pending' END AS known_vs_unknown,
   coalesce(nullif(fl, ''), '') AS final_label, coalesce(rs, CASE e.status WHEN 'dismissed' THEN 'dismissed' WHEN 'reviewed' THEN 'confirmed' ELSE e.status END) AS review_state, rs FROM pred_events e LEFT JOIN reviews r USING (pred_id)"""


def reviewed(t):
    p = F.col("pred_id")
    ev = t.pred_events.withColumns({"known_vs_unknown": F.lit("pending"), "final_label": F.lit(""), "event_label_prelim": F.col("pred_label")})
    rs = F.element_at(F.array(*[F.lit(x) for x in ("confirmed", "dismissed", "uncertain", "pending")]), (p % 4 + 1).cast("int"))
    rev = t.pred_events.filter(p % 2 == 0).select("pred_id", rs.alias("review_state"), F.when(p % 3 == 0, "grid_overvoltage_trip").when(p % 3 == 1, "unknown").otherwise("").alias("final_label"))
    return E.review_events(ev, rev, "pred_id")


@query("d25_apply_reviews", "SELECT pred_id, status, known_vs_unknown, final_label, review_state FROM reviewed")
def apply_reviews(t):
    return reviewed(t).select("pred_id", "status", "known_vs_unknown", "final_label", "review_state")


@query("d25_truth_from_reviews", """SELECT pred_id AS linked_event_id, plant_id, review_state AS truth_state, coalesce(nullif(final_label, ''), pred_label) AS truth_label,
   CASE coalesce(nullif(final_label, ''), pred_label) WHEN 'grid_overvoltage_trip' THEN 'grid_fault' WHEN 'dc_side_partial_loss_probable' THEN 'dc_side_partial_loss' WHEN 'unknown_shutdown_with_sun' THEN 'inverter_shutdown' ELSE coalesce(nullif(final_label, ''), pred_label) END AS truth_group
   FROM reviewed WHERE review_state IN ('confirmed', 'dismissed', 'uncertain')""")
def truth_rows(t):
    return E.truth_from_reviews(reviewed(t), "pred_id").drop("ts_start_utc", "ts_end_utc")


@query("x30_review_state_and_label", "SELECT pred_id, CASE status WHEN 'dismissed' THEN 'dismissed' WHEN 'reviewed' THEN 'confirmed' ELSE 'open' END AS review_state, pred_label AS shown FROM pred_events")
def review_state(t):
    return t.pred_events.select("pred_id", LB.review_state(F.lit(" "), F.col("status")).alias("review_state"), LB.display_label(F.lit(" "), F.col("pred_label")).alias("shown"))


@query("x27_truth_groups", "SELECT plant_id, CASE WHEN truth_state = 'normal' THEN 'normal' ELSE CASE truth_label WHEN 'grid_overvoltage_trip' THEN 'grid_fault' WHEN 'dc_side_partial_loss_probable' THEN 'dc_side_partial_loss' ELSE truth_label END END AS truth_group, count(*) AS n FROM truth_events GROUP BY 1, 2")
def truth_groups(t):
    return t.truth_events.groupBy("plant_id", LB.truth_group(F.col("truth_label"), F.col("truth_state")).alias("truth_group")).agg(F.count(F.lit(1)).alias("n"))


@query("t01_top_bins_per_plant", "SELECT plant_id, eid, rank FROM (SELECT plant_id, eid, row_number() OVER (PARTITION BY plant_id ORDER BY abs(mismatch_rel) DESC, diag_score DESC, ts_15) AS rank FROM diag WHERE anomaly_flag) WHERE rank <= 30")
def top_bins(t):
    c = F.col
    return K.rank_rows(t.diag.filter("anomaly_flag"), P, [F.abs("mismatch_rel").desc(), c("diag_score").desc(), c("ts_15")], 30).select("plant_id", "eid", "rank")
