"""Source kinds, dominant sources, plant totals and dimensions."""
from __future__ import annotations

from pyspark.sql import functions as F

from sunloom.config import BucketConfig
from sunloom.functions import values as V
from sunloom.gallery.registry import query
from sunloom.operators import bins, keys as K, totals as TT

P = ["plant_id"]

NAMES_SQL = """names AS (SELECT DISTINCT source_oper FROM (SELECT source_oper FROM by_source UNION ALL SELECT ' ' || p_brand || '|agg ' FROM part
   UNION ALL SELECT p_name || ' |mppt ' || p_size || ' x' FROM part UNION ALL SELECT 'MPPT' || p_size FROM part UNION ALL SELECT p_name || '|rest' FROM part))"""


def names(t):
    p = t.raw("part")
    parts = [
        t.by_source.select("source_oper"), p.select(F.concat(F.lit(" "), "p_brand", F.lit("|agg ")).alias("source_oper")),
        p.select(F.concat("p_name", F.lit(" |mppt "), F.col("p_size").cast("string"), F.lit(" x")).alias("source_oper")),
        p.select(F.concat(F.lit("MPPT"), F.col("p_size").cast("string")).alias("source_oper")),
        p.select(F.concat("p_name", F.lit("|rest")).alias("source_oper")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.distinct()


AGG_SQL = "(trim(source_oper) <> '' AND (NOT contains(source_oper, '|') OR upper(trim(source_oper)) LIKE '%|AGG'))"
MPPT_SQL = "contains(upper(source_oper), '|MPPT')"


@query("f06_source_kind", f"WITH {NAMES_SQL} SELECT source_oper, {MPPT_SQL} AS is_mppt, {AGG_SQL} AS is_agg FROM names")
def source_kind(t):
    return names(t).select("source_oper", K.is_mppt("source_oper").alias("is_mppt"), K.is_agg("source_oper").alias("is_agg"))


@query("f07_source_root_and_base",
       f"WITH {NAMES_SQL} SELECT source_oper, trim(split_part(trim(source_oper), '|', 1)) AS root, "
       "trim(regexp_replace(regexp_replace(trim(source_oper), '\\|[Mm][Pp][Pp][Tt].*$', ''), '\\|[Aa][Gg][Gg]$', '')) AS base FROM names")
def source_root(t):
    return names(t).select("source_oper", K.root("source_oper").alias("root"), K.base("source_oper").alias("base"))


@query("f07_canonical_source",
       f"""WITH k AS (SELECT plant_id, CASE WHEN source_oper = 'INV01' AND plant_id % 2 = 1 THEN 'INV01|MPPT11' ELSE source_oper END AS source_oper, count(*) AS n FROM by_source GROUP BY 1, 2)
       SELECT plant_id, coalesce(arg_min(source_oper, n * 100 + length(source_oper)) FILTER ({AGG_SQL}), split_part(arg_min(source_oper, n * 100 + length(source_oper)), '|', 1)) AS canonical_source
       FROM k GROUP BY 1""")
def canonical(t):
    # odd plants have no plain source: theirs goes by the name of a tracker
    name = F.when((F.col("source_oper") == "INV01") & (F.col("plant_id") % 2 == 1), "INV01|MPPT11").otherwise(F.col("source_oper"))
    k = t.by_source.groupBy("plant_id", name.alias("source_oper")).agg(F.count(F.lit(1)).alias("n"))
    return K.canonical_source(k, P, "source_oper", F.col("n") * 100 + F.length("source_oper"))


@query("f08_tracker_number",
       f"WITH {NAMES_SQL} SELECT source_oper, TRY_CAST(nullif(regexp_extract(upper(source_oper), '(?:^|\\|)MPPT\\s*([0-9]+)\\b', 1), '') AS BIGINT) AS mppt FROM names")
def tracker_number(t):
    return names(t).select("source_oper", K.mppt_number("source_oper").alias("mppt"))


@query("f09_active_sources",
       """SELECT plant_id, ts_15, source_oper, coalesce(p_dc_w > 1, false) OR coalesce(i_dc_a > 0.25, false) AS active,
          coalesce(abs(p_dc_w) > 1, false) OR coalesce(abs(p_ac_w) > 1, false) OR coalesce(abs(i_dc_a) > 0.2 AND abs(v_dc_v) > 1, false) AS effectively_active FROM by_source""")
def active(t):
    c = F.col
    return t.by_source.select("plant_id", "ts_15", "source_oper", TT.active_dc(c("p_dc_w"), c("i_dc_a")).alias("active"),
                              TT.effectively_active(c("p_dc_w"), c("p_ac_w"), c("i_dc_a"), c("v_dc_v")).alias("effectively_active"))


@query("f10_useful_bins",
       """SELECT plant_id, count(*) FILTER (NOT flag_inv_missing AND (coalesce(inv_coverage > 0, false) OR p_ac_w IS NOT NULL)) AS useful, count(*) AS bins FROM merged GROUP BY 1""")
def useful(t):
    m = t.merged
    return m.groupBy("plant_id").agg(F.count_if(TT.useful_merged(m)).alias("useful"), F.count(F.lit(1)).alias("bins"))


@query("f15_reference_row_by_priority",
       """SELECT plant_id, ts_15, arg_min(source_oper, rk) AS source_oper, arg_min(p_ac_w, rk) AS p_ac_w FROM
          (SELECT *, CASE source_oper WHEN 'INV01|MPPT2' THEN '0' WHEN 'INV01|AGG' THEN '1' ELSE '9' END || source_oper AS rk FROM by_source) GROUP BY 1, 2""",
       ["p_ac_w"])
def reference_row(t):
    rank = V.lookup(F.col("source_oper"), {"INV01|MPPT2": 0, "INV01|AGG": 1})
    return TT.reference_row(t.by_source, P, "ts_15", rank, ["p_ac_w"])


@query("a07_dominant_source_pair",
       """SELECT plant_id, source_oper, n_rows FROM (SELECT plant_id, source_oper, count(*) AS n_rows, row_number() OVER (PARTITION BY plant_id ORDER BY count(*) DESC, source_oper) AS rn
          FROM by_source GROUP BY 1, 2) WHERE rn = 1""")
def dominant_source(t):
    return K.dominant(t.by_source, P, ["source_oper"])


@query("a07_dominant_operation_source",
       f"""WITH n AS (SELECT plant_id, CASE WHEN plant_id % 2 = 0 OR {MPPT_SQL} THEN source_oper ELSE 'INV01|MPPT9' END AS source_oper, count(*) AS n FROM by_source GROUP BY 1, 2),
           r AS (SELECT *, row_number() OVER (PARTITION BY plant_id ORDER BY {AGG_SQL} DESC, n DESC, source_oper) AS rn FROM n)
           SELECT plant_id, CASE WHEN {AGG_SQL} THEN source_oper ELSE split_part(source_oper, '|', 1) END AS source_oper FROM r WHERE rn = 1""")
def dominant_operation(t):
    # odd plants have trackers only
    name = F.when((F.col("plant_id") % 2 == 0) | K.is_mppt("source_oper"), F.col("source_oper")).otherwise("INV01|MPPT9")
    return K.dominant_operation_source(t.by_source.withColumn("source_oper", name), P)


@query("a08_latest_source_pair",
       """SELECT plant_id, source_oper, source_meteo FROM (SELECT plant_id, source_oper, 'M' || (hour(ts_15) % 3) AS source_meteo,
          row_number() OVER (PARTITION BY plant_id ORDER BY ts_15 DESC, source_oper) AS rn FROM by_source) WHERE rn = 1""")
def latest_pair(t):
    return TT.latest_sources(t.by_source.withColumn("source_meteo", F.concat(F.lit("M"), F.hour("ts_15") % 3)))


@query("a09_plant_from_trackers",
       f"""WITH m AS (SELECT * FROM by_source WHERE {MPPT_SQL})
       SELECT plant_id, ts_15, 'INV01|AGG' AS source_oper, sum(p_ac_w) AS p_ac_w, sum(p_dc_w) AS p_dc_w, sum(i_dc_a) AS i_dc_a, avg(v_dc_v) AS v_dc_v,
       arg_min(v_ac_v, source_oper) AS v_ac_v, arg_min(i_ac_a, source_oper) FILTER (i_ac_a IS NOT NULL) AS i_ac_a, arg_min(ghi, source_oper) AS ghi,
       bool_and(flag_inv_missing) AS flag_inv_missing FROM m GROUP BY 1, 2""",
       ["p_ac_w", "p_dc_w", "i_dc_a", "v_dc_v", "v_ac_v", "i_ac_a", "ghi"])
def from_trackers(t):
    return TT.plant_from_trackers(t.by_source).select(
        "plant_id", "ts_15", "source_oper", "p_ac_w", "p_dc_w", "i_dc_a", "v_dc_v", "v_ac_v", "i_ac_a", "ghi", "flag_inv_missing")


LEVELS = f"""lv AS (SELECT *, CASE WHEN {MPPT_SQL} THEN 2 WHEN {AGG_SQL} THEN 1 ELSE 0 END AS lv,
  (coalesce(p_dc_w > 1, false) OR coalesce(i_dc_a > 0.25, false)) AND v_dc_v > 0 AS act,
  coalesce(abs(p_dc_w) > 1, false) OR coalesce(abs(p_ac_w) > 1, false) OR coalesce(abs(i_dc_a) > 0.2 AND abs(v_dc_v) > 1, false) AS busy FROM by_source),
  ch AS (SELECT *, max(lv) OVER (PARTITION BY plant_id, ts_15) AS top FROM lv)"""
POLICY = "CASE max(top) WHEN 2 THEN 'mppt_sum' WHEN 1 THEN 'agg_fallback' ELSE 'any_fallback' END AS policy_used"


@query("a10_runtime_plant_total",
       f"""WITH {LEVELS} SELECT plant_id, ts_15, count(*) AS n_sources, {POLICY},
       coalesce(sum(p_ac_w) FILTER (lv = 2), sum(p_ac_w) FILTER (lv = 1), sum(p_ac_w) FILTER (lv = top)) AS p_ac_w, sum(p_dc_w) FILTER (lv = top) AS p_dc_w,
       coalesce(avg(v_dc_v) FILTER (lv = top AND act), avg(v_dc_v) FILTER (lv = top)) AS v_dc_v, sum(i_dc_a) FILTER (lv = top) AS i_dc_a,
       CASE WHEN count(*) FILTER (lv = 1) > 0 THEN avg(v_ac_v) FILTER (lv = 1) ELSE avg(v_ac_v) FILTER (lv = top) END AS v_ac_v,
       CASE WHEN count(*) FILTER (lv = 1) > 0 THEN avg(freq_hz) FILTER (lv = 1) ELSE avg(freq_hz) FILTER (lv = top) END AS freq_hz,
       coalesce((arg_min({{'v': i_ac_a}}, source_oper) FILTER (lv = 1)).v, arg_min(i_ac_a, source_oper) FILTER (lv = top AND i_ac_a IS NOT NULL)) AS i_ac_a,
       avg(inv_coverage) FILTER (lv = top) AS inv_coverage, bool_and(flag_inv_missing) FILTER (lv = top) AS flag_inv_missing_all,
       bool_or(flag_inv_missing) FILTER (lv = top) AND NOT bool_and(flag_inv_missing) FILTER (lv = top) AS flag_inv_missing_partial,
       arg_min(ghi, source_oper) AS ghi FROM ch GROUP BY 1, 2""",
       ["p_ac_w", "p_dc_w", "v_dc_v", "i_dc_a", "v_ac_v", "freq_hz", "i_ac_a", "inv_coverage", "ghi"])
def runtime_total(t):
    return TT.plant_totals(t.by_source).drop("e_ac_wh_15", "p_ac_mppt_sum_w", "p_ac_agg_w", "active_n")


@query("a11_summary_plant_total",
       f"""WITH {LEVELS} SELECT plant_id, ts_15, {POLICY}, sum(p_ac_w) FILTER (lv = top) AS p_ac_w, avg(v_dc_v) FILTER (lv = top) AS v_dc_v,
       avg(v_ac_v) FILTER (lv = top) AS v_ac_v, sum(i_ac_a) FILTER (lv = top) AS i_ac_a, sum(p_ac_w) FILTER (lv = 1) AS p_ac_agg_w,
       sum(e_ac_wh_15) FILTER (lv = top) AS e_ac_wh_15 FROM ch GROUP BY 1, 2""",
       ["p_ac_w", "v_dc_v", "v_ac_v", "i_ac_a", "p_ac_agg_w", "e_ac_wh_15"])
def summary_total(t):
    return TT.plant_totals(t.by_source, style="summary").select(
        "plant_id", "ts_15", "policy_used", "p_ac_w", "v_dc_v", "v_ac_v", "i_ac_a", "p_ac_agg_w", "e_ac_wh_15")


@query("a12_snapshot_plant_total",
       f"""WITH {LEVELS} SELECT plant_id, ts_15, {POLICY}, sum(p_ac_w) FILTER (lv = top) AS p_ac_w,
       CASE WHEN count(*) FILTER (lv = top AND busy) > 0 THEN avg(v_dc_v) FILTER (lv = top AND busy AND abs(v_dc_v) > 1e-9) ELSE avg(v_dc_v) FILTER (lv = top AND abs(v_dc_v) > 1e-9) END AS v_dc_v,
       CASE WHEN count(*) FILTER (lv = top AND busy) > 0 THEN sum(i_dc_a) FILTER (lv = top AND busy) ELSE sum(i_dc_a) FILTER (lv = top) END AS i_dc_a,
       avg(v_ac_v) FILTER (lv = top AND abs(v_ac_v) > 1e-9) AS v_ac_v, avg(i_ac_a) FILTER (lv = top AND abs(i_ac_a) > 1e-9) AS i_ac_a,
       count(*) FILTER (lv = top AND busy) AS active_n FROM ch GROUP BY 1, 2""",
       ["p_ac_w", "v_dc_v", "i_dc_a", "v_ac_v", "i_ac_a"])
def snapshot_total(t):
    return TT.plant_totals(t.by_source, style="snapshot").select(
        "plant_id", "ts_15", "policy_used", "p_ac_w", "v_dc_v", "i_dc_a", "v_ac_v", "i_ac_a", "active_n")


@query("a13_plant_kpis",
       """SELECT plant_id, coalesce(sum(e_ac_wh_15), 0) / 1000 AS energy_kwh, sum(greatest(pac_model_w, 0) * 0.25) / 1000 AS energy_model_kwh,
       max(p_ac_w) AS p_ac_max_w, max(ghi) AS ghi_max_wm2, avg(inv_coverage) AS inv_coverage_mean, avg(flag_meteo_missing::INT) AS meteo_missing_frac,
       avg(flag_inv_missing::INT) AS inv_missing_frac, avg(flag_low_coverage::INT) AS inv_partial_missing_frac, count(*) AS points FROM bin_state GROUP BY 1""",
       ["energy_kwh", "energy_model_kwh", "p_ac_max_w", "ghi_max_wm2", "inv_coverage_mean", "meteo_missing_frac", "inv_missing_frac", "inv_partial_missing_frac"])
def plant_kpis(t):
    b = t.bin_state.withColumns({"flag_inv_missing_all": F.col("flag_inv_missing"), "flag_inv_missing_partial": F.col("flag_low_coverage")})
    return TT.kpis(b)


@query("a14_null_aware_aggregates",
       """SELECT plant_id, user_id, sum(alarm_code)::DOUBLE AS code_sum, avg(alarm_code) AS code_mean, avg(i_dc_a) FILTER (abs(i_dc_a) > 1e-9) AS idc_mean_nonzero,
       max(abs(i_dc_a - 4)) AS idc_max_abs, arg_min(alarm_code, event_id) FILTER (alarm_code IS NOT NULL)::DOUBLE AS first_code FROM telemetry GROUP BY 1, 2""",
       ["code_sum", "code_mean", "idc_mean_nonzero", "idc_max_abs", "first_code"])
def null_aware(t):
    return t.telemetry.groupBy("plant_id", "user_id").agg(
        V.sum_or_null(F.col("alarm_code").cast("double")).alias("code_sum"), F.avg("alarm_code").alias("code_mean"),
        V.mean_nonzero(F.col("i_dc_a")).alias("idc_mean_nonzero"), F.max(F.abs(F.col("i_dc_a") - 4)).alias("idc_max_abs"),
        V.first_by(F.col("alarm_code").cast("double"), F.col("event_id")).alias("first_code"))


@query("a16_device_inventory", "SELECT plant_id, device_key, count(*) AS n_rows FROM telemetry GROUP BY 1, 2")
def inventory(t):
    return TT.device_inventory(t.telemetry, P)


@query("a33_plant_topology",
       """WITH c AS (SELECT p_partkey // 8 AS plant_id, p_partkey % 4 + 1 AS mppt, p_size % 5 + 1 AS strings_qty, p_size // 30 + 10 AS modules_per_string FROM part)
       SELECT plant_id, CAST(sum(strings_qty) AS BIGINT) AS strings_count, CAST(sum(strings_qty * modules_per_string) AS BIGINT) AS modules_total,
       CASE WHEN count(DISTINCT modules_per_string) = 1 THEN min(modules_per_string) END AS modules_per_string FROM c GROUP BY 1""", longs=["modules_per_string"])
def topology(t):
    return TT.topology(string_configs(t))


def string_configs(t):
    p = t.raw("part")
    k, z = F.col("p_partkey"), F.col("p_size").cast("long")
    return p.select(F.floor(k / 8).alias("plant_id"), (k % 4 + 1).alias("mppt"), (z % 5 + 1).alias("strings_qty"),
                    (F.floor(z / 30) + 10).alias("modules_per_string"))


@query("a34_tracker_nominals",
       """WITH c AS (SELECT p_partkey // 8 AS plant_id, p_partkey % 4 + 1 AS mppt, p_size % 5 + 1 AS strings_qty, p_size // 30 + 10 AS modules_per_string FROM part),
       l AS (SELECT plant_id, mppt, modules_per_string AS n_series, row_number() OVER (PARTITION BY plant_id, mppt ORDER BY count(*) DESC, modules_per_string) AS rn FROM c GROUP BY 1, 2, 3)
       SELECT plant_id, mppt, CAST(sum(strings_qty) AS BIGINT) AS n_parallel, CAST(n_series AS BIGINT) AS n_series FROM c JOIN l USING (plant_id, mppt) WHERE rn = 1 GROUP BY ALL""")
def nominals(t):
    return TT.tracker_nominals(string_configs(t))


@query("j11_plant_dimension_lookup",
       """WITH c AS (SELECT p_partkey // 8 AS plant_id, p_partkey % 4 + 1 AS mppt, p_size % 5 + 1 AS strings_qty, p_size // 30 + 10 AS modules_per_string FROM part)
       SELECT e.plant_id, e.mppt, len(g.groups) AS n_groups, CAST(list_sum(g.groups) AS BIGINT) AS n_parallel, s_name FROM
       (SELECT DISTINCT plant_id, mppt FROM c) e JOIN (SELECT plant_id, mppt, list(strings_qty) AS groups FROM c GROUP BY 1, 2) g USING (plant_id, mppt) LEFT JOIN supplier ON s_suppkey = plant_id""")
def dimension(t):
    c = string_configs(t)
    plants = t.raw("supplier").select(F.col("s_suppkey").alias("plant_id"), "s_name")
    out = TT.with_plant(TT.string_groups(c), plants)
    total = F.aggregate("groups", F.lit(0).cast("long"), lambda a, x: a + x["np"])
    return out.select("plant_id", "mppt", F.size("groups").alias("n_groups"), total.alias("n_parallel"), "s_name")


@query("a37_availability_range",
       """SELECT plant_id, min(ts_15) AS ts_min, max(ts_15) AS ts_max, string_agg(DISTINCT source_oper, ',' ORDER BY source_oper) AS source_oper_list,
       max(ts_15) - INTERVAL 7 DAY AS default_start FROM by_source GROUP BY 1""")
def availability(t):
    return TT.availability(t.by_source, P, distinct=["source_oper"])


#: column names of the sources that the tables have
SHORT_NAMES = {"INV01": "inv01", "INV01|AGG": "agg", **{f"INV01|MPPT{k}": f"mppt{k}" for k in range(1, 5)}}


@query("u04_sources_side_by_side",
       "SELECT plant_id, ts_15, " + ", ".join(f"max(p_ac_w) FILTER (source_oper = '{s}') AS {n}" for s, n in SHORT_NAMES.items()) + " FROM by_source GROUP BY 1, 2",
       list(SHORT_NAMES.values()))
def side_by_side(t):
    return TT.side_by_side(t.by_source, P, SHORT_NAMES, "p_ac_w")


@query("u05_tracker_block",
       "SELECT plant_id, ts_15, " + ", ".join(
           f"max({c}) FILTER (source_oper = 'INV01|MPPT{k}') AS mppt{k}_{o}" for k in range(1, 9)
           for c, o in (("p_ac_w", "pac_w"), ("p_dc_w", "pdc_w"), ("v_dc_v", "vdc_v"), ("i_dc_a", "idc_a")))
       + f" FROM by_source WHERE {MPPT_SQL} GROUP BY 1, 2",
       [f"mppt{k}_{o}" for k in range(1, 9) for o in ("pac_w", "pdc_w", "vdc_v", "idc_a")])
def tracker_block(t):
    return TT.tracker_block(t.by_source, P, trackers=range(1, 9))  # the columns of the twin


@query("u07_observed_trackers",
       """SELECT plant_id, coalesce(max(CASE WHEN eid % 7 = 0 AND plant_id % 3 = 0 THEN 4 WHEN plant_id % 2 = 0 AND eid % 7 <> 0 THEN 2 END), 0)::BIGINT AS n_mppt FROM power_15 GROUP BY 1""")
def observed(t):
    p = bins.bucket_power(t.telemetry, P, BucketConfig(mean_cols=("v_dc_v",)), extra={"eid": F.min("event_id")})
    e, pid, v = F.col("eid"), F.col("plant_id"), F.col("v_dc_v")
    p = p.withColumns(
        {"mppt1_vdc_v": F.lit(None).cast("double"), "mppt2_vdc_v": F.when((pid % 2 == 0) & (e % 7 != 0), v),
         "mppt3_vdc_v": F.lit(None).cast("double"), "mppt4_idc_a": F.when((e % 7 == 0) & (pid % 3 == 0), v)})
    return TT.observed_trackers(p, P).select("plant_id", "n_mppt")


@query("j10_match_device_keys")
def match_devices(t):
    devices = t.telemetry.select("plant_id", "device_key").distinct().withColumn("device_order", F.regexp_extract("device_key", "([0-9]+)", 1).cast("int"))
    sources = t.telemetry.select("plant_id", F.concat(F.lit("Inv-"), F.lower("device_key")).alias("source_oper")).distinct()
    return K.match_device_keys(sources, devices, P)


@query("x32_first_available_series",
       "SELECT plant_id, ts_15, coalesce(alarm_code, alarm_sev, inv_n)::DOUBLE AS v FROM merged", ["v"])
def first_available(t):
    return t.merged.select("plant_id", "ts_15", F.coalesce("alarm_code", "alarm_sev", "inv_n").cast("double").alias("v"))


@query("d22_fill_dc_expectation",
       f"""WITH m AS (SELECT plant_id, ts_15, avg(v_dc_v + 1) AS v, sum(i_dc_a * 2) AS i FROM by_source WHERE {MPPT_SQL} AND (coalesce(p_dc_w > 1, false) OR coalesce(i_dc_a > 0.2, false)) GROUP BY 1, 2)
       SELECT p.plant_id, p.ts_15, coalesce(CASE WHEN inv_n > 1 THEN p.v_dc_v END, m.v) AS v_dc_model_v, coalesce(CASE WHEN eid % 2 = 0 THEN p.i_dc_a END, m.i) AS i_dc_model_a
       FROM power_15 p LEFT JOIN m ON m.plant_id = p.plant_id AND m.ts_15 = p.ts_15""", ["v_dc_model_v", "i_dc_model_a"])
def fill_expectation(t):
    p = bins.bucket_power(t.telemetry, P, extra={"eid": F.min("event_id")})
    plant = p.select("plant_id", "ts_15", F.when(F.col("inv_n") > 1, F.col("v_dc_v")).alias("v_dc_model_v"),
                     F.when(F.col("eid") % 2 == 0, F.col("i_dc_a")).alias("i_dc_model_a"))
    tr = t.by_source.filter(K.is_mppt("source_oper")).withColumns({"v_dc_model_v": F.col("v_dc_v") + 1, "i_dc_model_a": F.col("i_dc_a") * 2})
    return TT.fill_dc_model(plant, tr, P)
