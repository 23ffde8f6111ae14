"""Buckets, weather join, complete grids and coverage."""
from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from sunloom.config import BucketConfig, WeatherConfig
from sunloom.functions import timegrid as tg
from sunloom.gallery.registry import query
from sunloom.operators import bins
from sunloom.operators.series import Series

P15 = ["p_ac_w", "p_dc_w", "v_dc_v", "i_dc_a", "v_ac_v", "freq_hz", "e_ac_wh_15", "inv_coverage"]
WX = ["ghi", "dni", "dhi", "gti", "temp_air", "wind_speed", "rh", "pressure", "meteo_qc_score"]


@query(
    "a01_bucket_power",
    """SELECT plant_id, device_key, time_bucket(INTERVAL 15 MINUTE, ts_utc) AS ts_15, avg(p_ac_w) AS p_ac_w, avg(p_dc_w) AS p_dc_w,
       avg(v_dc_v) AS v_dc_v, avg(i_dc_a) AS i_dc_a, avg(v_ac_v) AS v_ac_v, avg(freq_hz) AS freq_hz,
       sum(p_ac_w * (5.0::DOUBLE / 60)) AS e_ac_wh_15, count(*) AS inv_n, least(count(*) / 3.0::DOUBLE, 1) AS inv_coverage,
       false AS flag_inv_missing, count(*) / 3.0 < 0.7 AS flag_low_coverage FROM telemetry GROUP BY 1, 2, 3""",
    P15,
)
def bucket_power(t):
    return bins.bucket_power(t.telemetry, ["plant_id", "device_key"])


@query(
    "a02_energy_to_next_sample",
    """WITH g AS (SELECT *, (epoch_us(lead(ts_utc) OVER w) - epoch_us(ts_utc)) / 3.6e9::DOUBLE AS gap FROM telemetry
         WINDOW w AS (PARTITION BY plant_id, device_key ORDER BY ts_utc, event_id)),
       m AS (SELECT plant_id, device_key, quantile_cont(gap, 0.5) AS med FROM g GROUP BY 1, 2)
       SELECT g.plant_id, g.device_key, time_bucket(INTERVAL 15 MINUTE, ts_utc) AS ts_15, count(*) AS inv_n,
         sum(p_ac_w * greatest(least(coalesce(gap, med, 5.0 / 60), 0.25), 0)) AS e_ac_wh_15
       FROM g JOIN m ON g.plant_id = m.plant_id AND g.device_key = m.device_key GROUP BY 1, 2, 3""",
    ["e_ac_wh_15"],
)
def energy_to_next(t):
    keys = ["plant_id", "device_key"]
    cfg = replace(BucketConfig(mean_cols=()), energy_dt="next")
    out = bins.bucket_power(t.telemetry, keys, cfg, series=Series(tuple(keys), "ts_utc", ("event_id",)))
    return out.select(*keys, "ts_15", "inv_n", "e_ac_wh_15")


WEATHER_SQL = """SELECT plant_id, time_bucket(INTERVAL 15 MINUTE, ts_utc - INTERVAL '{shift}' SECOND) AS ts_15, {aggs},
  min(meteo_qc_score) AS meteo_qc_score, bool_or(flag_meteo_low_confidence) AS flag_meteo_low_confidence,
  bool_or(flag_meteo_interpolated) AS flag_meteo_interpolated, bool_or(flag_meteo_outlier) AS flag_meteo_outlier,
  bool_or(flag_meteo_artifact) AS flag_meteo_artifact FROM weather GROUP BY 1, 2"""


@query("a03_bucket_weather",
       WEATHER_SQL.format(shift=900, aggs=", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in WX[:-1])), WX)
def bucket_weather(t):
    return bins.bucket_weather(t.weather, ["plant_id"], WeatherConfig("period_end", "median"))


@query("a03_bucket_weather_midpoint",
       WEATHER_SQL.format(shift=450, aggs=", ".join(f"arg_min({c}, ts_utc) FILTER ({c} IS NOT NULL) AS {c}" for c in WX[:-1])), WX)
def bucket_weather_midpoint(t):
    return bins.bucket_weather(t.weather, ["plant_id"], WeatherConfig("midpoint", "first"))


@query(
    "a04_hourly_rollup",
    "SELECT plant_id, date_trunc('hour', ts_15)::TIMESTAMP AS ts_hour, avg(p_ac_w) AS p_ac_w, avg(ghi) AS ghi, avg(inv_coverage) AS inv_coverage, "
    "coalesce(sum(e_ac_wh_15), 0) AS e_ac_wh_15, CAST(sum(inv_n) AS BIGINT) AS inv_n, min(meteo_qc_score) AS meteo_qc_score, "
    "bool_or(flag_low_coverage) AS flag_low_coverage, bool_or(flag_inv_missing) AS flag_inv_missing FROM merged GROUP BY 1, 2",
    ["p_ac_w", "ghi", "inv_coverage", "e_ac_wh_15", "meteo_qc_score"],
)
def hourly(t):
    out = bins.rollup_hour(t.merged, ["plant_id"])
    return out.select("plant_id", "ts_hour", "p_ac_w", "ghi", "inv_coverage", "e_ac_wh_15", "inv_n", "meteo_qc_score",
                      "flag_low_coverage", "flag_inv_missing")


@query(
    "a05_merge_statistics",
    """SELECT plant_id, count(*) AS rows, min(ts_15) AS ts_min, max(ts_15) AS ts_max, avg(flag_inv_missing::INT) AS inv_missing_frac,
       avg(flag_meteo_missing::INT) AS meteo_missing_frac, coalesce(avg(inv_coverage), 0) AS inv_coverage_mean,
       avg(flag_low_coverage::INT) AS low_coverage_frac,
       avg((NOT flag_inv_missing AND NOT flag_meteo_missing AND NOT flag_low_coverage)::INT) AS good_frac,
       CAST((epoch(max(ts_15)) - epoch(min(ts_15))) / 900 + 1 AS BIGINT) AS rows_expected FROM merged GROUP BY 1""",
    ["inv_missing_frac", "meteo_missing_frac", "inv_coverage_mean", "low_coverage_frac", "good_frac"],
)
def merge_statistics(t):
    return bins.merge_statistics(t.merged, ["plant_id"])


@query(
    "a06_series_coverage",
    """SELECT r.plant_id, CAST((epoch(range_end) - epoch(range_start)) / 900 AS BIGINT) AS expected, count(p.ts_15) AS existing,
       CAST((epoch(range_end) - epoch(range_start)) / 900 AS BIGINT) - count(p.ts_15) AS missing,
       count(p.ts_15) / ((epoch(range_end) - epoch(range_start)) / 900) * 100 AS pct
       FROM plant_ranges r LEFT JOIN power_15 p USING (plant_id) GROUP BY r.plant_id, range_start, range_end""",
    ["pct"],
)
def series_coverage(t):
    power = bins.bucket_power(t.telemetry, ["plant_id"], BucketConfig(mean_cols=()))
    return bins.coverage(power, t.ranges, ["plant_id"])


@query(
    "j01_outer_join_weather",
    """SELECT coalesce(w.plant_id, p.plant_id) AS plant_id, coalesce(w.ts_15, p.ts_15) AS ts_15, p_ac_w, ghi, coalesce(inv_n, 0) AS inv_n, inv_coverage,
       inv_n IS NULL AS flag_inv_missing, coalesce(inv_coverage < 0.7, false) AS flag_low_coverage, coalesce(ghi, temp_air, pressure) IS NULL AS flag_meteo_missing
       FROM (SELECT plant_id, ts_utc + to_days(CAST(5 + plant_id % 3 AS INTEGER)) AS ts_15, ghi, temp_air, pressure FROM weather) w FULL JOIN power_15 p ON p.plant_id = w.plant_id AND p.ts_15 = w.ts_15""",
    ["p_ac_w", "ghi", "inv_coverage"],
)
def outer_join(t):
    power = bins.bucket_power(t.telemetry, ["plant_id"])
    # the weather begins days later than the power: rows of either side alone, and of both
    w = t.weather.withColumn("ts_15", tg.plus_seconds("ts_utc", (5 + F.col("plant_id") % 3) * 86400)).drop("ts_utc")
    return bins.join_weather(power, w, ["plant_id"], "outer").select(
        "plant_id", "ts_15", "p_ac_w", "ghi", "inv_n", "inv_coverage", "flag_inv_missing", "flag_low_coverage", "flag_meteo_missing"
    )


@query(
    "j02_densify_grid",
    """SELECT plant_id, ts_15, p_ac_w, coalesce(inv_n, 0) AS inv_n, inv_coverage, inv_n IS NULL AS flag_inv_missing,
       coalesce(inv_coverage < 0.7, false) AS flag_low_coverage, true AS flag_meteo_missing
       FROM full_grid LEFT JOIN power_15 USING (plant_id, ts_15)""",
    ["p_ac_w", "inv_coverage"],
)
def densify(t):
    power = bins.bucket_power(t.telemetry, ["plant_id"])
    return bins.densify(power, t.ranges, ["plant_id"]).select(
        "plant_id", "ts_15", "p_ac_w", "inv_n", "inv_coverage", "flag_inv_missing", "flag_low_coverage", "flag_meteo_missing"
    )


@query("j03_fill_on_grid",
       "SELECT plant_id, ts_15, p_ac_w, v_dc_v FROM full_grid LEFT JOIN power_15 USING (plant_id, ts_15)", ["p_ac_w", "v_dc_v"])
def fill_on_grid(t):
    power = bins.bucket_power(t.telemetry, ["plant_id"])
    return bins.fill_on_grid(power, t.ranges, ["plant_id"], ["p_ac_w", "v_dc_v"])


@query("j04_missing_bins", "SELECT plant_id, ts_15 FROM full_grid ANTI JOIN power_15 USING (plant_id, ts_15)")
def missing_bins(t):
    return bins.missing_bins(bins.bucket_power(t.telemetry, ["plant_id"], BucketConfig(mean_cols=())), t.ranges, ["plant_id"])


@query(
    "w11_missing_ranges",
    """WITH gone AS (SELECT plant_id, ts_15, ts_15 - to_minutes(15 * row_number() OVER (PARTITION BY plant_id ORDER BY ts_15)) AS grp
         FROM full_grid ANTI JOIN power_15 USING (plant_id, ts_15))
       SELECT plant_id, min(ts_15) AS gap_start, max(ts_15) AS gap_end, count(*) AS n_bins FROM gone GROUP BY plant_id, grp""",
)
def missing_ranges(t):
    power = bins.bucket_power(t.telemetry, ["plant_id"], BucketConfig(mean_cols=()))
    return bins.missing_ranges(power, t.ranges, ["plant_id"], limit=None)


@query(
    "u03_allocate_to_mppt",
    """WITH s AS (SELECT *, p_dc_w * (eid % 2) / 2 AS p1, p_dc_w * (eid % 3) / 2 AS p2, CASE WHEN eid % 4 <> 0 THEN p_dc_w * (eid % 5) / 4 END AS p3, -1.0::DOUBLE AS p4 FROM power_15),
       tt AS (SELECT *, greatest(p1, 0) + greatest(p2, 0) + coalesce(greatest(p3, 0), 0) AS tot FROM s),
       k AS (SELECT tt.*, unnest([1, 2, 3, 4]) AS mppt FROM tt WHERE tot > 0),
       v AS (SELECT *, CASE mppt WHEN 1 THEN p1 WHEN 2 THEN p2 WHEN 3 THEN p3 ELSE p4 END AS pk FROM k)
       SELECT plant_id, ts_15, 'INV01|MPPT' || mppt AS source_oper, CAST(mppt AS BIGINT) AS mppt, pk AS p_dc_w,
         CASE WHEN pk > 0 THEN p_ac_w * (pk / tot) END AS p_ac_w, CASE WHEN pk > 0 THEN e_ac_wh_15 * (pk / tot) END AS e_ac_wh_15 FROM v
       UNION ALL SELECT plant_id, ts_15, 'INV01', NULL, p_dc_w, p_ac_w, e_ac_wh_15 FROM tt WHERE NOT coalesce(tot > 0, false)""",
    ["p_dc_w", "p_ac_w", "e_ac_wh_15"],
)
def allocate(t):
    power = bins.bucket_power(t.telemetry, ["plant_id"], extra={"eid": F.min("event_id")})
    e, p = F.col("eid"), F.col("p_dc_w")
    wide = power.withColumns(
        {
            "source_oper": F.lit("INV01"), "mppt1_p_dc_w": p * (e % 2) / 2, "mppt2_p_dc_w": p * (e % 3) / 2,
            "mppt3_p_dc_w": F.when(e % 4 != 0, p * (e % 5) / 4), "mppt4_p_dc_w": F.lit(-1.0),
            **{f"mppt{k}_{c}": F.lit(None).cast("double") for k in (1, 2, 3, 4) for c in ("vdc_v", "idc_a")},
        }
    )
    return bins.allocate_to_mppt(wide).select("plant_id", "ts_15", "source_oper", "mppt", "p_dc_w", "p_ac_w", "e_ac_wh_15")


@query(
    "d02_merge_to_quarter_hours",
    """SELECT plant_id, ts_15, p_ac_w, p_dc_w, e_ac_wh_15, inv_n, inv_coverage, flag_inv_missing, flag_low_coverage, flag_meteo_missing,
       ghi, temp_air, meteo_qc_score, flag_meteo_interpolated FROM merged""",
    ["p_ac_w", "p_dc_w", "e_ac_wh_15", "inv_coverage", "ghi", "temp_air", "meteo_qc_score"],
)
def merge(t):
    from sunloom.plans.merge import merge_quarter_hours

    return merge_quarter_hours(t.telemetry, t.weather, t.ranges, ["plant_id"]).select(
        "plant_id", "ts_15", "p_ac_w", "p_dc_w", "e_ac_wh_15", "inv_n", "inv_coverage", "flag_inv_missing", "flag_low_coverage",
        "flag_meteo_missing", "ghi", "temp_air", "meteo_qc_score", "flag_meteo_interpolated",
    )
