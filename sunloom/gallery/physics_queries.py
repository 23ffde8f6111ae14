"""Sun geometry, plant parameters, expected output, lag estimation and time shift."""
from __future__ import annotations

from pyspark.sql import functions as F

from sunloom.functions import solar as SO
from sunloom.gallery.fixtures import SQL_TABLES
from sunloom.gallery.registry import query
from sunloom.operators import power as PW, series as S

SER = S.Series(("plant_id",), "ts_15")
P = ["plant_id"]

SQL_TABLES["sun0"] = "SELECT plant_id, ts_utc, ghi, -20.0::DOUBLE + plant_id % 5 AS lat, -45.0::DOUBLE + plant_id % 7 AS lon, (hour(ts_utc) * 3600 + minute(ts_utc) * 60) / 3600.0::DOUBLE AS h, dayofyear(ts_utc) AS doy FROM weather"
SQL_TABLES["sun1"] = "SELECT *, (doy - 1 + (h - 12) / 24) * (2 * pi() / 365) AS g FROM sun0"
SQL_TABLES["sun2"] = """SELECT *, 229.18::DOUBLE * (0.000075::DOUBLE + 0.001868::DOUBLE * cos(g) - 0.032077::DOUBLE * sin(g) - 0.014615::DOUBLE * cos(2 * g) - 0.040849::DOUBLE * sin(2 * g)) AS eqt,
   0.006918::DOUBLE - 0.399912::DOUBLE * cos(g) + 0.070257::DOUBLE * sin(g) - 0.006758::DOUBLE * cos(2 * g) + 0.000907::DOUBLE * sin(2 * g) - 0.002697::DOUBLE * cos(3 * g) + 0.00148::DOUBLE * sin(3 * g) AS de FROM sun1"""
SQL_TABLES["sun3"] = "SELECT *, radians(((h * 60 + eqt + 4 * lon) % 1440 + 1440) % 1440 / 4 - 180) AS ha, radians(lat) AS ph FROM sun2"
SQL_TABLES["sun4"] = "SELECT *, acos(greatest(least(sin(ph) * sin(de) + cos(ph) * cos(de) * cos(ha), 1), -1)) AS zen FROM sun3"
SQL_TABLES["sun5"] = "SELECT *, (degrees(atan2(-sin(ha) * cos(de) / greatest(sin(zen), 1e-12), (sin(de) - sin(ph) * cos(zen)) / (cos(ph) * greatest(sin(zen), 1e-12)))) + 360) % 360 AS az FROM sun4"
SQL_TABLES["sun6"] = "SELECT *, 1367.0::DOUBLE * (1 + 0.033::DOUBLE * cos(2 * pi() * doy / 365)) * greatest(cos(zen), 0) AS g0 FROM sun5"
SQL_TABLES["sun7"] = "SELECT *, CASE WHEN ghi IS NOT NULL THEN greatest(least(ghi / greatest(g0, 1), 2), 0) END AS kt FROM sun6"
SQL_TABLES["sun8"] = """SELECT *, CASE WHEN kt <= 0.22 THEN 1 - 0.09::DOUBLE * kt WHEN kt <= 0.8 THEN greatest(least(0.9511::DOUBLE + kt * (-0.1604::DOUBLE + kt * (4.388::DOUBLE + kt * (-16.638::DOUBLE + kt * 12.336::DOUBLE))), 1), 0) WHEN kt IS NOT NULL THEN 0.165::DOUBLE END AS kd FROM sun7"""


def sun(t):
    w = t.weather.withColumns({"lat": -20.0 + (F.col("plant_id") % 5), "lon": -45.0 + (F.col("plant_id") % 7)})
    zen, az = SO.sun_angles(F.col("ts_utc"), F.col("lat"), F.col("lon"))
    return w.withColumns({"zenith": zen, "azimuth": az})


@query("x17_sun_position", "SELECT plant_id, ts_utc, degrees(zen) AS zenith, az AS azimuth FROM sun5", ["zenith", "azimuth"])
def position(t):
    return sun(t).select("plant_id", "ts_utc", "zenith", "azimuth")


@query("x18_diffuse_split", "SELECT plant_id, ts_utc, g0, kd FROM sun8", ["g0", "kd"])
def diffuse(t):
    from sunloom.functions.values import clamp

    g0 = SO.extraterrestrial(F.col("ts_utc"), F.col("zenith"))
    kt = clamp(F.col("ghi") / F.greatest(g0, F.lit(1.0)), 0.0, 2.0)
    return sun(t).select("plant_id", "ts_utc", g0.alias("g0"), SO.diffuse_fraction(kt).alias("kd"))


@query("x19_tilted_irradiance",
       """SELECT plant_id, ts_utc, CASE WHEN cos(zen) > 0 THEN CASE WHEN ghi IS NOT NULL THEN greatest(0, greatest((ghi - kd * ghi) / greatest(cos(zen), 0.065), 0) * greatest(sin(zen) * sin(radians(20)) * cos(radians(az) - radians(10)) + cos(zen) * cos(radians(20)), 0)
          + kd * ghi * (1 + cos(radians(20))) / 2 + ghi * 0.2::DOUBLE * (1 - cos(radians(20))) / 2) END ELSE 0 END AS g_poa FROM sun8""", ["g_poa"])
def tilted(t):
    c = F.col
    g = SO.tilted_irradiance(c("ghi"), c("zenith"), c("azimuth"), c("ts_utc"), F.lit(20.0), F.lit(10.0))
    return sun(t).select("plant_id", "ts_utc", g.alias("g_poa"))


@query("x20_cell_temperature", "SELECT plant_id, ts_15, CASE WHEN g_poa IS NOT NULL AND temp_air IS NOT NULL THEN greatest(least(greatest(temp_air + greatest(g_poa, 0) / 800 * 25, temp_air), 95), -30) END AS tcell_c FROM bin_state", ["tcell_c"])
def cell(t):
    return t.bin_state.select("plant_id", "ts_15", SO.cell_temperature(F.col("g_poa"), F.col("temp_air")).alias("tcell_c"))


@query("x21_inverter_efficiency",
       """SELECT plant_id, ts_15, CASE WHEN greatest(coalesce(p_dc_w, 0) - 20, 0) <= 0 THEN 0 ELSE greatest(least(0.92::DOUBLE + (0.985::DOUBLE - 0.92::DOUBLE) * (1 - exp(-6 * (greatest(coalesce(p_dc_w, 0) - 20, 0) / 1500))), 0.985), 0) END AS eta FROM bin_state""", ["eta"])
def efficiency(t):
    n = F.lit
    return t.bin_state.select("plant_id", "ts_15", SO.inverter_efficiency(F.col("p_dc_w"), n(0.985), n(0.92), n(6.0), n(20.0), n(1500.0)).alias("eta"))


@query("x22_operating_ratios",
       """SELECT plant_id, ts_15, v_dc_v / 330 AS v_ratio, i_dc_a / 6 AS i_ratio, v_dc_v * i_dc_a / 1980 AS p_ratio, (v_dc_v / 400) * (i_dc_a / 9) / 0.75 AS ff_ratio FROM bin_state""", ["v_ratio", "i_ratio", "p_ratio", "ff_ratio"])
def ratios(t):
    v, i, n = F.col("v_dc_v"), F.col("i_dc_a"), F.lit
    r = SO.operating_ratios(v, i, n(330.0), n(6.0))
    return t.bin_state.select("plant_id", "ts_15", *[e.alias(k) for k, e in r.items()], SO.fill_factor_ratio(v, i, n(400.0), n(9.0), n(0.75)).alias("ff_ratio"))


@query("x23_clear_sky_index", "SELECT plant_id, ts_15, CASE WHEN ghi IS NOT NULL AND gti IS NOT NULL THEN greatest(least(gti / greatest(ghi, 1), 2), 0) END AS csi FROM bin_state", ["csi"])
def clear(t):
    return t.bin_state.select("plant_id", "ts_15", SO.clear_sky_index(F.col("gti"), F.col("ghi")).alias("csi"))


def plant_plates(t):
    """One nameplate per plant from the suppliers (fixed module, sizes vary with the plant)."""
    k = F.col("s_suppkey")
    d = lambda x: F.lit(x).cast("decimal(10,4)")
    return t.raw("supplier").select(
        k.alias("plant_id"), d(9.2).alias("isc_a"), d(46.0).alias("voc_v"), d(37.5).alias("vmp_v"), d(8.7).alias("imp_a"), F.lit(72).alias("num_celulas"),
        d(-0.31).alias("temp_coeff_voc_pct_c"), d(0.05).alias("temp_coeff_isc_pct_c"), d(0.35).alias("rs_ohm"), d(350.0).alias("rp_ohm"),
        F.when(k % 2 == 0, d(1.2)).alias("diode_a"), (k % 3 + 1).alias("strings_count"), F.lit(18).alias("modules_per_string"), F.lit(None).cast("int").alias("modules_total"),
        F.when(k % 4 != 0, d(5000.0) * (k % 3 + 1)).alias("p_ac_nom_w"), F.when(k % 5 != 0, d(97.5)).alias("eficiencia_max_pct"), F.when(k % 3 == 0, d(96.0)).alias("eficiencia_euro_pct"),
    )


@query("x29_plant_parameters",
       """SELECT s_suppkey AS plant_id, CAST((s_suppkey % 3 + 1) * 18 AS DOUBLE) AS n_modules, 46.0 * -0.31 / 100 AS kv, CASE WHEN s_suppkey % 2 = 0 THEN 1.2 ELSE 1.3 END AS a, CASE WHEN s_suppkey % 5 <> 0 THEN 0.975 ELSE 0.985 END AS eta_max,
          CASE WHEN s_suppkey % 3 = 0 THEN 0.93 ELSE 0.92 END AS eta_min, CASE WHEN s_suppkey % 4 <> 0 THEN 5000.0 * (s_suppkey % 3 + 1) / CASE WHEN s_suppkey % 5 <> 0 THEN 0.975 ELSE 0.985 END END AS pdc_nom_w, 0.9 AS k_sys FROM supplier""", ["n_modules", "kv", "a", "eta_max", "eta_min", "pdc_nom_w", "k_sys"])
def parameters(t):
    return PW.plant_parameters(plant_plates(t)).select("plant_id", "n_modules", "kv", "a", "eta_max", "eta_min", "pdc_nom_w", "k_sys")


# the one-diode circuit of every bin: the nameplate above, in SQL
SQL_TABLES["plates"] = """SELECT s_suppkey AS plant_id, CASE WHEN s_suppkey % 2 = 0 THEN 1.2e0 ELSE 1.3e0 END AS a, s_suppkey % 3 + 1 AS strings, (s_suppkey % 3 + 1) * 18 AS n_modules,
   CASE WHEN s_suppkey % 4 <> 0 THEN 5000e0 * (s_suppkey % 3 + 1) END AS rated, CASE WHEN s_suppkey % 5 <> 0 THEN 0.975e0 ELSE 0.985e0 END AS eta_max,
   CASE WHEN s_suppkey % 3 = 0 THEN 0.93e0 ELSE 0.92e0 END AS eta_min FROM supplier"""
SQL_TABLES["circuit0"] = """SELECT b.plant_id, b.ts_15, b.p_ac_w, b.v_dc_v, b.i_dc_a, greatest(b.g_poa, 0e0) AS g, p.* EXCLUDE (plant_id), p.a * 72 * (1.380649e-23 / 1.602176634e-19) AS per_kelvin,
   CASE WHEN b.g_poa IS NOT NULL AND b.temp_air IS NOT NULL THEN greatest(least(greatest(b.temp_air + greatest(b.g_poa, 0) / 800 * 25, b.temp_air), 95), -30) END AS tc FROM bin_state b JOIN plates p ON p.plant_id = b.plant_id"""
SQL_TABLES["circuit1"] = """SELECT *, exp(46e0 / (per_kelvin * 298.15e0)) AS e_open, exp(9.2e0 * 0.35e0 / (per_kelvin * 298.15e0)) AS e_short, tc + 273.15e0 AS kelvin FROM circuit0"""
SQL_TABLES["circuit2"] = """SELECT *, greatest((9.2e0 - (46e0 - 9.2e0 * 0.35e0) / 350) / greatest(e_open - e_short, 1e-12), 1e-16) AS sat_ref FROM circuit1"""
SQL_TABLES["circuit3"] = """SELECT *, greatest((greatest(sat_ref * (e_open - 1) + 46e0 / 350, 0) + 9.2e0 * 0.05e0 / 100 * (tc - 25)) * g / 1000, 0) AS photo,
   greatest(sat_ref * pow(kelvin / 298.15e0, 3) * exp(1.121e0 * 1.602176634e-19 / 1.380649e-23 / a * (1 / 298.15e0 - 1 / kelvin)), 1e-16) AS sat, 350000e0 / greatest(g, 50) AS shunt, per_kelvin * kelvin AS vt FROM circuit2 WHERE tc IS NOT NULL AND g IS NOT NULL"""


def lambert_sql(x: str) -> str:
    """w with w + ln w = x by Newton's steps."""
    return f"list_reduce([CASE WHEN {x} > 1 THEN {x} - ln(greatest({x}, 1)) ELSE exp(least({x}, 1)) / (1 + exp(least({x}, 1))) END, 0, 0, 0, 0, 0, 0, 0, 0], lambda w, e: w * (1 + {x} - ln(w)) / (1 + w))"


def current_sql(source: str, volts: str, name: str) -> str:
    """Rows of `source` with the current at a voltage."""
    return (
        f"SELECT * EXCLUDE (x, lam), greatest(least((shunt * (photo + sat) - {volts}) / (0.35e0 + shunt) - vt / 0.35e0 * lam, photo), 0) AS {name} FROM (SELECT *, {lambert_sql('x')} AS lam FROM ("
        f"SELECT *, ln(0.35e0 * shunt * sat / (vt * (0.35e0 + shunt))) + (0.35e0 * shunt * (photo + sat) + shunt * {volts}) / (vt * (0.35e0 + shunt)) AS x FROM {source}))"
    )


SQL_TABLES["circuit4"] = f"SELECT * EXCLUDE (x, lam), greatest(shunt * (photo + sat) - vt * lam, 0.1) AS voc FROM (SELECT *, {lambert_sql('x')} AS lam FROM (SELECT *, ln(sat * shunt / vt) + shunt * (photo + sat) / vt AS x FROM circuit3))"
SQL_TABLES["curve0"] = "SELECT c.*, k, voc * (k / 59e0) AS v FROM circuit4 c, (SELECT unnest(range(0, 60)) AS k) z WHERE g > 0"
SQL_TABLES["curve1"] = current_sql("curve0", "v", "i")
SQL_TABLES["peak"] = "SELECT plant_id, ts_15, max(v * i) AS p, arg_max(v, (v * i, -k)) AS v, arg_max(i, (v * i, -k)) AS i FROM curve1 GROUP BY 1, 2"
SQL_TABLES["expected0"] = """SELECT c.*, tc IS NOT NULL AS valid, n_modules * 37.5e0 * 8.7e0 AS stc, coalesce(p.p, 0) * n_modules * 0.9e0 AS p_dc, CASE WHEN tc IS NOT NULL THEN coalesce(p.v, 0) * 18 END AS v_exp, CASE WHEN tc IS NOT NULL THEN coalesce(p.i, 0) * strings END AS i_exp
   FROM circuit0 c LEFT JOIN peak p ON p.plant_id = c.plant_id AND p.ts_15 = c.ts_15"""
SQL_TABLES["expected1"] = """SELECT *, CASE WHEN p_dc <= 20 THEN 0 ELSE greatest(least(eta_min + (eta_max - eta_min) * (1 - exp(-6 * ((p_dc - 20) / greatest(coalesce(rated / greatest(eta_max, 0.8), 1), 1)))), eta_max), 0) END AS eta FROM expected0"""
SQL_TABLES["expected2"] = """SELECT *, CASE WHEN NOT valid THEN 0 ELSE least(greatest(p_dc - 20, 0) * eta, coalesce(rated, 1e300)) END AS p_ac FROM expected1"""


def expected(t):
    return PW.expected_state(t.bin_state.drop("mismatch_rel").join(PW.plant_parameters(plant_plates(t)), P))


@query("d03_expected_electrical_state",
       """SELECT plant_id, ts_15, tc AS tcell_c, p_dc AS p_dc_exp_w, p_ac AS p_ac_exp_w, v_exp AS v_dc_exp_v, i_exp AS i_dc_exp_a, eta AS eta_inv, CASE WHEN valid THEN (p_ac_w - p_ac) / greatest(abs(p_ac), 50) END AS mismatch_rel,
            CASE WHEN valid THEN v_dc_v / greatest(v_exp, 1) END AS v_ratio, CASE WHEN valid THEN i_dc_a / greatest(i_exp, 0.1) END AS i_ratio, CASE WHEN valid THEN p_ac / greatest(stc * g / 1000, 1) END AS pr_model, valid FROM expected2""",
       ["tcell_c", "p_dc_exp_w", "p_ac_exp_w", "v_dc_exp_v", "i_dc_exp_a", "eta_inv", "mismatch_rel", "v_ratio", "i_ratio", "pr_model"])
def expected_state(t):
    return expected(t).select("plant_id", "ts_15", "tcell_c", "p_dc_exp_w", "p_ac_exp_w", "v_dc_exp_v", "i_dc_exp_a", "eta_inv", "mismatch_rel", "v_ratio", "i_ratio", "pr_model", "valid")


SQL_TABLES["string0"] = f"SELECT c.*, k, z.top * (1e-4 + k * ((1 - 2e-4) / 59)) AS v, z.top FROM (SELECT *, voc * 18 AS top FROM circuit4) z JOIN circuit4 c ON c.plant_id = z.plant_id AND c.ts_15 = z.ts_15, (SELECT unnest(range(0, 60)) AS k)"
SQL_TABLES["string1"] = current_sql("string0", "(v / 18)", "i18")
SQL_TABLES["string2"] = current_sql("string1", "(v / 16)", "i16")
SQL_TABLES["string3"] = "SELECT *, 2 * i18 + plant_id % 2 * i16 AS i FROM string2"
SQL_TABLES["string_peak"] = "SELECT plant_id, ts_15, max(v * i) AS p, arg_max(v, (v * i, -k)) AS v, arg_max(i, (v * i, -k)) AS i, max(top) AS top FROM string3 GROUP BY 1, 2"
SQL_TABLES["short_circuit"] = current_sql("circuit4", "0e0", "i0")


@query("d04_expected_dc_by_tracker",
       """SELECT b.plant_id, b.ts_15, mppt, p * 0.9e0 AS pdc_expected_w, v AS v_dc_model_v, i AS i_dc_model_a, top AS voc_array_v, (2 + b.plant_id % 2) * i0 AS isc_array_a
          FROM circuit0 b LEFT JOIN string_peak s ON s.plant_id = b.plant_id AND s.ts_15 = b.ts_15 LEFT JOIN short_circuit c ON c.plant_id = b.plant_id AND c.ts_15 = b.ts_15, (SELECT unnest([1, 2]) AS mppt)""",
       ["pdc_expected_w", "v_dc_model_v", "i_dc_model_a", "voc_array_v", "isc_array_a"], longs=["mppt"])
def by_tracker(t):
    k = F.col("plant_id")
    pair = lambda n, m: F.named_struct(F.lit("np"), n, F.lit("ns"), m)
    groups = PW.plant_parameters(plant_plates(t)).select(
        "plant_id", *PW.MODULE_COLS, "k_sys", "noct_c", F.explode(F.array(F.lit(1), F.lit(2))).alias("mppt"),
        F.array(pair(F.lit(2), F.lit(18)), pair((k % 2).cast("int"), F.lit(16))).alias("groups"))
    out = PW.expected_by_tracker(t.bin_state.select("plant_id", "ts_15", "g_poa", "temp_air"), groups)
    return out.select("plant_id", "ts_15", "mppt", "pdc_expected_w", "v_dc_model_v", "i_dc_model_a", "voc_array_v", "isc_array_a")


@query("w14_median_step",
       """SELECT plant_id, coalesce(quantile_cont(g, 0.5), 15) AS dt_minutes FROM (SELECT plant_id, (epoch(ts_15) - epoch(lag(ts_15) OVER (PARTITION BY plant_id ORDER BY ts_15))) / 60 AS g FROM power_15) GROUP BY 1""", ["dt_minutes"])
def step(t):
    from sunloom.operators import bins

    return PW.median_step_minutes(bins.bucket_power(t.telemetry, P), SER)


SQL_TABLES["lag0"] = "SELECT plant_id, ts_15, g_poa, row_number() OVER (PARTITION BY plant_id ORDER BY ts_15) AS rn, 2 * " + "CASE plant_id % 4 WHEN 0 THEN g_poa " + " ".join(f"WHEN {k} THEN lag(g_poa, {k}) OVER (PARTITION BY plant_id ORDER BY ts_15)" for k in (1, 2, 3)) + " END AS y FROM bin_state"
SQL_TABLES["lag1"] = "SELECT plant_id, rn, CASE WHEN rn >= 2 THEN avg(y) OVER w END AS y, CASE WHEN rn >= 2 THEN avg(g_poa) OVER w END AS g FROM lag0 WINDOW w AS (PARTITION BY plant_id ORDER BY rn ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)"
SQL_TABLES["lag2"] = "SELECT *, coalesce(g >= 50, false) OR coalesce(y >= 0.02 * max(y) OVER (PARTITION BY plant_id), false) AS dy FROM lag1"
SQL_TABLES["lag3"] = "SELECT plant_id, rn, CASE WHEN dy THEN y END AS x, CASE WHEN dy THEN g END AS l, avg(CASE WHEN dy THEN y END) OVER w AS mx, stddev_pop(CASE WHEN dy THEN y END) OVER w AS sx, avg(CASE WHEN dy THEN g END) OVER w AS ml, stddev_pop(CASE WHEN dy THEN g END) OVER w AS sl FROM lag2 WINDOW w AS (PARTITION BY plant_id)"
SQL_TABLES["lag4"] = "SELECT a.plant_id, s, avg((a.x - a.mx) / a.sx * ((b.l - b.ml) / b.sl)) AS r, count(*) AS n FROM lag3 a JOIN (SELECT unnest(range(-6, 7)) AS s) z ON true JOIN lag3 b ON b.plant_id = a.plant_id AND b.rn = a.rn - s WHERE a.x IS NOT NULL AND b.l IS NOT NULL GROUP BY 1, 2"


@query("w15_lag_estimation", "SELECT plant_id, arg_max(s, (r, -s)) FILTER (n >= 40) AS lag_steps, max(r) FILTER (n >= 40) AS correlation FROM lag4 GROUP BY 1", ["correlation"])
def lag(t):
    s = S.blocks(t.bin_state, SER, before=4)
    p = F.col("plant_id") % 4
    late = F.when(p == 0, F.col("g_poa"))
    for k in (1, 2, 3):
        late = late.when(p == k, F.lag("g_poa", k).over(SER.blocked))
    d = S.without_marks(S.core(s.withColumn("y", late * 2)))
    return PW.best_lag(d, SER, "y", "g_poa").select("plant_id", "lag_steps", "correlation")


@query("w16_time_shift",
       """WITH p AS (SELECT plant_id, ts_utc, ghi, ts_utc + to_seconds(CAST((plant_id % 5 - 2) * 450 AS BIGINT)) AS at FROM weather), k AS (SELECT plant_id, ts_utc AS kt, ghi AS kv FROM weather WHERE ghi IS NOT NULL),
       q AS (SELECT plant_id, ts_utc, ts_utc - to_seconds(CAST((plant_id % 5 - 2) * 450 AS BIGINT)) AS tq FROM weather)
       SELECT q.plant_id, q.ts_utc, CASE WHEN b.kt = a.kt THEN a.kv ELSE a.kv + (b.kv - a.kv) * (epoch(tq) - epoch(a.kt)) / (epoch(b.kt) - epoch(a.kt)) END AS shifted
       FROM q ASOF LEFT JOIN k a ON a.plant_id = q.plant_id AND a.kt <= q.tq ASOF LEFT JOIN k b ON b.plant_id = q.plant_id AND b.kt >= q.tq""", ["shifted"])
def shift(t):
    s = S.Series(("plant_id",), "ts_utc")
    w = t.weather.withColumn("m", (F.col("plant_id") % 5 - 2) * 7.5)
    return PW.shift_series(w, s, "ghi", "m", "shifted").select("plant_id", "ts_utc", "shifted")
