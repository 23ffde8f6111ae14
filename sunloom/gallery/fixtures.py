"""Domain-shaped tables derived from the driver's parquet, once for Spark and once as SQL.

Numbers are kept on binary fractions so that sums do not depend on the order of addition, and one
plant (0) holds a third of all telemetry.  Plants and sources grow with the user base.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sunloom.config import BucketConfig
from sunloom.functions import timegrid as tg
from sunloom.operators import bins

LABELS = ("ok", "persistent_underperformance", "grid_overvoltage_trip", "dc_side_partial_loss_probable",
          "unknown_shutdown_with_sun", "curtailment_clipping", "invalid", "dc_shading_soiling_probable")


def pick(index: Column, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(index, F.lit(len(names))) + 1).cast("int"))


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def samples(self) -> DataFrame:
        e = self.raw("events")
        plant = F.when(F.col("user_id") % 3 == 0, F.lit(0)).otherwise(1 + F.floor(F.col("user_id") / 20))
        return e.select(
            plant.cast("long").alias("plant_id"), "user_id", "event_id", "event_type",
            F.col("ts").cast("timestamp").alias("ts_utc"), "value", "props",
        )

    @property
    def telemetry(self) -> DataFrame:
        eid = F.col("event_id")
        err = F.col("event_type") == "error"
        return self.samples.select(
            "plant_id", F.concat(F.lit("DEV"), F.col("user_id") % 12).alias("device_key"), "ts_utc",
            F.floor(F.col("value") * 20).cast("double").alias("p_ac_w"),
            F.floor(F.col("value") * 21).cast("double").alias("p_dc_w"),
            (300 + eid % 50).cast("double").alias("v_dc_v"), ((eid % 17).cast("double") / 2).alias("i_dc_a"),
            (218 + eid % 9).cast("double").alias("v_ac_v"), (F.lit(49.5) + (eid % 5).cast("double") / 4).alias("freq_hz"),
            F.when(err, eid % 7).alias("alarm_code"), F.when(err, eid % 4).alias("alarm_sev"),
            "event_id", "user_id",
        )

    @property
    def ranges(self) -> DataFrame:
        """Whole days covered by each plant's telemetry."""
        day = lambda c: F.date_trunc("day", c)
        return self.samples.groupBy("plant_id").agg(
            day(F.min("ts_utc")).alias("range_start"),
            (day(F.max("ts_utc")) + F.expr("INTERVAL 1 DAY")).alias("range_end"),
        )

    @property
    def weather(self) -> DataFrame:
        g = bins.grid_of(self.ranges, "range_start", "range_end", "ts_utc")
        q = (F.floor(tg.minute_of_day(F.col("ts_utc")) / 15)).cast("long")
        d = F.dayofmonth("ts_utc").cast("long")
        g = g.withColumns({"q": q, "d": d})
        q, d, p = F.col("q"), F.col("d"), F.col("plant_id")
        x = (q - 48).cast("double") / 32.0
        raw = F.greatest(F.lit(0.0), 900.0 * (1.0 - x * x)) * (1.0 - ((d * 7 + q + p) % 5).cast("double") / F.when(d % 3 == 0, 16.0).otherwise(256.0))
        g = g.withColumn("ghi", F.when((d * 96 + q + p) % 97 != 0, raw))
        ghi = F.col("ghi")
        seen = lambda c: F.when(ghi.isNotNull(), c)
        return g.withColumns(
            {
                "dni": ghi * 0.75, "dhi": ghi * 0.25, "gti": F.when((q + d) % 11 != 0, ghi * 1.125),
                "temp_air": seen(15.0 + ghi / 64.0), "wind_speed": seen((q % 8).cast("double") / 2.0),
                "rh": seen(40.0 + (q % 30).cast("double")), "pressure": seen(101000.0 + q.cast("double")),
                "meteo_qc_score": F.lit(1.0) - F.when(q % 4 == 0, 0.25).otherwise(0.0)
                - F.when(d % 3 == 0, 0.125).otherwise(0.0),
                "flag_meteo_low_confidence": (q % 13 == 0) & (d % 3 == 0),
                "flag_meteo_interpolated": d % 4 == 0,
                "flag_meteo_outlier": (q + d) % 29 == 0,
                "flag_meteo_artifact": (q * d) % 31 == 0,
            }
        )

    @property
    def merged(self) -> DataFrame:
        power = bins.bucket_power(
            self.telemetry, ["plant_id"], BucketConfig(),
            extra={"alarm_code": F.max("alarm_code"), "alarm_sev": F.max("alarm_sev"), "eid": F.min("event_id")},
        )
        w = self.weather.withColumnRenamed("ts_utc", "ts_15")
        out = bins.join_weather(power, w, ["plant_id"], "right")
        return out.withColumns({"source_oper": F.lit("INV01"), "source_meteo": F.lit("OPENMETEO")})

    @property
    def bin_state(self) -> DataFrame:
        """Merged bins with an expected output, residual channels and their confidences."""
        m = self.merged
        g = F.coalesce("gti", "ghi")
        m = m.withColumns({"g_poa": g, "pac_model_w": F.greatest(g, F.lit(0.0)) * 1.25})
        model = F.col("pac_model_w")
        rel = lambda o, e: (F.col(o) - e) / F.greatest(F.abs(e), F.lit(50.0))
        mq = (F.col("q") % 5).cast("double")
        return m.withColumns(
            {
                "valid_model": model.isNotNull() & (F.col("g_poa") >= 50.0),
                "mismatch_rel": rel("p_ac_w", model), "r_p_dc": rel("p_dc_w", model * 1.0625),
                "r_v_dc": rel("v_dc_v", F.lit(320.0)), "r_i_dc": rel("i_dc_a", model / 256.0),
                "c_p_ac": F.when(F.col("q") % 7 != 0, 1.0 - mq / 8.0), "c_p_dc": F.lit(0.75),
                "c_v_dc": mq / 4.0, "c_i_dc": F.when(F.col("q") % 6 != 0, F.lit(0.5)),
            }
        )

    @property
    def by_source(self) -> DataFrame:
        """Bins of plain, aggregate and per-tracker sources side by side."""
        k = F.col("event_id") % 6
        src = F.when(k == 0, "INV01").when(k == 1, "INV01|AGG").otherwise(F.concat(F.lit("INV01|MPPT"), k - 1))
        t = self.telemetry.withColumn("source_oper", src)
        return t.groupBy("plant_id", tg.floor_to("ts_utc").alias("ts_15"), "source_oper").agg(
            F.avg("p_ac_w").alias("p_ac_w"), F.avg("p_dc_w").alias("p_dc_w"), F.avg("v_dc_v").alias("v_dc_v"),
            F.avg("i_dc_a").alias("i_dc_a"), F.avg("v_ac_v").alias("v_ac_v"), F.avg("freq_hz").alias("freq_hz"),
            F.avg(F.when(F.col("event_id") % 5 != 0, F.col("i_dc_a") * 4)).alias("i_ac_a"),
            (F.sum("p_ac_w") / 4).alias("e_ac_wh_15"), F.least(F.count(F.lit(1)) / 2, F.lit(1.0)).alias("inv_coverage"),
            F.min(F.col("event_id") % 10 == 0).alias("flag_inv_missing"),
            F.max("p_dc_w").alias("ghi"),
        )

    @property
    def diag(self) -> DataFrame:
        """Diagnosed bins, one row per plant and quarter-hour with samples."""
        t = self.telemetry.groupBy("plant_id", tg.floor_to("ts_utc").alias("ts_15")).agg(
            F.min("event_id").alias("eid"), F.max("p_ac_w").alias("pac_real_w")
        )
        e = F.col("eid")
        t = t.withColumns(
            {
                "source_oper": F.lit("INV01"), "source_meteo": F.lit("OPENMETEO"), "detector_version": F.lit("v1"),
                "anomaly_flag": e % 3 != 0, "diagnosis_label": pick(e, LABELS),
                "domain_label": pick(e, ("operational", "grid", "dc_side", "unknown")),
                "state_label": pick(e, ("injecting_normal", "injecting_degraded", "sun_available_not_injecting")),
                "irradiance_tier": pick(e, ("A", "B", "C", "N")),
                "mismatch_rel": (e % 33 - 16).cast("double") / 16.0,
                "pac_model_w": F.when(e % 19 != 0, F.lit(1000.0) + (e % 64).cast("double")),
                "detector_score": (e % 80).cast("double") / 8.0,
                "g_poa": F.when(e % 23 != 0, (e % 1000).cast("double")),
                "meteo_quality_ok": e % 2 == 0,
                "valid_period": e % 10 != 0,
                "data_score": (e % 9).cast("double") / 8.0,
                "detect_score": F.when(e % 14 != 0, (e % 17).cast("double") / 16.0),
                "diag_score": (e % 13).cast("double") / 16.0,
            }
        )
        return t

    @property
    def pred_events(self) -> DataFrame:
        e = F.col("event_id")
        start = tg.floor_to("ts_utc")
        return self.samples.filter(F.col("event_type") == "error").select(
            e.alias("pred_id"), "plant_id", F.concat(F.lit("S"), F.col("user_id")).alias("source_oper"),
            start.alias("ts_start_utc"), tg.plus_seconds(start, (e % 40) * 900).alias("ts_end_utc"),
            pick(e, LABELS[1:5]).alias("pred_label"), pick(e, ("open", "reviewed", "dismissed")).alias("status"),
        )

    @property
    def truth_events(self) -> DataFrame:
        e = F.col("event_id")
        start = tg.floor_to("ts_utc")
        return self.samples.filter(F.col("event_type") == "purchase").select(
            e.alias("truth_id"), "plant_id", F.concat(F.lit("S"), F.col("user_id")).alias("source_oper"),
            start.alias("ts_start_utc"), tg.plus_seconds(start, (e % 30) * 900).alias("ts_end_utc"),
            pick(e, ("confirmed", "confirmed", "confirmed", "normal", "confirmed", "uncertain", "confirmed", "dismissed")).alias("truth_state"),
            pick(e, LABELS[1:4]).alias("truth_label"), F.when(e % 25 == 0, e - 1).alias("linked_pred_id"),
        )


def _sql_pick(index: str, names: tuple[str, ...]) -> str:
    return "list_extract([" + ", ".join(f"'{n}'" for n in names) + f"], CAST({index} % {len(names)} + 1 AS INTEGER))"


SQL_TABLES = {
    "samples": "SELECT CASE WHEN user_id % 3 = 0 THEN 0 ELSE 1 + user_id // 20 END AS plant_id, user_id, event_id, "
               "event_type, ts AS ts_utc, value, props FROM events",
    "telemetry": "SELECT plant_id, 'DEV' || (user_id % 12) AS device_key, ts_utc, floor(value * 20) AS p_ac_w, "
                 "floor(value * 21) AS p_dc_w, CAST(300 + event_id % 50 AS DOUBLE) AS v_dc_v, "
                 "CAST(event_id % 17 AS DOUBLE) / 2 AS i_dc_a, CAST(218 + event_id % 9 AS DOUBLE) AS v_ac_v, "
                 "49.5::DOUBLE + CAST(event_id % 5 AS DOUBLE) / 4 AS freq_hz, "
                 "CASE WHEN event_type = 'error' THEN event_id % 7 END AS alarm_code, "
                 "CASE WHEN event_type = 'error' THEN event_id % 4 END AS alarm_sev, event_id, user_id FROM samples",
    "plant_ranges": "SELECT plant_id, date_trunc('day', min(ts_utc))::TIMESTAMP AS range_start, "
                    "date_trunc('day', max(ts_utc))::TIMESTAMP + INTERVAL 1 DAY AS range_end FROM samples GROUP BY plant_id",
    "full_grid": "SELECT plant_id, unnest(generate_series(range_start, range_end - INTERVAL 15 MINUTE, INTERVAL 15 MINUTE)) AS ts_15 FROM plant_ranges",
    "weather0": "SELECT plant_id, ts_15 AS ts_utc, CAST((hour(ts_15) * 60 + minute(ts_15)) // 15 AS BIGINT) AS q, "
                "CAST(day(ts_15) AS BIGINT) AS d FROM full_grid",
    "weather1": "SELECT *, CASE WHEN (d * 96 + q + plant_id) % 97 <> 0 THEN greatest(0.0::DOUBLE, 900.0::DOUBLE * (1.0::DOUBLE - "
                "(CAST(q - 48 AS DOUBLE) / 32.0::DOUBLE) * (CAST(q - 48 AS DOUBLE) / 32.0::DOUBLE))) * "
                "(1.0::DOUBLE - CAST((d * 7 + q + plant_id) % 5 AS DOUBLE) / CASE WHEN d % 3 = 0 THEN 16.0::DOUBLE ELSE 256.0::DOUBLE END) END AS ghi FROM weather0",
    "weather": "SELECT *, ghi * 0.75::DOUBLE AS dni, ghi * 0.25::DOUBLE AS dhi, CASE WHEN (q + d) % 11 <> 0 THEN ghi * 1.125::DOUBLE END AS gti, "
               "15.0::DOUBLE + ghi / 64.0::DOUBLE AS temp_air, CASE WHEN ghi IS NOT NULL THEN CAST(q % 8 AS DOUBLE) / 2 END AS wind_speed, "
               "CASE WHEN ghi IS NOT NULL THEN 40.0::DOUBLE + CAST(q % 30 AS DOUBLE) END AS rh, "
               "CASE WHEN ghi IS NOT NULL THEN 101000.0::DOUBLE + CAST(q AS DOUBLE) END AS pressure, "
               "1.0::DOUBLE - CASE WHEN q % 4 = 0 THEN 0.25::DOUBLE ELSE 0 END - CASE WHEN d % 3 = 0 THEN 0.125::DOUBLE ELSE 0 END AS meteo_qc_score, "
               "(q % 13 = 0) AND (d % 3 = 0) AS flag_meteo_low_confidence, d % 4 = 0 AS flag_meteo_interpolated, "
               "(q + d) % 29 = 0 AS flag_meteo_outlier, (q * d) % 31 = 0 AS flag_meteo_artifact FROM weather1",
    "power_15": "SELECT plant_id, time_bucket(INTERVAL 15 MINUTE, ts_utc) AS ts_15, avg(p_ac_w) AS p_ac_w, avg(p_dc_w) AS p_dc_w, "
                "avg(v_dc_v) AS v_dc_v, avg(i_dc_a) AS i_dc_a, avg(v_ac_v) AS v_ac_v, avg(freq_hz) AS freq_hz, "
                "sum(p_ac_w * (5.0::DOUBLE / 60.0::DOUBLE)) AS e_ac_wh_15, count(*) AS inv_n, max(alarm_code) AS alarm_code, "
                "max(alarm_sev) AS alarm_sev, min(event_id) AS eid, least(count(*) / 3.0::DOUBLE, 1.0::DOUBLE) AS inv_coverage "
                "FROM telemetry GROUP BY 1, 2",
    "merged": "SELECT w.plant_id, w.ts_utc AS ts_15, w.* EXCLUDE (plant_id, ts_utc), p_ac_w, p_dc_w, v_dc_v, i_dc_a, v_ac_v, freq_hz, "
              "e_ac_wh_15, alarm_code, alarm_sev, eid, coalesce(inv_n, 0) AS inv_n, inv_coverage, inv_n IS NULL AS flag_inv_missing, "
              "coalesce(inv_coverage < 0.7, false) AS flag_low_coverage, ghi IS NULL AS flag_meteo_missing, "
              "'INV01' AS source_oper, 'OPENMETEO' AS source_meteo "
              "FROM weather w LEFT JOIN power_15 p ON p.plant_id = w.plant_id AND p.ts_15 = w.ts_utc",
    "bin_state0": "SELECT *, coalesce(gti, ghi) AS g_poa, greatest(coalesce(gti, ghi), 0.0::DOUBLE) * 1.25::DOUBLE AS pm0 FROM merged",
    "bin_state1": "SELECT * EXCLUDE (pm0), CASE WHEN g_poa IS NULL THEN NULL ELSE pm0 END AS pm1 FROM bin_state0",
    "bin_state": "SELECT * EXCLUDE (pm1), coalesce(pm1, 0.0::DOUBLE) AS pac_model_w, g_poa IS NOT NULL AND g_poa >= 50 AS valid_model, "
                 "(p_ac_w - coalesce(pm1, 0)) / greatest(abs(coalesce(pm1, 0)), 50.0::DOUBLE) AS mismatch_rel, "
                 "(p_dc_w - coalesce(pm1, 0) * 1.0625::DOUBLE) / greatest(abs(coalesce(pm1, 0) * 1.0625::DOUBLE), 50.0::DOUBLE) AS r_p_dc, "
                 "(v_dc_v - 320.0::DOUBLE) / 320.0::DOUBLE AS r_v_dc, "
                 "(i_dc_a - coalesce(pm1, 0) / 256.0::DOUBLE) / greatest(abs(coalesce(pm1, 0) / 256.0::DOUBLE), 50.0::DOUBLE) AS r_i_dc, "
                 "CASE WHEN q % 7 <> 0 THEN 1.0::DOUBLE - CAST(q % 5 AS DOUBLE) / 8.0::DOUBLE END AS c_p_ac, 0.75::DOUBLE AS c_p_dc, "
                 "CAST(q % 5 AS DOUBLE) / 4.0::DOUBLE AS c_v_dc, CASE WHEN q % 6 <> 0 THEN 0.5::DOUBLE END AS c_i_dc FROM bin_state1",
    "by_source": "SELECT plant_id, time_bucket(INTERVAL 15 MINUTE, ts_utc) AS ts_15, CASE event_id % 6 WHEN 0 THEN 'INV01' WHEN 1 THEN 'INV01|AGG' "
                 "ELSE 'INV01|MPPT' || (event_id % 6 - 1) END AS source_oper, avg(p_ac_w) AS p_ac_w, avg(p_dc_w) AS p_dc_w, "
                 "avg(v_dc_v) AS v_dc_v, avg(i_dc_a) AS i_dc_a, avg(v_ac_v) AS v_ac_v, avg(freq_hz) AS freq_hz, "
                 "avg(CASE WHEN event_id % 5 <> 0 THEN i_dc_a * 4 END) AS i_ac_a, sum(p_ac_w) / 4 AS e_ac_wh_15, "
                 "least(count(*) / 2.0::DOUBLE, 1.0::DOUBLE) AS inv_coverage, bool_and(event_id % 10 = 0) AS flag_inv_missing, max(p_dc_w) AS ghi "
                 "FROM telemetry GROUP BY 1, 2, 3",
    "diag0": "SELECT plant_id, time_bucket(INTERVAL 15 MINUTE, ts_utc) AS ts_15, min(event_id) AS eid, max(p_ac_w) AS pac_real_w FROM telemetry GROUP BY 1, 2",
    "diag": "SELECT *, 'INV01' AS source_oper, 'OPENMETEO' AS source_meteo, 'v1' AS detector_version, eid % 3 <> 0 AS anomaly_flag, "
            + _sql_pick("eid", LABELS) + " AS diagnosis_label, "
            + _sql_pick("eid", ("operational", "grid", "dc_side", "unknown")) + " AS domain_label, "
            + _sql_pick("eid", ("injecting_normal", "injecting_degraded", "sun_available_not_injecting")) + " AS state_label, "
            + _sql_pick("eid", ("A", "B", "C", "N")) + " AS irradiance_tier, "
            "CAST(eid % 33 - 16 AS DOUBLE) / 16 AS mismatch_rel, CASE WHEN eid % 19 <> 0 THEN 1000.0::DOUBLE + CAST(eid % 64 AS DOUBLE) END AS pac_model_w, "
            "CAST(eid % 80 AS DOUBLE) / 8 AS detector_score, CASE WHEN eid % 23 <> 0 THEN CAST(eid % 1000 AS DOUBLE) END AS g_poa, "
            "eid % 2 = 0 AS meteo_quality_ok, eid % 10 <> 0 AS valid_period, CAST(eid % 9 AS DOUBLE) / 8 AS data_score, "
            "CASE WHEN eid % 14 <> 0 THEN CAST(eid % 17 AS DOUBLE) / 16 END AS detect_score, CAST(eid % 13 AS DOUBLE) / 16 AS diag_score FROM diag0",
    "pred_events": "SELECT event_id AS pred_id, plant_id, 'S' || user_id AS source_oper, time_bucket(INTERVAL 15 MINUTE, ts_utc) AS ts_start_utc, "
                   "time_bucket(INTERVAL 15 MINUTE, ts_utc) + to_minutes(CAST(event_id % 40 AS BIGINT) * 15) AS ts_end_utc, "
                   + _sql_pick("event_id", LABELS[1:5]) + " AS pred_label, " + _sql_pick("event_id", ("open", "reviewed", "dismissed"))
                   + " AS status FROM samples WHERE event_type = 'error'",
    "truth_events": "SELECT event_id AS truth_id, plant_id, 'S' || user_id AS source_oper, time_bucket(INTERVAL 15 MINUTE, ts_utc) AS ts_start_utc, "
                    "time_bucket(INTERVAL 15 MINUTE, ts_utc) + to_minutes(CAST(event_id % 30 AS BIGINT) * 15) AS ts_end_utc, "
                    + _sql_pick("event_id", ("confirmed", "confirmed", "confirmed", "normal", "confirmed", "uncertain", "confirmed", "dismissed"))
                    + " AS truth_state, " + _sql_pick("event_id", LABELS[1:4])
                    + " AS truth_label, CASE WHEN event_id % 25 = 0 THEN event_id - 1 END AS linked_pred_id FROM samples WHERE event_type = 'purchase'",
}
