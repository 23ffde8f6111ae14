"""Landed payloads, parsing, clock repair, catalogue rules and row-level merges."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sunloom.functions import labels, timegrid as tg, values as V
from sunloom.gallery.registry import query
from sunloom.operators import bins, keys as K
from sunloom.session import checkpoint_ready, stored
from sunloom.sources import landing as L, tables as TB
from sunloom.sources.versions import VersionedTable

P = ["plant_id"]


@query("s01_weather_range",
       "SELECT plant_id, ts_utc, ghi, temp_air FROM weather WHERE ts_utc >= TIMESTAMP '2024-01-05' AND ts_utc < TIMESTAMP '2024-01-12'", ["ghi", "temp_air"])
def weather_range(t):
    lo, hi = (F.lit(d).cast("timestamp") for d in ("2024-01-05", "2024-01-12"))
    return L.in_range(t.weather, lo, hi).select("plant_id", "ts_utc", V.finite("ghi").alias("ghi"), V.finite("temp_air").alias("temp_air"))


def payloads(t):
    """Vendor payloads written from telemetry: localised text, blanks and a shifted clock per plant."""
    e = F.col("event_id")
    comma = lambda c: F.replace(c.cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))
    d = t.telemetry.withColumn("tz", F.when(F.col("plant_id") % 2 == 0, "America/Sao_Paulo").otherwise("UTC"))
    clock = F.from_utc_timestamp("ts_utc", F.col("tz"))
    body = F.to_json(
        F.create_map(
            F.lit("Potência ativa total"), F.when(e % 3 == 0, F.concat(comma(F.col("p_ac_w")), F.lit(" W"))).otherwise(F.col("p_ac_w").cast("decimal(18,2)").cast("string")),
            F.lit("Potência de saída CC"), F.when(e % 4 == 0, "").otherwise(comma(F.col("p_dc_w"))),
            F.lit("Tensão CC MPPT1"), comma(F.col("v_dc_v")), F.lit("Tensão CC MPPT2"), comma(F.col("v_dc_v") + 8),
            F.lit("Corrente CC MPPT1"), comma(F.col("i_dc_a")), F.lit("Corrente CC MPPT2"), F.when(e % 5 == 0, None).otherwise("4.0"),
            F.lit("Tensão de fase R"), comma(F.col("v_ac_v")), F.lit("Tensão de fase S"), F.lit("0,2"),
            F.lit("Corrente de fase A"), F.lit("1,5"), F.lit("Data E Hora"), F.date_format(clock, "yyyy-MM-dd HH:mm:ss"),
        )
    )
    vendor = F.when(e % 11 == 0, "OTHER").otherwise("renovigi")
    return d.select("plant_id", "tz", "ts_utc", "event_id", vendor.alias("provedor"), body.alias("payload"))


X07_SQL = """WITH b AS (SELECT *, event_id % 11 <> 0 AS known, CASE WHEN event_id % 5 <> 0 THEN 4.0::DOUBLE END AS i2 FROM telemetry),
   c AS (SELECT *, CASE WHEN i_dc_a > 0 THEN i_dc_a ELSE 0 END + coalesce(i2, 0) AS isum,
     CASE WHEN i_dc_a > 0 THEN v_dc_v * i_dc_a ELSE 0 END + coalesce((v_dc_v + 8) * i2, 0) AS psum FROM b)
   SELECT plant_id, event_id, ts_utc, CASE WHEN known THEN p_ac_w END AS p_ac_w, CASE WHEN known AND event_id % 4 <> 0 THEN p_dc_w END AS p_dc_w,
     CASE WHEN known AND isum > 0 THEN psum / isum END AS v_dc_v, CASE WHEN known AND isum > 0 THEN isum END AS i_dc_a,
     CASE WHEN known THEN v_ac_v END AS v_ac_v, CASE WHEN known THEN 1.5::DOUBLE END AS i_ac_a,
     CASE WHEN known AND i2 > 0 THEN (v_dc_v + 8) * i2 END AS mppt2_p_dc_w FROM c"""
X07_COLS = ["p_ac_w", "p_dc_w", "v_dc_v", "i_dc_a", "v_ac_v", "i_ac_a", "mppt2_p_dc_w"]


@query("x07_extract_vendor_payload", X07_SQL, X07_COLS)
def extract(t):
    return L.extract_payload(payloads(t)).select("plant_id", "event_id", "ts_utc", *X07_COLS)


@query("s02_scan_telemetry_with_clock_repair",
       f"""WITH x AS ({X07_SQL.replace('WITH b AS', 'WITH b AS', 1)}) SELECT plant_id, event_id, ts_utc, p_ac_w, v_dc_v, 0::BIGINT AS shift_minutes FROM x
       WHERE ts_utc >= TIMESTAMP '2024-01-06' AND ts_utc < TIMESTAMP '2024-01-20'""", ["p_ac_w", "v_dc_v"])
def scan(t):
    lo, hi = (F.lit(d).cast("timestamp") for d in ("2024-01-06", "2024-01-20"))
    return L.scan_telemetry(payloads(t), lo, hi, P).select("plant_id", "event_id", "ts_utc", "p_ac_w", "v_dc_v", "shift_minutes")


@query("x12_repair_clock",
       """WITH s AS (SELECT plant_id, event_id, ts_utc, ts_utc + to_minutes(plant_id % 4 * 20 + event_id % 3) - to_hours(CASE WHEN plant_id % 2 = 1 THEN 3 ELSE 0 END) AS clk FROM telemetry),
       m AS (SELECT plant_id, quantile_cont((epoch_us(date_trunc('second', clk)) - epoch_us(ts_utc)) / 3.6e9::DOUBLE, 0.5) AS mu, quantile_cont(abs((epoch_us(date_trunc('second', clk)) - epoch_us(ts_utc)) / 3.6e9::DOUBLE), 0.5) AS au,
         quantile_cont((epoch_us(date_trunc('second', clk + INTERVAL 3 HOUR)) - epoch_us(ts_utc)) / 3.6e9::DOUBLE, 0.5) AS ml, quantile_cont(abs((epoch_us(date_trunc('second', clk + INTERVAL 3 HOUR)) - epoch_us(ts_utc)) / 3.6e9::DOUBLE), 0.5) AS al FROM s GROUP BY 1),
       k AS (SELECT plant_id, CASE WHEN au <= al THEN 'utc' ELSE 'plant_local' END AS clock_mode, CAST(round_even(CASE WHEN au <= al THEN mu ELSE ml END * 4, 0) * 15 AS BIGINT) AS st FROM m)
       SELECT s.plant_id, event_id, clock_mode, CASE WHEN abs(st) >= 30 THEN st ELSE 0 END AS shift_minutes,
         ts_utc + to_minutes(CASE WHEN abs(st) >= 30 THEN st ELSE 0 END) AS ts_utc FROM s JOIN k USING (plant_id)""")
def repair(t):
    p, e = F.col("plant_id"), F.col("event_id")
    wall = tg.plus_seconds("ts_utc", (p % 4 * 20 + e % 3) * 60 - F.when(p % 2 == 1, 10800).otherwise(0))
    d = t.telemetry.select("plant_id", "event_id", "ts_utc", F.lit("America/Sao_Paulo").alias("tz"),
                           F.date_format(wall, "yyyy-MM-dd HH:mm:ss").alias("payload_time"))
    return L.repair_clock(d, P).select("plant_id", "event_id", "clock_mode", "shift_minutes", "ts_utc")


@query("s03_candidate_key_json",
       """SELECT event_id, json_extract_string(props, '$.k')::DOUBLE AS k, CASE WHEN event_id % 2 = 0 THEN NULL ELSE value END AS v FROM events""", ["k", "v"])
def candidates(t):
    e = t.raw("events").withColumn(
        "data", F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "b": '), F.col("value").cast("string"),
                         F.when(F.col("event_id") % 2 == 0, F.lit(', "a": null}')).otherwise(F.lit("}"))))
    return L.extract_candidates(e, "data", {"k": ["kk", "k"], "v": ["a", "b"]}).select("event_id", "k", "v")


@query("s04_weather_columns_or_json",
       "SELECT plant_id, ts_utc, ghi, NULL::DOUBLE AS gti FROM weather", ["ghi", "gti"])
def weather_either(t):
    w = t.weather.select("plant_id", "ts_utc", F.to_json(F.struct(F.col("ghi").alias("G"), F.lit(1).alias("other"))).alias("data"))
    return L.weather_columns(w, {"ghi": ["ghi_w", "G"], "gti": ["GTI"]}).select("plant_id", "ts_utc", "ghi", "gti")


@query("s05_alias_scan", "SELECT event_id AS id, value AS p_ac_w, NULL::DOUBLE AS v_ac_v FROM events", ["p_ac_w", "v_ac_v"])
def alias_scan(t):
    return V.canonicalise(t.raw("events"), {"id": ["event_id"], "p_ac_w": ["pac", "value", "ts"], "v_ac_v": ["vac"]})


@query("s06_weather_json_blocks",
       "SELECT plant_id, ts_utc, ghi, dhi, temp_air, pressure * 100 AS pressure, NULL::DOUBLE AS gti FROM weather", ["ghi", "dhi", "temp_air", "pressure", "gti"])
def weather_json(t):
    w = t.weather.groupBy("plant_id", F.to_date("ts_utc").alias("day")).agg(
        F.sort_array(F.collect_list(F.struct("ts_utc", "ghi", "dhi", "temp_air", "pressure"))).alias("r"))
    arr = lambda f: F.transform("r", f)
    block = F.struct(
        arr(lambda x: F.date_format(x["ts_utc"], "yyyy-MM-dd'T'HH:mm")).alias("time"), arr(lambda x: x["ghi"]).alias("shortwave_radiation"),
        arr(lambda x: x["dhi"]).alias("diffuse_radiation"), arr(lambda x: x["temp_air"]).alias("temperature_2m"),
        arr(lambda x: x["pressure"]).alias("surface_pressure"))
    landed = w.select("plant_id", F.to_json(F.struct(block.alias("minutely_15")), {"ignoreNullFields": "false"}).alias("payload"))
    return L.weather_blocks(landed).select("plant_id", "ts_utc", "ghi", "dhi", "temp_air", "pressure", "gti")


@query("s07_weather_csv_lines",
       "SELECT CAST(plant_id AS VARCHAR) AS file, ts_utc, ghi, temp_air, NULL::DOUBLE AS rh FROM weather", ["ghi", "temp_air", "rh"])
def weather_csv(t):
    w = t.weather
    f = F.col("plant_id").cast("string").alias("file")
    body = F.concat_ws(",", F.year("ts_utc"), F.month("ts_utc"), F.dayofmonth("ts_utc"), F.hour("ts_utc"), F.minute("ts_utc"),
                       *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("ghi", "temp_air")])
    data = w.select(f, body.alias("value"))
    head = t.ranges.select(f, F.explode(F.array(F.lit("Source,Location ID"), F.lit("NSRDB,12"), F.lit("Year,Month,Day,Hour,Minute,GHI,Air Temperature"))).alias("value"))
    # landed once: tests of a line pushed below its rendering would render it anew for each of them
    return L.csv_lines_to_weather(stored(data.unionByName(head))).select("file", "ts_utc", "ghi", "temp_air", "rh")


@query("s08_vendor_table_payload",
       """SELECT l_orderkey, l_linenumber - 1 AS row_no, CAST(l_partkey AS VARCHAR) AS a, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_suppkey AS VARCHAR) END AS b FROM
          (SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS l_linenumber FROM lineitem)""")
def vendor_table(t):
    li = t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    g = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("r"))
    # every second row has a surplus cell, the others lack one
    cells = F.transform("r", lambda x, i: F.when(
        i % 2 == 1, F.to_json(F.struct(F.array(x["l_partkey"].cast("string"), x["l_suppkey"].cast("string"), F.lit("z")).alias("filed")))
    ).otherwise(F.to_json(F.array(x["l_partkey"].cast("string")))))
    body = F.concat(F.lit('{"title": [{"title": "A "}, "B"], "row": ['), F.array_join(cells, ","), F.lit("]}"))
    out = L.table_payload(g.select("l_orderkey", body.alias("payload")))
    return out.select("l_orderkey", "row_no", F.try_element_at("record", F.lit("A")).alias("a"), F.try_element_at("record", F.lit("B")).alias("b"))


@query("s09_screen_raw_rows",
       """WITH r AS (SELECT event_id, plant_id, device_key, date_trunc('second', ts_utc) AS ts, CASE WHEN event_id % 9 = 0 THEN 'bad' WHEN event_id % 9 = 1 THEN 'late' ELSE 'ok' END AS k, event_id % 50 = 7 AS old FROM telemetry
            UNION ALL SELECT event_id + 1000000000, plant_id, device_key, date_trunc('second', ts_utc), 'ok', false FROM telemetry WHERE event_id % 6 = 2),
       o AS (SELECT DISTINCT plant_id, device_key, ts FROM r WHERE old),
       f AS (SELECT r.*, row_number() OVER (PARTITION BY plant_id, device_key, ts, k = 'ok' ORDER BY event_id) AS rn, o.ts IS NOT NULL AS known FROM r LEFT JOIN o USING (plant_id, device_key, ts))
       SELECT event_id, CASE WHEN k = 'bad' THEN 'bad_ts' WHEN k = 'late' THEN 'outside_day' WHEN known THEN 'exists' WHEN rn > 1 THEN 'duplicate' ELSE 'insert' END AS verdict FROM f""")
def screen(t):
    tel = t.telemetry
    e = F.col("event_id")
    local = F.from_utc_timestamp("ts_utc", "America/Sao_Paulo")
    text = F.when(e % 9 == 0, "n/a").when(e % 4 == 0, F.date_format(local, "dd/MM/yyyy HH:mm:ss")).otherwise(F.date_format(local, "yyyy-MM-dd HH:mm:ss"))
    day = F.when(e % 9 == 1, F.date_add(F.to_date(local), 3)).otherwise(F.to_date(local))
    base = tel.select("event_id", "plant_id", "device_key", text.alias("ts_text"), day.alias("day"))
    again = tel.filter(e % 6 == 2).select((e + 1000000000).alias("event_id"), "plant_id", "device_key",
                                          F.date_format(local, "yyyy-MM-dd HH:mm:ss").alias("ts_text"), F.to_date(local).alias("day"))
    old = tel.filter(e % 50 == 7).select("plant_id", "device_key", F.date_trunc("second", "ts_utc").alias("ts_utc"))
    rows = base.unionByName(again).withColumn("tz", F.lit("America/Sao_Paulo"))
    return L.screen_raw_rows(rows, old, ["plant_id", "device_key"], "ts_text", "tz", "day", ["event_id"]).select("event_id", "verdict")


@query("s10_module_catalogue_check",
       """SELECT p_partkey, trim(p_name) AS nome, p_retailprice AS pmp_w, len(list_filter([CASE WHEN p_partkey % 7 = 0 THEN 'a' END, CASE WHEN p_partkey % 5 = 0 THEN 'b' END, CASE WHEN p_size * 4 > 100 THEN 'c' END], lambda x: x IS NOT NULL))::BIGINT AS n_problems FROM part""", ["pmp_w"])
def catalogue(t):
    p = t.raw("part")
    k = F.col("p_partkey")
    text = {"nome": F.concat(F.lit(" "), "p_name"), "fabricante": F.when(k % 7 == 0, " ").otherwise(F.col("p_brand")), "power_tolerance": F.lit("0/+5"),
            "pmp_w": F.replace(F.col("p_retailprice").cast("decimal(10,2)").cast("string"), F.lit("."), F.lit(",")),
            "eficiencia_pct": (F.col("p_size") * 4).cast("string"), "num_celulas": F.when(k % 5 == 0, "many").otherwise("72")}
    rest = {c: F.lit("1.5") for c in L.CATALOGUE_NUMBERS if c not in text}
    out = L.check_catalogue(p.select("p_partkey", *[e.alias(n) for n, e in {**text, **rest}.items()]))
    return out.select("p_partkey", "nome", F.col("pmp_w").cast("double").alias("pmp_w"), F.size("problems").alias("n_problems"))


@query("s11_nameplate_rules",
       """SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size * 3 > 100 THEN 'efficiency_range' END, CASE WHEN p_size > 40 THEN 'mppt_min_above_max' END, CASE WHEN p_partkey % 4 + 1 > 3 THEN 'mppt_above_inverter' END,
          CASE WHEN p_partkey % 6 < 1 THEN 'no_strings' END, CASE WHEN p_partkey % 6 > 0 AND p_partkey % 10 = 0 THEN 'modules_total_mismatch' END], lambda x: x IS NOT NULL), ',') AS violations FROM part""")
def nameplate(t):
    k, z = F.col("p_partkey"), F.col("p_size")
    p = t.raw("part").select(
        "p_partkey", (z * 3).alias("eficiencia_pct"), (z + 60).alias("vdc_mppt_min_v"), F.lit(100).alias("vdc_mppt_max_v"), (k % 4 + 1).alias("mppt"),
        F.lit(3).alias("mppt_count"), (k % 6).alias("strings_count"), F.lit(20).alias("modules_per_string"),
        ((k % 6) * 20 + F.when(k % 10 == 0, 1).otherwise(0)).alias("modules_total"))
    return L.nameplate_violations(p).select("p_partkey", F.array_join("violations", ",").alias("violations"))


UPSERT_OLD = "(SELECT l_orderkey, l_linenumber, max(l_quantity) AS q, max(l_suppkey) AS s FROM lineitem WHERE l_linenumber % 2 = 1 OR l_orderkey % 4 = 0 GROUP BY 1, 2)"
UPSERT_NEW = "(SELECT l_orderkey, l_linenumber, max(l_quantity) + 100 AS q, -1 AS s FROM lineitem WHERE l_linenumber % 2 = 0 OR l_orderkey % 8 = 0 GROUP BY 1, 2)"


def upsert_pair(t):
    li = t.raw("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.max("l_suppkey").alias("s"))
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    new = li.filter((n % 2 == 0) | (o % 8 == 0)).withColumns({"q": F.col("q") + 100, "s": F.lit(-1).cast("long")})
    return li.filter((n % 2 == 1) | (o % 4 == 0)), new


@query("s12_upsert_rows",
       f"SELECT l_orderkey, l_linenumber, coalesce(n.q, o.q) AS q, coalesce(o.s, n.s) AS s FROM {UPSERT_OLD} o FULL JOIN {UPSERT_NEW} n USING (l_orderkey, l_linenumber)", ["q"], longs=["l_linenumber"])
def upsert(t):
    old, new = upsert_pair(t)
    return TB.merge_rows(old, new, ["l_orderkey", "l_linenumber"], ["q"])


@query("s13_split_insert_update",
       f"SELECT CASE WHEN o.q IS NULL THEN 'insert' ELSE 'update' END AS action, count(*) AS n FROM {UPSERT_NEW} n LEFT JOIN {UPSERT_OLD} o USING (l_orderkey, l_linenumber) GROUP BY 1")
def split(t):
    old, new = upsert_pair(t)
    return TB.split_upsert(old, new, ["l_orderkey", "l_linenumber"]).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


REPLACED = """SELECT plant_id, ts_15, p_ac_w FROM power_15 WHERE NOT (plant_id % 2 = 0 AND ts_15 >= TIMESTAMP '2024-01-10' AND ts_15 < TIMESTAMP '2024-01-15')
          UNION ALL SELECT plant_id, ts_utc, ghi FROM weather WHERE plant_id % 2 = 0 AND ts_utc >= TIMESTAMP '2024-01-10' AND ts_utc < TIMESTAMP '2024-01-15'"""


def replacement(t):
    """Quarter-hours of power, those that replace them in even plants, and the ranges these take."""
    target = bins.bucket_power(t.telemetry, P).select("plant_id", "ts_15", "p_ac_w")
    lo, hi = F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-15").cast("timestamp")
    r = t.ranges.filter("plant_id % 2 = 0").select("plant_id", lo.alias("range_start"), hi.alias("range_end"))
    new = L.in_range(t.weather.filter("plant_id % 2 = 0"), lo, hi).select("plant_id", F.col("ts_utc").alias("ts_15"), F.col("ghi").alias("p_ac_w"))
    return target, new, r


@query("s14_replace_range", REPLACED, ["p_ac_w"])
def replace_range(t):
    return TB.replace_range(*replacement(t), P, "ts_15")


@query("s14_replace_after_lost_writer", REPLACED, ["p_ac_w"])
def replace_after_loss(t):
    """A writer is lost after staging; the table keeps its rows and the repeated write takes effect once."""
    target, new, r = replacement(t)
    target, new = [x.withColumn("day", F.to_date("ts_15")) for x in (target, new)]
    root = checkpoint_ready(t.spark).sparkContext.getCheckpointDir()
    table = VersionedTable(t.spark, f"{root}/replaced-{uuid.uuid4().hex}", target.schema, ("day",))
    table.replace(target, r.filter(F.lit(False)), P, "ts_15", batch="import")
    table.stage(new)
    table.replace(new, r, P, "ts_15", batch="weather")
    table.replace(new, r, P, "ts_15", batch="weather")
    return table.read().drop("day")


@query("s14_replace_overlapping_events",
       """SELECT pred_id FROM pred_events WHERE NOT (ts_start_utc < TIMESTAMP '2024-01-20' AND ts_end_utc >= TIMESTAMP '2024-01-05')
          UNION ALL SELECT truth_id FROM truth_events""")
def replace_events(t):
    target = t.pred_events.select("pred_id", "plant_id", "ts_start_utc", "ts_end_utc")
    new = t.truth_events.select(F.col("truth_id").alias("pred_id"), "plant_id", "ts_start_utc", "ts_end_utc")
    r = t.ranges.select("plant_id", F.lit("2024-01-05").cast("timestamp").alias("range_start"), F.lit("2024-01-20").cast("timestamp").alias("range_end"))
    return TB.replace_range(target, new, r, P, "ts_start_utc", "ts_end_utc").select("pred_id")


@query("s15_drop_plain_totals",
       """WITH w AS (SELECT plant_id, min(ts_15) AS lo, max(ts_15) AS hi FROM by_source WHERE source_oper LIKE '%|MPPT%' AND ts_15 < TIMESTAMP '2024-01-09' GROUP BY 1)
       SELECT b.plant_id, ts_15, source_oper FROM by_source b LEFT JOIN w ON w.plant_id = b.plant_id WHERE NOT coalesce(source_oper = 'INV01' AND ts_15 BETWEEN lo AND hi, false)""")
def drop_totals(t):
    b = t.by_source
    return TB.drop_plain_totals(b, b.filter(F.col("ts_15") < F.lit("2024-01-09").cast("timestamp")), P, "ts_15").select("plant_id", "ts_15", "source_oper")


@query("j05_insert_only_new_keys",
       f"SELECT l_orderkey, l_linenumber, q FROM {UPSERT_NEW} n ANTI JOIN {UPSERT_OLD} o USING (l_orderkey, l_linenumber)", ["q"], longs=["l_linenumber"])
def insert_only(t):
    old, new = upsert_pair(t)
    return TB.insert_only(old, new, ["l_orderkey", "l_linenumber"], [F.col("q")]).select("l_orderkey", "l_linenumber", "q")


@query("s20_import_chunks",
       """WITH r AS (SELECT c_custkey, DATE '2024-01-01' + CAST(c_custkey % 90 AS INTEGER) AS a, DATE '2024-01-01' + CAST(c_custkey % 90 + c_custkey % 200 AS INTEGER) AS b FROM customer),
       e AS (SELECT c_custkey, a, b, unnest(range(0, date_diff('day', a, b) + 1, 31)) AS o FROM r)
       SELECT c_custkey, (a + CAST(o AS INTEGER))::TIMESTAMP AS chunk_start, least(a + CAST(o + 30 AS INTEGER), b)::TIMESTAMP AS chunk_end FROM e""")
def chunks(t):
    k = F.col("c_custkey").cast("int")
    r = t.raw("customer").select("c_custkey", F.date_add(F.lit("2024-01-01").cast("date"), k % 90).alias("start_day"),
                                 F.date_add(F.lit("2024-01-01").cast("date"), k % 90 + k % 200).alias("end_day"))
    return TB.date_chunks(r, 15).select("c_custkey", F.col("chunk_start").cast("timestamp"), F.col("chunk_end").cast("timestamp"))


@query("s21_plant_snapshot",
       """SELECT c_custkey, nullif(CAST(c_custkey AS VARCHAR), '0') AS plant_id, c_name AS plant_name, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal ELSE 7 END AS current_power FROM customer""", ["current_power"])
def snapshot(t):
    k = F.col("c_custkey")
    c = t.raw("customer").select("c_custkey", F.to_json(F.create_map(
        F.lit("id"), k.cast("string"), F.lit("plantName"), F.lit(""), F.lit("plantName1"), F.col("c_name"),
        F.lit("currPower"), F.when(k % 3 == 0, F.col("c_acctbal").cast("string")).otherwise("0"), F.lit("pac"), F.lit("7"))).alias("payload"))
    return L.snapshot(c).select("c_custkey", "plant_id", "plant_name", "current_power")


@query("f05_catalogue_search",
       """SELECT p_partkey, p_name, p_brand FROM part WHERE (lower(p_name) LIKE '%ring%' OR lower(p_brand) LIKE '%ring%') AND lower(p_brand) = 'brand#2'""")
def search(t):
    p = t.raw("part")
    return L.search_catalogue(p, "RING", "BRAND#2", "preco", True, "p_name", "p_brand", "p_partkey", {"preco": "p_retailprice"}).select("p_partkey", "p_name", "p_brand")


@query("f13_newest_raw_page", "SELECT event_id, ts_utc FROM telemetry WHERE device_key = 'DEV3' ORDER BY ts_utc DESC, event_id DESC LIMIT 5 OFFSET 5")
def raw_page(t):
    return L.raw_page(t.telemetry.filter("device_key = 'DEV3'"), page=2, size=5).select("event_id", "ts_utc")


@query("f01_local_days_to_utc_range",
       """SELECT c_custkey, ((DATE '2018-10-20' + CAST(c_custkey % 40 AS INTEGER))::TIMESTAMP AT TIME ZONE 'America/Sao_Paulo') AT TIME ZONE 'UTC' AS t0,
          ((DATE '2018-10-20' + CAST(c_custkey % 40 + 3 AS INTEGER))::TIMESTAMP AT TIME ZONE 'America/Sao_Paulo') AT TIME ZONE 'UTC' AS t1 FROM customer""")
def local_range(t):
    d = F.date_add(F.lit("2018-10-20").cast("date"), (F.col("c_custkey") % 40).cast("int"))
    a, b = tg.local_range_to_utc(d, F.date_add(d, 2), "America/Sao_Paulo")
    return t.raw("customer").select("c_custkey", a.alias("t0"), b.alias("t1"))


@query("f02_align_range_to_grid",
       """SELECT event_id, time_bucket(INTERVAL 15 MINUTE, ts) AS t0, CASE WHEN time_bucket(INTERVAL 15 MINUTE, ts) = ts THEN ts ELSE time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE END AS t1 FROM events""")
def align(t):
    return t.samples.select("event_id", tg.floor_to("ts_utc").alias("t0"), tg.ceil_to("ts_utc").alias("t1"))


@query("f03_optional_source_filters",
       """SELECT truth_id FROM truth_events WHERE (CASE WHEN truth_id % 3 = 0 THEN '' ELSE source_oper END) IN ('', 'S9') AND starts_with(truth_label, 'grid')""")
def optional(t):
    e = t.truth_events.withColumn("source_oper", F.when(F.col("truth_id") % 3 == 0, "").otherwise(F.col("source_oper")))
    return e.filter(labels.matches_or_empty("source_oper", "S9") & F.startswith("truth_label", F.lit("grid"))).select("truth_id")


@query("f04_interval_overlap", "SELECT pred_id FROM pred_events WHERE ts_start_utc < TIMESTAMP '2024-01-08' AND ts_end_utc >= TIMESTAMP '2024-01-06'")
def overlap(t):
    lo, hi = (F.lit(d).cast("timestamp") for d in ("2024-01-06", "2024-01-08"))
    return t.pred_events.filter(tg.overlaps(F.col("ts_start_utc"), F.col("ts_end_utc"), lo, hi)).select("pred_id")


@query("f14_existing_columns", "SELECT event_id, value FROM events", ["value"])
def existing(t):
    return V.select_existing(t.raw("events"), ["event_id", "no_such", "value"])


@query("a36_fetch_statistics",
       """WITH d AS (SELECT DISTINCT plant_id, device_key, CAST((ts_utc AT TIME ZONE 'UTC') AT TIME ZONE 'America/Sao_Paulo' AS DATE) AS day FROM telemetry)
       SELECT plant_id, device_key, 11::BIGINT AS days_total, 11 - count(day) AS days_empty, count(day) AS days_with_data, min(day)::TIMESTAMP AS first_day_with_data, max(day)::TIMESTAMP AS last_day_with_data
       FROM d WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-15' GROUP BY 1, 2""")
def fetch_stats(t):
    k = ["plant_id", "device_key"]
    lo, hi = F.lit("2024-01-05").cast("date"), F.lit("2024-01-15").cast("date")
    asked = t.telemetry.filter(tg.local_day("ts_utc", "America/Sao_Paulo").between(lo, hi)).select(*k).distinct()
    r = asked.select(*k, F.lit("America/Sao_Paulo").alias("tz"), lo.alias("start_day"), hi.alias("end_day"))
    out = L.fetch_statistics(t.telemetry, r, k)
    return out.withColumns({c: F.col(c).cast("timestamp") for c in ("first_day_with_data", "last_day_with_data")})


@query("u01_union_and_slice",
       """SELECT plant_id, ts_utc, ghi, NULL::DOUBLE AS p_ac_w FROM weather WHERE ts_utc >= TIMESTAMP '2024-01-03' AND ts_utc < TIMESTAMP '2024-01-06'
          UNION ALL SELECT plant_id, ts_utc, NULL, p_ac_w FROM telemetry WHERE ts_utc >= TIMESTAMP '2024-01-03' AND ts_utc < TIMESTAMP '2024-01-06'""", ["ghi", "p_ac_w"])
def union(t):
    lo, hi = (F.lit(d).cast("timestamp") for d in ("2024-01-03", "2024-01-06"))
    return L.union_frames([t.weather.select("plant_id", "ts_utc", "ghi"), t.telemetry.select("plant_id", "ts_utc", "p_ac_w")], "ts_utc", lo, hi)


@query("u02_distinct_devices", "SELECT plant_id, device_key, arg_min(event_id, ts_utc) AS event_id FROM telemetry GROUP BY 1, 2")
def distinct_devices(t):
    d = t.telemetry.select("plant_id", "device_key", "ts_utc", "event_id")
    return K.first_row_per_key(d, ["plant_id", "device_key"], [F.col("ts_utc"), F.col("event_id")]).select("plant_id", "device_key", "event_id")


@query("x01_localised_numbers",
       "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS eu, l_extendedprice AS us, l_quantity AS unit, NULL::DOUBLE AS junk FROM lineitem", ["eu", "us", "unit", "junk"], longs=["l_linenumber"])
def localised(t):
    d = F.format_number("l_extendedprice", 2)
    eu = F.translate(d, ",.", ".,")
    return t.raw("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", V.parse_local_number(eu).alias("eu"), V.parse_local_number(d).alias("us"),
        V.parse_local_number(F.concat(F.replace(F.col("l_quantity").cast("string"), F.lit("."), F.lit(",")), F.lit(" V "))).alias("unit"),
        V.parse_local_number(F.lit("--1.2")).alias("junk"))


@query("x02_comma_numbers", "SELECT l_orderkey, l_linenumber, l_partkey, l_discount AS v FROM lineitem", ["v"], longs=["l_linenumber"])
def comma(t):
    return t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", V.parse_comma_number(F.replace(F.col("l_discount").cast("string"), F.lit("."), F.lit(","))).alias("v"))


@query("x03_parse_timestamps",
       """SELECT event_id, CASE WHEN event_id % 6 = 5 THEN NULL WHEN event_id % 6 IN (0, 1, 2) THEN date_trunc('second', ts)
          ELSE (date_trunc('second', ts) AT TIME ZONE 'America/Sao_Paulo') AT TIME ZONE 'UTC' END AS ts_utc FROM events""")
def parse_ts(t):
    e, s = F.col("event_id"), F.col("ts_utc")
    text = (F.when(e % 6 == 0, F.unix_seconds(s).cast("string")).when(e % 6 == 1, (F.unix_seconds(s) * 1000).cast("string"))
            .when(e % 6 == 2, F.date_format(s, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(e % 6 == 3, F.date_format(s, "yyyy-MM-dd HH:mm:ss"))
            .when(e % 6 == 4, F.date_format(s, "dd/MM/yyyy HH:mm:ss")).otherwise("yesterday"))
    return t.samples.select("event_id", tg.parse_instant(text, F.lit("America/Sao_Paulo")).alias("ts_utc"))


@query("x04_floor_to_interval", "SELECT event_id, time_bucket(INTERVAL 15 MINUTE, ts) AS b15, time_bucket(INTERVAL 60 MINUTE, ts) AS b60 FROM events")
def floors(t):
    return t.samples.select("event_id", tg.floor_to("ts_utc").alias("b15"), tg.floor_to("ts_utc", 60).alias("b60"))


@query("x05_local_day_and_bin",
       """SELECT event_id, l::DATE::TIMESTAMP AS day, hour(l) * 60 + minute(l) AS minute_of_day, (hour(l) * 60 + minute(l)) // 30 AS bin30, strftime(l, '%Y-%m-%dT%H:%M') AS tkey
          FROM (SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Madrid' AS l FROM events)""")
def local_bins(t):
    w = tg.local("ts_utc", "Europe/Madrid")
    return t.samples.select("event_id", F.to_date(w).cast("timestamp").alias("day"), tg.minute_of_day(w).alias("minute_of_day"),
                            tg.bin_of_day(w, 30).alias("bin30"), tg.minute_key(w).alias("tkey"))


@query("x06_normal_identifiers", "SELECT p_partkey, regexp_replace(lower(p_brand || p_name), '[^a-z0-9]', '', 'g') AS nid FROM part")
def normal_ids(t):
    return t.raw("part").select("p_partkey", V.normal_id(F.concat(F.lit("-"), "p_brand", F.lit(" "), "p_name")).alias("nid"))


@query("x08_first_present_key", "SELECT event_id, json_extract_string(props, '$.k') AS v FROM events")
def first_key(t):
    return t.raw("events").select("event_id", L.first_present(L.payload_map("props"), ["missing", "k", "x"]).alias("v"))


@query("x09_weighted_voltage",
       """SELECT event_id, CASE WHEN i_dc_a > 0 OR alarm_code > 0 THEN (CASE WHEN i_dc_a > 0 THEN v_dc_v * i_dc_a ELSE 0 END + CASE WHEN alarm_code > 0 THEN v_ac_v * alarm_code ELSE 0 END) /
          (CASE WHEN i_dc_a > 0 THEN i_dc_a ELSE 0 END + CASE WHEN alarm_code > 0 THEN alarm_code ELSE 0 END) END AS v, CASE WHEN i_dc_a > 0 OR alarm_code > 0 THEN (CASE WHEN i_dc_a > 0 THEN i_dc_a ELSE 0 END + CASE WHEN alarm_code > 0 THEN alarm_code ELSE 0 END) END AS i FROM telemetry""", ["v", "i"])
def weighted(t):
    pairs = F.array(*[F.struct(F.col(a).alias("v"), F.col(b).cast("double").alias("i")) for a, b in (("v_dc_v", "i_dc_a"), ("v_ac_v", "alarm_code"))])
    v, i = L.weighted_dc(pairs)
    return t.telemetry.select("event_id", v.alias("v"), i.alias("i"))


@query("x10_vendor_azimuth",
       """SELECT event_id, CASE WHEN (event_id * 7 % 720 + 360) % 360 = 0 THEN 180.0::DOUBLE ELSE CAST((event_id * 7 % 720) % 360 AS DOUBLE) - 180 END AS az, CAST(least(event_id % 120, 90) AS DOUBLE) AS tilt FROM events""", ["az", "tilt"])
def azimuth(t):
    e = F.col("event_id")
    return t.raw("events").select("event_id", V.vendor_azimuth((e * 7 % 720).cast("double")).alias("az"), V.clamp_tilt((e % 120).cast("double")).alias("tilt"))


@query("x11_native_region",
       """SELECT c_custkey, (c_custkey % 90 BETWEEN 41 AND 59.5 AND c_custkey % 100 - 60 BETWEEN -10.5 AND 26) OR (c_custkey % 90 BETWEEN 14 AND 84.5 AND c_custkey % 100 - 60 BETWEEN -170 AND -50) AS native FROM customer""")
def native(t):
    k = F.col("c_custkey")
    return t.raw("customer").select("c_custkey", V.in_native_region((k % 90).cast("double"), (k % 100 - 60).cast("double")).alias("native"))


@query("x27_device_keys",
       """SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 2 THEN s_name || '/' || s_nationkey || '/' || s_suppkey || '/sn' || s_suppkey END AS parts FROM supplier""")
def device_keys(t):
    k = F.col("s_suppkey")
    text = (F.when(k % 3 == 0, K.device_key(F.col("s_name"), F.col("s_nationkey"), k, F.concat(F.lit("sn"), k.cast("string"))))
            .when(k % 3 == 1, F.concat(F.lit("sn= sn"), k.cast("string"), F.lit(" | PN="), "s_name", F.lit("|devaddr="), k.cast("string"), F.lit("|devcode="), F.col("s_nationkey").cast("string")))
            .otherwise(F.concat("s_name", F.lit("|x"))))
    d = t.raw("supplier").select("s_suppkey", K.parse_device_key(text).alias("d"))
    return d.select("s_suppkey", F.when(F.col("d").isNotNull(), F.concat_ws("/", "d.pn", "d.devcode", F.col("d.devaddr").cast("string"), "d.sn")).alias("parts"))


@query("x33_standard_time_series",
       """SELECT plant_id, (ts_15 AT TIME ZONE 'America/Sao_Paulo') AT TIME ZONE 'UTC' AS datetime, ts_15 AS local_datetime FROM full_grid""")
def standard_time(t):
    g = bins.grid_of(t.ranges, "range_start", "range_end").select(
        "plant_id", F.year("ts_15").alias("Year"), F.month("ts_15").alias("Month"), F.dayofmonth("ts_15").alias("Day"), F.hour("ts_15").alias("Hour"), F.minute("ts_15").alias("Minute"))
    a = L.standard_time_series(g, False).withColumn("local_datetime", F.col("datetime"))
    return L.standard_time_series(a.drop("datetime"), True, "America/Sao_Paulo").select("plant_id", "datetime", "local_datetime")


@query("i01_incremental_start_days",
       """WITH r AS (SELECT plant_id, device_key, DATE '2024-01-20' AS sd, CASE WHEN plant_id % 2 = 0 THEN DATE '2024-02-05' ELSE DATE '2024-01-25' END AS ed, max(ts_utc)::DATE AS last FROM telemetry GROUP BY 1, 2)
       SELECT plant_id, device_key, (CASE WHEN last <= ed THEN greatest(sd, last - 1) ELSE sd END)::TIMESTAMP AS effective_start, CASE WHEN last <= ed THEN 'incremental_from_last' ELSE 'backfill_preserved_start' END AS reason FROM r""")
def start_days(t):
    k = ["plant_id", "device_key"]
    r = t.telemetry.select(*k).distinct().withColumns({"start_day": F.lit("2024-01-20").cast("date"), "end_day": F.when(F.col("plant_id") % 2 == 0, F.lit("2024-02-05").cast("date")).otherwise(F.lit("2024-01-25").cast("date"))})
    return TB.start_days(r, t.telemetry, k).select(*k, F.col("effective_start").cast("timestamp").alias("effective_start"), "reason")


@query("i02_days_still_to_fetch",
       """WITH k AS (SELECT DISTINCT plant_id, device_key FROM telemetry), d AS (SELECT plant_id, device_key, unnest(range(DATE '2024-01-01', DATE '2024-02-03', INTERVAL 1 DAY))::DATE AS day FROM k)
       SELECT plant_id, device_key, day::TIMESTAMP AS day FROM d ANTI JOIN (SELECT DISTINCT plant_id, device_key, CAST((ts_utc AT TIME ZONE 'UTC') AT TIME ZONE 'America/Sao_Paulo' AS DATE) AS day FROM telemetry) USING (plant_id, device_key, day)""")
def to_fetch(t):
    k = ["plant_id", "device_key"]
    r = t.telemetry.select(*k).distinct().withColumns({"tz": F.lit("America/Sao_Paulo"), "start_day": F.lit("2024-01-01").cast("date"), "end_day": F.lit("2024-02-02").cast("date")})
    return TB.days_to_fetch(r, t.telemetry, k).select(*k, F.col("day").cast("timestamp").alias("day"))


@query("i03_ingest_state",
       """WITH d AS (SELECT plant_id, device_key, ts_utc::DATE AS day, CASE WHEN min(event_id) % 5 = 0 THEN repeat('x', 6000) END AS error FROM telemetry GROUP BY 1, 2, 3)
       SELECT plant_id, device_key, (max(day) FILTER (error IS NULL))::TIMESTAMP AS last_ok_day, CASE WHEN arg_max(coalesce(error, ''), day) = '' THEN 'ok' ELSE 'error' END AS status, CAST(length(arg_max(coalesce(error, ''), day)) AS BIGINT) AS error_chars FROM d GROUP BY 1, 2""")
def state(t):
    k = ["plant_id", "device_key"]
    d = t.telemetry.groupBy(*k, F.to_date("ts_utc").alias("day")).agg(F.when(F.min("event_id") % 5 == 0, F.repeat(F.lit("x"), 6000)).alias("error"))
    return TB.ingest_state(d, k).select(*k, F.col("last_ok_day").cast("timestamp").alias("last_ok_day"), "status", F.length("error").alias("error_chars"))
