"""Landed vendor files and raw payloads → typed rows."""
from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sunloom.functions import timegrid as tg
from sunloom.functions import values as V
from sunloom.operators import series as S
from sunloom.operators.selection import medians

# fixed values: payload titles of the inverter vendor
PAC_TITLES = ("potência ativa total", "Potência ativa total")
PDC_TITLES = ("Potência de saída CC", "Potência de saída CC ")
MPPT_V_TITLE = "Tensão CC MPPT{k}"
MPPT_I_TITLE = "Corrente CC MPPT{k}"
PHASE_V_TITLES = ("Tensão de fase R", "Tensão de fase S", "Tensão de fase T")
PHASE_I_TITLES = ("Corrente de fase A", "Corrente de fase B", "Corrente de fase C")
TIME_TITLE = "Data E Hora"
PARSED_VENDOR = "RENOVIGI"
# have columns even if no payload names them
USUAL_TRACKERS = (1, 2, 3, 4)

# fixed values: weather service arrays → table columns
WEATHER_ARRAYS = {
    "ghi": "shortwave_radiation", "dni": "direct_normal_irradiance", "dhi": "diffuse_radiation",
    "gti": "global_tilted_irradiance", "temp_air": "temperature_2m", "wind_speed": "wind_speed_10m",
    "rh": "relative_humidity_2m", "pressure": "surface_pressure",
}

# fixed values: module catalogue headers
CATALOGUE_TEXT = ("nome", "fabricante", "power_tolerance")
CATALOGUE_NUMBERS = {
    "pmp_w": "decimal(10,2)", "vmp_v": "decimal(8,3)", "imp_a": "decimal(8,3)", "voc_v": "decimal(8,3)",
    "isc_a": "decimal(8,3)", "eficiencia_pct": "decimal(5,2)", "temp_coeff_voc_pct_c": "decimal(6,4)",
    "temp_coeff_isc_pct_c": "decimal(6,4)", "rs_ohm": "decimal(8,4)", "rp_ohm": "decimal(10,3)", "diode_a": "decimal(4,3)",
}


def in_range(df: DataFrame, start: Column, end: Column, time: str = "ts_utc") -> DataFrame:
    """Half-open time range; reaches the file scan as a pushed filter."""
    return df.filter((F.col(time) >= start) & (F.col(time) < end))


def payload_map(c: Column | str) -> Column:
    return F.from_json(V.col(c), "map<string,string>")


def first_title(payload: Column, titles: Iterable[str]) -> Column:
    """First title with a usable value (blank counts as absent)."""
    return F.coalesce(*[F.nullif(F.trim(F.try_element_at(payload, F.lit(t))), F.lit("")) for t in titles])


def first_present(payload: Column, names: Sequence[str]) -> Column:
    """Value of the first key that exists, even when that value is null."""
    out = F.lit(None).cast("string")
    for n in reversed(names):
        out = F.when(F.map_contains_key(payload, F.lit(n)), F.try_element_at(payload, F.lit(n))).otherwise(out)
    return out


def weighted_dc(trackers: Column) -> tuple[Column, Column]:
    """Current-weighted voltage and total current over the (v, i) of trackers with positive current."""
    pairs = F.filter(trackers, lambda p: p["v"].isNotNull() & (p["i"] > 0))
    amps_sum = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["i"])
    power = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["v"] * p["i"])
    some = F.size(pairs) > 0
    return F.when(some, power / amps_sum), F.when(some, amps_sum)


def payload_trackers(df: DataFrame, payload: str = "payload") -> list[int]:
    """Numbers of the trackers that the payloads name: what `trackers` of `extract_payload` can be."""
    found = df.select(F.explode(_tracker_numbers(payload_map(payload))).alias("k")).distinct()
    return sorted(int(r["k"]) for r in found.collect())


def _tracker_numbers(p: Column) -> Column:
    """Digits after the tracker voltage title, for every such key of a payload."""
    shape = f"^{MPPT_V_TITLE.format(k='([0-9]+)')}$"
    return F.filter(F.transform(F.map_keys(p), lambda name: F.regexp_extract(name, shape, 1)), lambda k: k != F.lit(""))


def tracker_pairs(p: Column) -> Column:
    """(v, i) of every tracker that a payload names, however many there are."""
    at = lambda title, k: V.local_number(F.try_element_at(p, F.concat(F.lit(title.format(k="")), k)))
    return F.transform(_tracker_numbers(p), lambda k: F.struct(at(MPPT_V_TITLE, k).alias("v"), at(MPPT_I_TITLE, k).alias("i")))


def extract_payload(df: DataFrame, provider: str = "provedor", payload: str = "payload", trackers: Sequence[int] | None = None) -> DataFrame:
    """Raw payload → canonical metrics; payloads of other vendors give NULLs.

    The DC totals are over all trackers of the payload; `trackers` only says which get columns of their own. By default they are
    1 to 4 and all others that the payloads name, found by a pass over the table; a stream has to be told.
    """
    known = F.upper(F.coalesce(F.col(provider), F.lit(""))) == PARSED_VENDOR
    if trackers is None:
        if df.isStreaming:
            raise ValueError("extract_payload: name the trackers of a stream")
        trackers = sorted({*USUAL_TRACKERS, *payload_trackers(df.filter(known), payload)})
    df = df.withColumn("_p", F.when(known, payload_map(payload)))
    p = F.col("_p")
    at = lambda title: F.try_element_at(p, F.lit(title))
    ks = tuple(trackers)
    texts = {"p_ac_w": first_title(p, PAC_TITLES), "p_dc_w": first_title(p, PDC_TITLES)}
    texts |= {f"mppt{k}_vdc_v": at(MPPT_V_TITLE.format(k=k)) for k in ks} | {f"mppt{k}_idc_a": at(MPPT_I_TITLE.format(k=k)) for k in ks}
    texts |= {f"_v{n}": at(t) for n, t in enumerate(PHASE_V_TITLES)} | {f"_i{n}": at(t) for n, t in enumerate(PHASE_I_TITLES)}
    df = V.with_local_numbers(df.withColumns({"payload_time": at(TIME_TITLE), "_t": tracker_pairs(p)}), texts)
    volts, amps = [F.col(f"mppt{k}_vdc_v") for k in ks], [F.col(f"mppt{k}_idc_a") for k in ks]
    vdc, idc = weighted_dc(F.col("_t"))
    phases = {"_v": PHASE_V_TITLES, "_i": PHASE_I_TITLES}
    cols = {n: [F.col(f"{n}{j}") for j in range(len(t))] for n, t in phases.items()}
    return df.withColumns(
        {
            "v_dc_v": vdc, "i_dc_a": idc,
            "v_ac_v": V.array_mean_nonzero(cols["_v"], 5.0), "i_ac_a": V.array_mean_nonzero(cols["_i"], 0.05),
            **{f"mppt{k}_p_dc_w": F.when(i > 0, v * i) for k, v, i in zip(ks, volts, amps)},
        }
    ).drop("_p", "_t", *[c for n, t in phases.items() for c in (f"{n}{j}" for j in range(len(t)))])


def extract_candidates(df: DataFrame, payload: str, candidates: dict[str, Sequence[str]]) -> DataFrame:
    """Alternative raw layout: one numeric column per name from the first key present in the JSON."""
    df = df.withColumn("_p", F.coalesce(payload_map(payload), F.create_map().cast("map<string,string>")))
    cols = {n: V.finite(first_present(F.col("_p"), names)) for n, names in candidates.items()}
    return df.withColumns(cols).drop("_p")


def weather_columns(df: DataFrame, candidates: dict[str, Sequence[str]], payload: str = "data") -> DataFrame:
    """Weather by explicit columns when the table has them, else from its JSON column."""
    if any(c in df.columns for c in candidates):
        have = {c: V.finite(c) if c in df.columns else F.lit(None).cast("double") for c in candidates}
        return df.withColumns(have)
    return extract_candidates(df, payload, candidates)


def repair_clock(df: DataFrame, keys: Sequence[str], tz: str = "tz", time: str = "ts_utc", payload_time: str = "payload_time",
                 min_shift_minutes: int = 30) -> DataFrame:
    """Shift a series by its median offset to the payload's own clock, in 15-minute steps.

    Payload text may mean UTC or plant time: the reading with the smaller median distance wins, UTC
    on a tie.  Medians are selected exactly, without gathering a series.
    """
    as_utc = F.try_to_timestamp(F.col(payload_time))
    away = lambda c: F.unix_micros(c) - F.unix_micros(F.col(time))
    d = df.withColumn("_u", as_utc)
    d = d.withColumns({"_hu": away(F.col("_u")), "_hl": away(F.to_utc_timestamp("_u", F.col(tz)))})
    med = medians(d, keys, {f"_a{c}": F.abs(F.col(c)) for c in ("_hu", "_hl")} | {f"_m{c}": F.col(c) for c in ("_hu", "_hl")})
    utc = F.col("_a_hu") <= F.col("_a_hl")
    median = F.when(utc, F.col("_m_hu")).otherwise(F.col("_m_hl"))
    steps = (F.bround(median / 9e8) * 15).cast("long")  # quarter-hours
    med = med.select(
        *keys, F.when(utc, "utc").otherwise("plant_local").alias("clock_mode"),
        F.when(F.abs(steps) >= min_shift_minutes, steps).otherwise(0).alias("shift_minutes"),
    )
    d = S._join(d.drop("_u", "_hu", "_hl"), med, keys)
    d = d.withColumns({"clock_mode": F.coalesce("clock_mode", F.lit("none")), "shift_minutes": F.coalesce("shift_minutes", F.lit(0).cast("long"))})
    return d.withColumn(time, tg.plus_seconds(time, F.col("shift_minutes") * 60))


def scan_telemetry(df: DataFrame, start: Column, end: Column, keys: Sequence[str], tz: str = "tz", buffer_hours: int = 6,
                   trackers: Sequence[int] | None = None) -> DataFrame:
    """Buffered range, payload extraction, clock repair, then the exact range; trackers as in `extract_payload`."""
    pad = buffer_hours * 3600
    wide = in_range(df, tg.plus_seconds(start, -pad), tg.plus_seconds(end, pad))
    return in_range(repair_clock(extract_payload(wide, trackers=trackers), keys, tz), start, end)


def weather_blocks(df: DataFrame, payload: str = "payload", block: str = "minutely_15") -> DataFrame:
    """Weather JSON with parallel arrays → one row per instant; absent arrays give NULL, hPa → Pa."""
    fields = ", ".join(f"{a}: array<double>" for a in WEATHER_ARRAYS.values())
    schema = f"struct<{block}: struct<time: array<string>, {fields}>>"
    keep = [c for c in df.columns if c != payload]
    b = F.col(f"_b.{block}")
    cells = [F.get(b[a], F.col("_i")).alias(c) for c, a in WEATHER_ARRAYS.items()]
    rows = df.withColumn("_b", F.from_json(payload, schema)).select(*keep, "_b", F.posexplode(b["time"]).alias("_i", "_t"))
    out = rows.select(*keep, F.try_to_timestamp(F.replace(F.col("_t"), F.lit("T"), F.lit(" "))).alias("ts_utc"), *cells)
    return out.withColumn("pressure", F.col("pressure") * 100.0)


def csv_lines_to_weather(lines: DataFrame, file: str = "file") -> DataFrame:
    """Annual weather CSV lines (two metadata lines, then a header) → rows by normalised name.

    Each file's own header names its columns, so files with different columns can be read together.
    """
    names = {"ghi": ["ghi"], "dni": ["dni"], "dhi": ["dhi"], "wind_speed": ["wind_speed"],
             "temp_air": ["air_temperature"], "rh": ["relative_humidity", "rh"], "pressure": ["pressure"]}
    clock = ("year", "month", "day", "hour", "minute")
    head = lines.filter(F.col("value").startswith("Year,")).select(
        F.col(file).alias("_f"), F.split(F.replace(F.lower("value"), F.lit(" "), F.lit("_")), ",").alias("_h")
    )
    twice = F.raise_error(F.concat(F.lit("weather CSV: column named twice in "), F.array_join("_h", ","))).cast("int")
    width = F.when(F.size(F.array_distinct("_h")) == F.size("_h"), F.size("_h")).otherwise(twice)
    # where each name stands is found once per file, not in every line
    wanted = [*clock, *[n for ns in names.values() for n in ns]]
    head = head.select("_f", width.alias("_width"), *[(F.array_position("_h", n) - 1).cast("int").alias(f"_at_{n}") for n in wanted])
    data = lines.filter(F.col("value").rlike(r"^\s*\d{4},"))
    cells = F.split("value", ",")
    short = F.raise_error(F.concat(F.lit("weather CSV: cells are missing in "), F.col("value"))).cast("array<string>")
    rows = data.join(head, data[file] == head["_f"]).withColumn("_c", F.when(F.size(cells) >= F.col("_width"), cells).otherwise(short))
    get = lambda n: F.get("_c", F.col(f"_at_{n}"))
    part = {n: get(n).try_cast("int") for n in clock}
    stamp = F.try_make_timestamp_ltz(*part.values(), F.lit(0).cast("decimal(16,6)"))
    bad = F.raise_error(F.concat(F.lit("weather CSV: bad timestamp in "), F.col("value"))).cast("timestamp")
    return rows.select(
        file, F.coalesce(stamp, bad).alias("ts_utc"),
        *[V.finite(F.coalesce(*[get(n) for n in ns])).alias(c) for c, ns in names.items()],
    )


def read_weather_csv(spark: SparkSession, path: str, start: Column | None = None, end: Column | None = None) -> DataFrame:
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    out = csv_lines_to_weather(lines)
    return out.filter(F.col("ts_utc").between(start, end)) if start is not None and end is not None else out


def standard_time_series(df: DataFrame, utc_flag: bool, tz: str = "UTC") -> DataFrame:
    """Annual series: zone-free local standard time, or UTC instants when flagged; common names."""
    names = {"air_temperature": "temperature_2m", "wind_speed": "wind_speed_10m"}
    rename = {a: b for a, b in names.items() if a in df.columns and b not in df.columns}
    stamp = F.make_timestamp_ntz(*[F.col(c).cast("int") for c in ("Year", "Month", "Day", "Hour", "Minute")], F.lit(0))
    out = df.withColumnsRenamed(rename).withColumn("datetime", stamp).filter(F.col("datetime").isNotNull())
    return out.withColumn("datetime", F.to_utc_timestamp(F.col("datetime").cast("timestamp"), tz)) if utc_flag else out


def table_payload(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Titles + ragged rows of a vendor table → one map per row, cut or padded to the title count."""
    cell = "array<string>"
    keep = [c for c in df.columns if c != payload]
    head = "title: array<string>, titles: array<string>, header: array<string>, headers: array<string>"
    body = "row: array<string>, rows: array<string>, data: array<string>, datas: array<string>"
    d = df.withColumn("_t", F.from_json(payload, f"struct<{head}, {body}>"))
    filled = lambda names: F.coalesce(*[F.when(F.size(F.col(f"_t.{n}")) > 0, F.col(f"_t.{n}")) for n in names])
    named = F.transform(
        filled(("title", "titles", "header", "headers")),
        lambda s: F.trim(F.coalesce(*[F.get_json_object(s, f"$.{k}") for k in ("title", "name", "label", "field")], s)),
    )
    d = d.withColumn("_h", F.filter(named, lambda s: s != ""))
    d = d.select(*keep, "_h", F.posexplode(filled(("row", "rows", "data", "datas"))).alias("row_no", "_r"))
    values = F.coalesce(
        *[F.from_json(F.get_json_object("_r", f"$.{k}"), cell) for k in ("filed", "field", "values", "value")],
        F.from_json("_r", cell),
    )
    d = d.withColumn("_v", values).filter(F.size("_v") > 0)
    h = F.coalesce(
        F.when(F.size("_h") > 0, F.col("_h")),
        F.transform(F.sequence(F.lit(0), F.size("_v") - 1), lambda i: F.concat(F.lit("field_"), i.cast("string"))),
    )
    d = d.withColumn("_h2", h)
    padded = F.slice(F.concat("_v", F.array_repeat(F.lit(None).cast("string"), F.size("_h2"))), 1, F.size("_h2"))
    return d.select(*keep, "row_no", F.map_from_arrays("_h2", padded).alias("record"))


def time_title(record: Column) -> Column:
    """First title that looks like a clock column, else the first title."""
    hit = F.filter(F.map_keys(record), lambda k: F.lower(k).rlike("time|hora|data|timestamp"))
    return F.coalesce(F.get(hit, F.lit(0)), F.get(F.map_keys(record), F.lit(0)))


def screen_raw_rows(df: DataFrame, existing: DataFrame | None, keys: Sequence[str], text: str, tz: str, day: str,
                    order: Sequence[str]) -> DataFrame:
    """Verdict per landed row: bad_ts, outside_day, exists, duplicate or insert.

    Timestamps must parse and fall inside the local day they were fetched for; the first row per key wins.
    """
    ts = tg.parse_instant(text, F.col(tz))
    lo, hi = tg.local_range_to_utc(F.col(day), F.col(day), F.col(tz))
    d = df.withColumn("ts_utc", ts)
    inside = (F.col("ts_utc") >= lo) & (F.col("ts_utc") < hi)
    d = d.withColumn("_ok", F.coalesce(inside, F.lit(False)))
    full = [*keys, "ts_utc"]
    first = d.filter("_ok").groupBy(*full).agg(F.min(F.struct(*order)).alias("_first"))
    if existing is not None:
        first = first.join(existing.select(*full).distinct().withColumn("_old", F.lit(True)), full, "left")
    else:
        first = first.withColumn("_old", F.lit(None).cast("boolean"))
    d = d.join(first, full, "left")
    verdict = (
        F.when(F.col("ts_utc").isNull(), "bad_ts").when(~F.col("_ok"), "outside_day")
        .when(F.coalesce("_old", F.lit(False)), "exists").when(F.struct(*order) != F.col("_first"), "duplicate").otherwise("insert")
    )
    return d.withColumn("verdict", verdict).drop("_ok", "_first", "_old")


def snapshot(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Vendor plant record → first usable of several names (blank and zero count as absent)."""
    p = payload_map(payload)

    def pick(*names: str) -> Column:
        return F.coalesce(*[
            F.when(~F.coalesce(v, F.lit("")).isin("", "0", "0.0", "false"), v)
            for v in (F.try_element_at(p, F.lit(n)) for n in names)
        ])

    return df.select(
        *[c for c in df.columns if c != payload],
        pick("plantId", "id").alias("plant_id"), pick("plantName", "plantName1").alias("plant_name"),
        V.finite(pick("currPower", "power", "pac")).alias("current_power"),
        V.finite(pick("todayEnergy", "todayKwh")).alias("today_energy_kwh"),
        V.finite(pick("totalEnergy", "totalKwh")).alias("total_energy_kwh"),
    )


def check_catalogue(df: DataFrame) -> DataFrame:
    """Module catalogue rows with typed columns and the list of problems per row (empty = accepted)."""
    needed = [*CATALOGUE_TEXT, *CATALOGUE_NUMBERS, "num_celulas"]
    absent = [c for c in needed if c not in df.columns]
    if absent:
        raise ValueError(f"catalogue lacks headers: {', '.join(absent)}")
    number = {c: F.replace(F.trim(F.col(c)), F.lit(","), F.lit(".")).try_cast(t) for c, t in CATALOGUE_NUMBERS.items()}
    typed = {**{c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in CATALOGUE_TEXT}, **number,
             "num_celulas": F.trim("num_celulas").try_cast("int")}
    out = df.withColumns(typed)
    rules = [F.when((F.col("nome") == "") | (F.col("fabricante") == ""), "name and maker are required")]
    rules += [F.when(F.col(c).isNull(), f"{c} is not a number") for c in (*CATALOGUE_NUMBERS, "num_celulas")]
    rules += [F.when(~F.col("eficiencia_pct").between(0, 100), "eficiencia_pct outside 0..100")]
    return out.withColumn("problems", F.array_compact(F.array(*rules)))


def nameplate_violations(df: DataFrame) -> DataFrame:
    """Rule names a plate row breaks, for whichever of the rule's columns the table has."""
    c = lambda n: F.col(n)
    rules = {
        ("eficiencia_pct",): ("efficiency_range", lambda: ~c("eficiencia_pct").between(0, 100)),
        ("vdc_mppt_min_v", "vdc_mppt_max_v"): ("mppt_min_above_max", lambda: c("vdc_mppt_min_v") > c("vdc_mppt_max_v")),
        ("vdc_mppt_max_v", "vdc_abs_max_v"): ("mppt_max_above_absolute", lambda: c("vdc_mppt_max_v") > c("vdc_abs_max_v")),
        ("mppt", "mppt_count"): ("mppt_above_inverter", lambda: c("mppt") > c("mppt_count")),
        ("strings_count",): ("no_strings", lambda: c("strings_count") < 1),
        ("modules_per_string",): ("no_modules", lambda: c("modules_per_string") < 1),
        ("strings_count", "modules_per_string", "modules_total"): (
            "modules_total_mismatch",
            lambda: (c("strings_count") > 0) & (c("modules_per_string") > 0) & (c("modules_total") > 0)
            & (c("modules_total") != c("strings_count") * c("modules_per_string")),
        ),
    }
    have = set(df.columns)
    broken = [F.when(rule(), name) for cols, (name, rule) in rules.items() if set(cols) <= have]
    return df.withColumn("violations", F.array_compact(F.array(*broken)))


# fixed values: sortable catalogue columns
SORTABLE = {"fabricante": "fabricante", "nome": "nome", "pmp": "pmp_w", "vmp": "vmp_v", "imp": "imp_a", "voc": "voc_v",
            "isc": "isc_a", "eficiencia": "eficiencia_pct", "celulas": "num_celulas", "rs": "rs_ohm", "rp": "rp_ohm", "a": "diode_a"}


def search_catalogue(df: DataFrame, text: str = "", maker: str = "", sort: str = "", descending: bool = False,
                     name_col: str = "nome", maker_col: str = "fabricante", tie: str = "id", sortable: dict[str, str] = SORTABLE) -> DataFrame:
    """Case-insensitive substring on name or maker, exact maker, whitelisted order."""
    if text.strip():
        t = F.lit(text.strip().lower())
        df = df.filter(F.contains(F.lower(name_col), t) | F.contains(F.lower(maker_col), t))
    if maker.strip():
        df = df.filter(F.lower(maker_col) == maker.strip().lower())
    if sort in sortable:
        key = F.col(sortable[sort])
        df = df.orderBy(key.desc() if descending else key.asc(), F.col(tie))
    return df


#: lengths of the slices of time that a page is looked for in
PAGE_SLICES = (86400, 3600, 60, 1)


def raw_page(df: DataFrame, time: str = "ts_utc", page: int = 1, size: int = 200, tie: str = "event_id") -> DataFrame:
    """Newest-first page of exactly the asked size, however deep it lies.

    Rows per day say in which days the page lies; only those are counted by hour, then by minute and by second.  The page is
    then cut out of the last slices by a range of time that the scan gets as a filter, so no task holds the rows before it.
    Counts on the driver are one per slice of the chosen ones.  Rows without a time come last.
    """
    if page < 1 or size < 1:
        raise ValueError(f"page and size count from 1: {page}, {size}")
    first, last = (page - 1) * size, page * size
    order = [F.col(time).desc_nulls_last(), F.col(tie).desc()]
    low = high = None  # seconds of the range in use
    rows = df.filter(F.col(time).isNotNull())
    for length in PAGE_SLICES:
        slices = rows.groupBy((F.floor(F.unix_seconds(F.col(time)) / length) * length).alias("at")).count().orderBy(F.desc("at")).collect()
        before, chosen = 0, []
        for r in slices:
            if before < last and before + r["count"] > first:
                chosen.append((r["at"], before))
            before += r["count"]
        if not chosen or (high is None and before < last):
            # the page reaches the rows without a time, or lies behind all rows
            return df.orderBy(*order).offset(first).limit(size)
        high, low = chosen[0][0] + length, chosen[-1][0]
        first, last = first - chosen[0][1], last - chosen[0][1]
        instant = lambda seconds: F.timestamp_seconds(F.lit(seconds))
        rows = df.filter((F.col(time) >= instant(low)) & (F.col(time) < instant(high)))
        if first <= 4 * size:
            break
    return rows.orderBy(*order).offset(first).limit(size)


def fetch_statistics(df: DataFrame, ranges: DataFrame, keys: Sequence[str], tz: str = "tz", time: str = "ts_utc") -> DataFrame:
    """Days asked, empty and filled, first and last filled local day per device."""
    days = df.join(ranges.select(*keys, tz, "start_day", "end_day"), list(keys)).withColumn("_day", tg.local_day(time, F.col(tz)))
    days = days.filter(F.col("_day").between(F.col("start_day"), F.col("end_day"))).select(*keys, "_day").distinct()
    got = days.groupBy(*keys).agg(F.count(F.lit(1)).alias("days_with_data"), F.min("_day").alias("first_day_with_data"),
                                  F.max("_day").alias("last_day_with_data"))
    total = F.date_diff("end_day", "start_day") + 1
    out = ranges.join(got, list(keys), "left").withColumn("days_with_data", F.coalesce("days_with_data", F.lit(0)))
    return out.select(*keys, total.alias("days_total"), (total - F.col("days_with_data")).alias("days_empty"),
                      "days_with_data", "first_day_with_data", "last_day_with_data")


def union_frames(frames: Sequence[DataFrame], time: str, start: Column, end: Column) -> DataFrame:
    """Frames with different columns stacked and cut to [start, end)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.filter((F.col(time) >= start) & (F.col(time) < end))
