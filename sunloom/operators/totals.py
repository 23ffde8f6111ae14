"""From several sources per instant to one plant total, without counting power twice."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunloom.config import WEATHER_COLS, WEATHER_FLAGS, WEATHER_SCORE
from sunloom.functions.values import first_by, flag, mean_nonzero
from sunloom.operators import keys as K
from sunloom.operators.bins import BIN


def active_dc(p_dc: Column, i_dc: Column, min_current: float = 0.25) -> Column:
    return F.coalesce(p_dc > 1.0, F.lit(False)) | F.coalesce(i_dc > min_current, F.lit(False))


def effectively_active(p_dc: Column, p_ac: Column, i_dc: Column, v_dc: Column) -> Column:
    no = F.lit(False)
    return (
        F.coalesce(F.abs(p_dc) > 1.0, no) | F.coalesce(F.abs(p_ac) > 1.0, no)
        | F.coalesce((F.abs(i_dc) > 0.2) & (F.abs(v_dc) > 1.0), no)
    )


def useful_merged(df: DataFrame) -> Column:
    """Any operative value, or a positive coverage, unless the bin says the inverter is missing."""
    names = ("p_ac_w", "p_dc_w", "v_ac_v", "i_ac_a", "v_dc_v", "i_dc_a", "e_ac_wh_15",
             *[f"mppt{k}_{c}" for c in ("vdc_v", "idc_a") for k in K.trackers_in(df.columns, c)])
    have = [F.col(n) for n in names if n in df.columns]
    value = F.coalesce(*have).isNotNull() if have else F.lit(False)
    covered = F.coalesce(F.col("inv_coverage") > 0, F.lit(False)) if "inv_coverage" in df.columns else F.lit(False)
    return ~flag("flag_inv_missing") & (covered | value)


def useful_diagnostic(df: DataFrame) -> Column:
    have = [F.col(n) for n in ("pac_real_w", "v_ac_v", "i_ac_a", "v_dc_v", "i_dc_a") if n in df.columns]
    return F.coalesce(*have).isNotNull() if have else F.lit(False)


def plant_from_trackers(df: DataFrame, keys: Sequence[str] = ("plant_id",), time: str = BIN) -> DataFrame:
    """Tracker rows → one synthetic aggregate row per instant."""
    src = F.col("source_oper")
    rows = df.filter(K.is_mppt(src))
    roots = rows.groupBy(*keys).agg(
        F.min(K.root(src)).alias("_r0"), F.max(K.root(src)).alias("_r1")
    ).select(*keys, F.when(F.col("_r0") == F.col("_r1"), F.concat("_r0", F.lit("|AGG"))).otherwise("PLANT|AGG").alias("source_oper"))
    have = set(df.columns)
    aggs = [F.sum(c).alias(c) for c in ("p_ac_w", "p_dc_w", "i_dc_a") if c in have]
    aggs += [F.avg(c).alias(c) for c in ("v_dc_v",) if c in have]
    firsts = ("v_ac_v", "i_ac_a", "freq_hz", *WEATHER_COLS, WEATHER_SCORE, "inv_coverage")
    aggs += [first_by(F.col(c), src).alias(c) for c in firsts if c in have]
    aggs += [F.max(flag(c)).alias(c) for c in (*WEATHER_FLAGS, "flag_low_coverage") if c in have]
    aggs += [F.min(flag(c)).alias(c) for c in ("flag_meteo_missing", "flag_inv_missing") if c in have]
    out = rows.groupBy(*keys, time).agg(*aggs)
    return out.join(roots, list(keys)).withColumns(
        {"alarm_code": F.lit(None).cast("int"), "alarm_sev": F.lit(None).cast("int")}
    )


def plant_totals(
    df: DataFrame, keys: Sequence[str] = ("plant_id",), time: str = BIN, rank: Column | None = None,
    style: str = "runtime",
) -> DataFrame:
    """One total per instant: trackers if any, else aggregates, else whatever is present.

    `style` picks the variant rules: `runtime` (interactive table), `summary` (AC current is summed)
    or `snapshot` (means skip zeros, DC only from active sources).  `rank` orders the sources.
    First one row per kind, then one row per instant: both steps combine before their shuffle.
    """
    src = F.col("source_oper")
    have = set(df.columns)
    order = F.struct((rank if rank is not None else F.lit(0)).alias("r"), src.alias("s"))
    names = ("p_ac_w", "p_dc_w", "v_dc_v", "i_dc_a", "v_ac_v", "i_ac_a", "freq_hz", "e_ac_wh_15", "inv_coverage")
    c = {n: F.col(n) if n in have else F.lit(None).cast("double") for n in names}
    level = F.when(K.is_mppt(src), 2).when(K.is_agg(src), 1).otherwise(0)
    on = active_dc(c["p_dc_w"], c["i_dc_a"]) & (c["v_dc_v"] > 0)
    busy = effectively_active(c["p_dc_w"], c["p_ac_w"], c["i_dc_a"], c["v_dc_v"])
    missing = flag("flag_inv_missing") if "flag_inv_missing" in have else F.lit(False)
    sky = [n for n in (*WEATHER_COLS, WEATHER_SCORE, *WEATHER_FLAGS, "flag_meteo_missing") if n in have]
    by_kind = df.groupBy(*keys, time, level.alias("_level")).agg(
        *[F.sum(c[n]).alias(n) for n in ("p_ac_w", "p_dc_w", "i_dc_a", "e_ac_wh_15")],
        *[F.avg(c[n]).alias(n) for n in ("v_dc_v", "v_ac_v", "freq_hz", "inv_coverage")],
        F.sum(c["i_ac_a"]).alias("iac_sum"), first_by(c["i_ac_a"], order).alias("iac_first"),
        F.min_by(c["i_ac_a"], order).alias("iac_ref"), mean_nonzero(c["i_ac_a"]).alias("iac_nz"),
        mean_nonzero(c["v_ac_v"]).alias("vac_nz"), F.avg(F.when(on, c["v_dc_v"])).alias("vdc_on"),
        F.count(F.when(busy, 1)).alias("busy"), mean_nonzero(F.when(busy, c["v_dc_v"])).alias("vdc_busy"),
        mean_nonzero(c["v_dc_v"]).alias("vdc_nz"), F.sum(F.when(busy, c["i_dc_a"])).alias("idc_busy"),
        F.min(missing).alias("miss_all"), F.max(missing).alias("miss_any"), F.count(F.lit(1)).alias("n"),
        F.min(order).alias("_first"), F.min_by(F.struct(*sky), order).alias("_sky") if sky else F.lit(None).alias("_sky"),
    )
    parts = [n for n in by_kind.columns if n not in (*keys, time, "_level", "_sky", "_first")]
    row = F.struct(*parts)
    g = by_kind.groupBy(*keys, time).agg(
        F.max("_level").alias("_top"), F.max_by(row, "_level").alias("t"),
        F.max(F.when(F.col("_level") == 1, row)).alias("a"), F.max(F.when(F.col("_level") == 2, F.col("p_ac_w"))).alias("_mppt"),
        F.sum("n").alias("n_sources"), F.min_by("_sky", "_first").alias("_sky"),
    )
    t, a = (lambda n: F.col(f"t.{n}")), (lambda n: F.col(f"a.{n}"))
    has_agg = F.col("a").isNotNull()
    top = F.col("_top")
    rules = {
        "runtime": {
            "p_ac_w": F.coalesce("_mppt", a("p_ac_w"), t("p_ac_w")), "v_dc_v": F.coalesce(t("vdc_on"), t("v_dc_v")),
            "i_dc_a": t("i_dc_a"), "v_ac_v": F.when(has_agg, a("v_ac_v")).otherwise(t("v_ac_v")),
            "i_ac_a": F.coalesce(a("iac_ref"), t("iac_first")),
            "freq_hz": F.when(has_agg, a("freq_hz")).otherwise(t("freq_hz")),
        },
        "summary": {
            "p_ac_w": t("p_ac_w"), "v_dc_v": t("v_dc_v"), "i_dc_a": t("i_dc_a"), "v_ac_v": t("v_ac_v"),
            "i_ac_a": t("iac_sum"), "freq_hz": t("freq_hz"),
        },
        "snapshot": {
            "p_ac_w": t("p_ac_w"), "v_dc_v": F.when(t("busy") > 0, t("vdc_busy")).otherwise(t("vdc_nz")),
            "i_dc_a": F.when(t("busy") > 0, t("idc_busy")).otherwise(t("i_dc_a")), "v_ac_v": t("vac_nz"),
            "i_ac_a": t("iac_nz"), "freq_hz": t("freq_hz"),
        },
    }[style]
    return g.select(
        *keys, time, "n_sources",
        F.when(top == 2, "mppt_sum").when(top == 1, "agg_fallback").otherwise("any_fallback").alias("policy_used"),
        *[e.alias(n) for n, e in rules.items()],
        t("p_dc_w").alias("p_dc_w"), t("e_ac_wh_15").alias("e_ac_wh_15"), t("inv_coverage").alias("inv_coverage"),
        F.col("_mppt").alias("p_ac_mppt_sum_w"), a("p_ac_w").alias("p_ac_agg_w"), t("busy").alias("active_n"),
        t("miss_all").alias("flag_inv_missing_all"), (t("miss_any") & ~t("miss_all")).alias("flag_inv_missing_partial"),
        *[F.col(f"_sky.{n}").alias(n) for n in sky],
    )


def reference_row(df: DataFrame, keys: Sequence[str], time: str, rank: Column, columns: Sequence[str]) -> DataFrame:
    """Values of the highest-priority source at each instant (unranked sources come last)."""
    order = F.struct(F.coalesce(rank, F.lit(2147483647)), F.col("source_oper"))
    return df.groupBy(*keys, time).agg(F.min_by(F.struct("source_oper", *columns), order).alias("_r")).select(
        *keys, time, "_r.*"
    )


def tracker_block(df: DataFrame, keys: Sequence[str], time: str = BIN, trackers: Sequence[int] | None = None) -> DataFrame:
    """One wide row per instant with the values of each `|MPPTk` source: the given trackers, or all that occur."""
    k = K.mppt_number(F.col("source_oper"))
    if trackers is None:
        trackers = K.trackers_seen(df)
    d = df.withColumn("_k", k).filter(F.col("_k").isin(list(trackers)))
    aggs = []
    for n in trackers:
        for c, out in (("p_ac_w", "pac_w"), ("p_dc_w", "pdc_w"), ("v_dc_v", "vdc_v"), ("i_dc_a", "idc_a")):
            aggs.append(F.max_by(c, F.when(F.col("_k") == n, F.col("source_oper"))).alias(f"mppt{n}_{out}"))
    return d.groupBy(*keys, time).agg(*aggs)


def side_by_side(df: DataFrame, keys: Sequence[str], names: dict[str, str], value: str, source: str = "source_oper", time: str = BIN) -> DataFrame:
    """One column per source for every instant: the largest value of the sources that `names` maps to it.

    Instants at which no listed source has a row stay, with NULLs.  The sources are given, so no pass looks for them.
    """
    column = F.col(source)
    wanted: dict[str, list[str]] = {}
    for s, n in names.items():
        wanted.setdefault(n, []).append(s)
    return df.groupBy(*keys, time).agg(*[F.max(F.when(column.isin(sources), F.col(value))).alias(n) for n, sources in wanted.items()])


def observed_trackers(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Highest tracker with any value, and the list 1..highest, over all mpptK columns there are."""
    numbers = sorted({*K.trackers_in(df.columns, "vdc_v"), *K.trackers_in(df.columns, "idc_a")})
    seen = [
        F.max(F.when(F.coalesce(*[F.col(f"mppt{k}_{c}") for c in ("vdc_v", "idc_a") if f"mppt{k}_{c}" in df.columns]).isNotNull(), k))
        for k in numbers
    ]
    top = F.coalesce(*([F.greatest(*seen)] if len(seen) > 1 else seen), F.lit(0))
    return df.groupBy(*keys).agg(top.alias("n_mppt")).withColumn(
        "mppts", F.when(F.col("n_mppt") > 0, F.sequence(F.lit(1), F.col("n_mppt"))).otherwise(F.array().cast("array<int>"))
    )


def fill_dc_model(totals: DataFrame, trackers: DataFrame, keys: Sequence[str], time: str = BIN) -> DataFrame:
    """Missing plant V/I expectation ← mean V and Σ I of the active trackers' expectations."""
    on = active_dc(F.col("p_dc_w"), F.col("i_dc_a"), 0.2)
    m = trackers.filter(on).groupBy(*keys, time).agg(F.avg("v_dc_model_v").alias("_v"), F.sum("i_dc_model_a").alias("_i"))
    return totals.join(m, [*keys, time], "left").withColumns(
        {"v_dc_model_v": F.coalesce("v_dc_model_v", "_v"), "i_dc_model_a": F.coalesce("i_dc_model_a", "_i")}
    ).drop("_v", "_i")


def kpis(df: DataFrame, keys: Sequence[str] = ("plant_id",), model: str | None = "pac_model_w") -> DataFrame:
    have = set(df.columns)
    e_model = (
        [(F.sum(F.greatest(F.col(model), F.lit(0.0)) * F.when(F.col(model).isNotNull(), 0.25)) / 1000).alias("energy_model_kwh")]
        if model in have else []
    )
    share = lambda n: F.avg(flag(n).cast("double"))
    return df.groupBy(*keys).agg(
        (F.coalesce(F.sum("e_ac_wh_15"), F.lit(0.0)) / 1000).alias("energy_kwh"), *e_model,
        F.max("p_ac_w").alias("p_ac_max_w"), F.max("ghi").alias("ghi_max_wm2"),
        F.avg("inv_coverage").alias("inv_coverage_mean"), share("flag_meteo_missing").alias("meteo_missing_frac"),
        share("flag_inv_missing_all").alias("inv_missing_frac"),
        share("flag_inv_missing_partial").alias("inv_partial_missing_frac"), F.count(F.lit(1)).alias("points"),
    )


def availability(df: DataFrame, keys: Sequence[str], time: str = BIN, distinct: Sequence[str] = (), last_days: int = 7) -> DataFrame:
    """First and last instant, the distinct versions/sources, and the default range (last days)."""
    return df.groupBy(*keys).agg(
        F.min(time).alias("ts_min"), F.max(time).alias("ts_max"),
        *[F.array_join(F.sort_array(F.collect_set(F.nullif(F.trim(F.col(c)), F.lit("")))), ",").alias(f"{c}_list") for c in distinct],
    ).withColumn("default_start", F.col("ts_max") - F.expr(f"INTERVAL {int(last_days)} DAYS"))


def latest_sources(df: DataFrame, keys: Sequence[str] = ("plant_id",), time: str = BIN) -> DataFrame:
    """Source pair of the most recent row (same instant: alphabetically first)."""
    pair = F.struct("source_oper", "source_meteo")
    d = df.filter(F.col("source_oper").isNotNull() & F.col("source_meteo").isNotNull())
    pick = F.min_by(pair, F.struct(-F.unix_micros(F.col(time)), "source_oper", "source_meteo"))
    return d.groupBy(*keys).agg(pick.alias("_p")).select(*keys, "_p.*")


def device_inventory(df: DataFrame, keys: Sequence[str], device: str = "device_key") -> DataFrame:
    return df.groupBy(*keys, device).agg(F.count(F.lit(1)).alias("n_rows"))


def topology(configs: DataFrame, key: str = "plant_id") -> DataFrame:
    """Strings and modules per plant; modules per string only when it is the same everywhere."""
    n, q = F.col("modules_per_string"), F.col("strings_qty")
    return configs.groupBy(key).agg(
        F.sum(q).alias("strings_count"), F.sum(q * n).alias("modules_total"),
        F.when(F.min(n) == F.max(n), F.min(n)).alias("modules_per_string"),
    )


def tracker_nominals(configs: DataFrame, key: str = "plant_id") -> DataFrame:
    """Strings in parallel and the most common series length per tracker (ties: shortest)."""
    lengths = configs.groupBy(key, "mppt", "modules_per_string").agg(
        F.count(F.lit(1)).alias("_c"), F.sum("strings_qty").alias("_q")
    )
    return lengths.groupBy(key, "mppt").agg(
        F.sum("_q").alias("n_parallel"),
        F.min_by("modules_per_string", F.struct(-F.col("_c"), F.col("modules_per_string"))).alias("n_series"),
    )


def with_plant(df: DataFrame, plants: DataFrame, key: str = "plant_id") -> DataFrame:
    """Attach plant attributes; AQE broadcasts the dimension when its actual size allows."""
    return df.join(plants, key, "left")


def string_groups(configs: DataFrame, key: str = "plant_id") -> DataFrame:
    """Per tracker the list of (parallel, series) string groups, bounded by the plant's wiring."""
    return configs.groupBy(key, "mppt").agg(
        F.sort_array(F.collect_list(F.struct(F.col("strings_qty").alias("np"), F.col("modules_per_string").alias("ns")))).alias("groups")
    )
