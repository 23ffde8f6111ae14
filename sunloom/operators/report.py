"""Heatmap, period summaries, rankings, chart tables and per-bin records."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunloom.functions import timegrid as tg
from sunloom.functions import values as V
from sunloom.operators import events as E
from sunloom.operators import keys as K
from sunloom.operators import totals as TT
from sunloom.operators.bins import BIN, over_steps

NONE, OK, WARN, CRIT = 0, 1, 2, 3
QUIET = ("", "-", "invalid", "normal", "ok")


def reliability_gauge(df: DataFrame, keys: Sequence[str], cv: str = "g_cv_60m", high: float = 0.10, low: float = 0.40) -> DataFrame:
    """Score 0..100 and word from the median hourly CV of the period."""
    g = df.groupBy(*keys).agg(F.percentile(cv, 0.5).alias("gcv_stat"))
    x = F.greatest(F.least((F.col("gcv_stat") - high) / max(low - high, 1e-9), F.lit(1.0)), F.lit(0.0))
    s = F.col("gcv_stat")
    # fixed values: the words the report shows
    word = F.when(s.isNull(), "Indisponível").when(s <= high, "Alta").when(s >= low, "Baixa").otherwise("Média")
    return g.withColumns({"score": F.when(s.isNotNull(), F.bround(100.0 * (1.0 - x)).cast("int")), "label": word})


def loss_waterfall(df: DataFrame, keys: Sequence[str], bin_minutes: float = 15.0) -> DataFrame:
    """Energies after each loss step and the losses between them, in kWh."""
    c = F.col
    use = V.flag("valid") & V.flag(c("g_poa") > 0)
    pos = lambda x: F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0))
    h = bin_minutes / 60.0 / 1000.0
    steps = {
        "e_stc": pos(c("p_stc_w")), "e_after_g": pos(c("p_stc_w")) * c("g_poa") / 1000.0, "e_after_t": pos(c("p_dc_exp_w")),
        "e_after_sys": pos(c("p_ac_exp_w")) / F.greatest("eta_inv", F.lit(1e-9)), "e_ac": pos(c("p_ac_exp_w")),
    }
    g = df.groupBy(*keys).agg(*[(F.coalesce(F.sum(F.when(use, e)), F.lit(0.0)) * h).alias(n) for n, e in steps.items()])
    names = list(steps)
    losses = {"loss_irradiance": 0, "loss_temperature": 1, "loss_system": 2, "loss_inverter": 3}
    return g.withColumns({n: F.greatest(c(names[i]) - c(names[i + 1]), F.lit(0.0)) for n, i in losses.items()})


def waterfall_links(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The waterfall as (source, target, value) links of the flow chart."""
    pairs = [(0, 1, "e_after_g"), (1, 2, "e_after_t"), (2, 3, "e_after_sys"), (3, 4, "e_ac"), (4, 5, "e_ac"), (0, 6, "loss_irradiance"),
             (1, 7, "loss_temperature"), (2, 8, "loss_system"), (3, 9, "loss_inverter")]
    rows = [F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"), F.col(v).alias("value")) for a, b, v in pairs]
    return table.select(*keys, F.inline(F.array(*rows)))


# fixed values: ratio cause → diagnostic code
CAUSE_CODES = {"invalid": 0, "normal": 1, "unknown": 2, "n/a": 2, "soiling": 3, "degradation_like": 4, "short_or_bypass": 5,
               "string_disconnected": 6, "partial_shading": 7}


def diagnostic_code(cause: Column, valid: Column) -> Column:
    return F.when(~V.flag(valid), 0).otherwise(V.lookup(cause, CAUSE_CODES, F.lit(2)))


def scatter_points(df: DataFrame, keys: Sequence[str], time: str = BIN) -> DataFrame:
    """Valid bins with both coordinates, coloured by code."""
    shown = V.flag("valid") & F.col("g_cv_60m").isNotNull() & F.col("mismatch_rel").isNotNull()
    return df.filter(shown).select(*keys, time, F.col("g_cv_60m").alias("x_gcv"), F.col("mismatch_rel").alias("y_mismatch"), "code")


def quality_word(score: Column) -> Column:
    # fixed values: the words the report shows
    return (F.when(score.isNull(), "indeterminado").when(score >= 0.80, "alta").when(score >= 0.55, "média").when(score >= 0.30, "baixa").otherwise("muito baixa"))


def state_of_class(name: Column) -> Column:
    return V.lookup(F.lower(F.trim(F.coalesce(name, F.lit("")))), {"ok": OK, "warn": WARN, "crit": CRIT}, F.lit(NONE))


def state_of_code(code: Column, valid: Column) -> Column:
    """0 ok, 1 and 2 warn, 3 and 4 critical; invalid bins have no state."""
    return F.when(~V.flag(valid) | code.isNull(), NONE).when(code == 0, OK).when(code.isin(3, 4), CRIT).otherwise(WARN)


def report_label(state: Column, label: Column, diagnosis: Column, mode: str = "fault_type") -> Column:
    mismatch = mode in ("mismatch", "mismatch_power", "power_mismatch")
    text = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    base = F.coalesce(text(label), text(diagnosis), F.lit("invalid"))
    low = F.lower(base)
    plain = low.isin("ok", "normal", "", "-")
    alarm = ("severe_power_mismatch", "power_mismatch_warning") if mismatch else ("critical_operational_anomaly", "operational_anomaly_warning")
    return (
        F.when((state == NONE) & plain, "invalid").when((state == OK) & plain, "ok")
        .when((state == CRIT) & (plain | (low == "invalid")), alarm[0]).when((state == WARN) & (plain | (low == "invalid")), alarm[1]).otherwise(base)
    )


def report_points(df: DataFrame, tz: Column | str = "UTC", time: str = BIN, mode: str = "fault_type") -> DataFrame:
    """Per-bin report rows: state (class first, else code), display label, local day and month."""
    c = F.col
    have = set(df.columns)
    cls = c("heatmap_class") if "heatmap_class" in have else F.lit(None).cast("string")
    state = F.when(F.trim(F.coalesce(cls, F.lit(""))) != "", state_of_class(cls)).otherwise(state_of_code(c("diagnosis_code"), c("valid_period")))
    d = df.withColumn("state", state)
    wall = tg.local(time, tz)
    return d.withColumns({"label": report_label(c("state"), c("diagnosis_label"), c("diagnosis_label"), mode), "day": F.to_date(wall), "month": F.date_format(wall, "yyyy-MM")})


def _states() -> list[Column]:
    return [F.count_if(F.col("state") == k).alias(n) for k, n in ((OK, "n_ok"), (WARN, "n_warn"), (CRIT, "n_crit"), (NONE, "n_none"))]


def _loud() -> Column:
    return (F.col("state") != NONE) & ~F.lower("label").isin(*QUIET)


def _dominant(points: DataFrame, keys: Sequence[str], where: Column, time: str) -> DataFrame:
    """Most frequent label; equal counts go to the one seen first."""
    n = points.filter(where).groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("_n"), F.min(time).alias("_t"))
    return n.groupBy(*keys).agg(F.min_by("label", F.struct(-F.col("_n"), F.col("_t"), F.col("label"))).alias("dominant_label"))


def monthly_rows(points: DataFrame, keys: Sequence[str], time: str = BIN) -> DataFrame:
    k = [*keys, "month"]
    live = F.col("state") != NONE
    means = [F.avg(F.when(live, F.col(c))).alias(f"{c}_mean") for c in ("data_score", "detect_score", "diag_score") if c in points.columns]
    out = points.groupBy(*k).agg(*_states(), *means)
    return out.join(_dominant(points, k, _loud(), time), k, "left").withColumn("dominant_label", F.coalesce("dominant_label", F.lit("-")))


def daily_rows(points: DataFrame, keys: Sequence[str], time: str = BIN) -> DataFrame:
    k = [*keys, "day"]
    return points.groupBy(*k).agg(*_states()).join(_dominant(points, k, F.lit(True), time), k, "left")


def critical_days(points: DataFrame, keys: Sequence[str], limit: int = 18, weighted: bool = False, time: str = BIN) -> DataFrame:
    """Worst days: by critical then warning bins (or 100·critical + warnings), largest mismatch, confidence."""
    k = [*keys, "day"]
    live = F.col("state") != NONE
    d = points.groupBy(*k).agg(
        F.count_if(F.col("state") == CRIT).alias("n_crit"), F.count_if(F.col("state") == WARN).alias("n_warn"),
        F.coalesce(F.max(F.when(live, F.abs("mismatch_rel"))), F.lit(0.0)).alias("max_mismatch"), F.avg(F.when(live, F.col("diag_score"))).alias("diag_mean"),
    )
    d = d.join(_dominant(points, k, _loud(), time), k, "left").withColumn("dominant_label", F.coalesce("dominant_label", F.lit("-")))
    size = [(F.col("n_crit") * 100 + F.col("n_warn")).desc()] if weighted else [F.col("n_crit").desc(), F.col("n_warn").desc()]
    return K.rank_rows(d, keys, [*size, F.col("max_mismatch").desc(), F.coalesce("diag_mean", F.lit(0.0)).desc(), F.col("day")], limit)


def worst_bins(points: DataFrame, keys: Sequence[str], limit: int = 30, time: str = BIN) -> DataFrame:
    bad = points.filter(F.col("state").isin(WARN, CRIT))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).desc()
    return K.rank_rows(bad, keys, [F.col("state").desc(), zero(F.abs("mismatch_rel")), zero(F.col("diag_score")), F.col(time)], limit)


def period_summary(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    live, loud = F.col("state") != NONE, _loud()
    low = lambda c: F.count_if(live & (F.coalesce(c, F.lit(0.0)) < 0.55))
    mean = lambda c: F.avg(F.when(live, F.col(c)))
    return points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_points"), *_states(), F.count_if(live).alias("valid_points"), F.count_if(loud).alias("diag_points"),
        low("data_score").alias("low_data_points"), low("diag_score").alias("low_diag_points"), mean("data_score").alias("data_mean"),
        mean("detect_score").alias("detect_mean"), mean("diag_score").alias("diag_mean"),
        F.count_if(loud & V.flag("grid_evidence")).alias("direct_grid_points"), F.count_if(loud & V.flag("zero_injection")).alias("zero_injection_points"),
    )


def top_values(points: DataFrame, keys: Sequence[str], value: str, limit: int = 5, time: str = BIN) -> DataFrame:
    n = points.filter(_loud()).groupBy(*keys, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("_t"))
    w = Window.partitionBy(*keys).orderBy(F.col("n").desc(), F.col("_t"), F.col("value"))
    return n.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).drop("_t")


# fixed values: mismatch warning thresholds of the heatmap
WARN_REL, WARN_SINGLE, WARN_G, WARN_QC, GREEN_CONF, GUARD_CONF = 0.10, 0.20, 700.0, 0.60, 0.70, 0.45


def warn_bins(diag: DataFrame, keys: Sequence[str], tz: Column | str = "UTC", time: str = BIN, bin_minutes: int = 15) -> DataFrame:
    """Underperforming bins that have a neighbour on the same day or are strong on their own."""
    c = F.col
    g = F.coalesce(*[c(n) for n in ("g_poa", "gti", "ghi") if n in diag.columns])
    under = F.when(c("mismatch_rel").isNotNull(), F.greatest(F.lit(0.0), -c("mismatch_rel")))
    sky_ok = ~V.flag("flag_meteo_missing") & ~V.flag("flag_meteo_low_confidence") & F.coalesce(c("meteo_qc_score") >= WARN_QC, F.lit(True))
    cand = (
        V.flag("valid_period") & TT.useful_diagnostic(diag) & sky_ok & (under >= WARN_REL) & F.coalesce(g >= WARN_G, F.lit(True))
        & F.coalesce(c("stable_sky"), F.lit(True))
    )
    wall = tg.local(time, tz)
    d = diag.filter(cand).select(*keys, F.to_date(wall).alias("day"), tg.bin_of_day(wall, bin_minutes).alias("bin"), under.alias("underperformance"), V.flag("flag_meteo_interpolated").alias("interp"), c(time))
    d = d.groupBy(*keys, "day", "bin").agg(F.max_by("underperformance", time).alias("underperformance"), F.max_by("interp", time).alias("interp"))
    w = Window.partitionBy(*keys, "day").orderBy("bin")
    near = V.flag(c("bin") - F.lag("bin").over(w) == 1) | V.flag(F.lead("bin").over(w) - c("bin") == 1)
    d = d.withColumn("persistent", near).filter(c("persistent") | (c("underperformance") >= WARN_SINGLE))
    return d.withColumn("warn_label", F.when(c("interp"), "warn_mismatch_interp").otherwise("warn_mismatch"))


def heatmap(merged: DataFrame, diag: DataFrame, event_cells: DataFrame, keys: Sequence[str], tz: Column | str = "UTC", time: str = BIN,
            bin_minutes: int = 15) -> DataFrame:
    """Coverage, then diagnostics, events and warnings laid over (plant, day, bin).

    `event_cells` comes from `events.event_bins` with label, state, confidence and the event id.
    """
    c = F.col
    k = [*keys, "day", "bin"]

    def cells(df: DataFrame) -> DataFrame:
        wall = tg.local(time, tz)
        return df.withColumns({"day": F.to_date(wall), "bin": tg.bin_of_day(wall, bin_minutes)})

    base = cells(merged).groupBy(*k).agg(F.max(TT.useful_merged(merged)).alias("_cov"))
    label = F.nullif(F.lower(F.trim("diagnosis_label")), F.lit(""))
    d = cells(diag).join(base, k, "left")
    oper = V.flag("_cov") | TT.useful_diagnostic(diag)
    state = F.when(V.flag("anomaly_flag") & oper, CRIT).when(oper, OK).otherwise(NONE)
    shown = (
        F.when(state == CRIT, F.coalesce(label, F.lit("anomaly"))).when(state == OK, F.coalesce(label, F.when(V.flag("valid_period"), "normal").otherwise("coverage_only")))
        .otherwise(F.coalesce(label, F.when(V.flag("valid_period"), "no_oper_data").otherwise("invalid")))
    )
    rank = F.struct((F.when(state == CRIT, 1e7).otherwise(1e6) + F.coalesce("detector_score", F.lit(0.0))).alias("s"), (-F.unix_micros(time)).alias("t"))
    green = ~V.flag("flag_meteo_missing") & ~V.flag("flag_meteo_low_confidence")
    best = d.groupBy(*k).agg(F.max_by(F.struct(state.alias("state"), shown.alias("label"), green.alias("green")), rank).alias("_d"))
    e = event_cells.select(*k, c("label").alias("_el"), c("state").alias("_es"), c("confidence").alias("_ec"), c("event_id"))
    g = base.join(best, k, "full").join(e, k, "full").join(warn_bins(diag, keys, tz, time, bin_minutes).select(*k, "warn_label"), k, "full")
    cov = V.flag("_cov")
    g = g.withColumns({"state": F.coalesce("_d.state", F.when(cov, OK).otherwise(NONE)), "label": F.coalesce("_d.label", F.when(cov, "coverage_only").otherwise("")), "_green": V.flag("_d.green")})
    benign = F.coalesce(c("_el").isin(*E.BENIGN_EVENTS), F.lit(False))
    was_crit = c("state") == CRIT
    to_ok = benign & was_crit & V.flag(c("_ec") >= GREEN_CONF) & c("_green")
    to_warn = benign & was_crit & V.flag(c("_ec") >= GUARD_CONF) & c("_green") & ~to_ok
    crit = V.flag(c("_es") == CRIT)
    lift = benign & (c("state") == NONE)
    new_state = F.when(crit, CRIT).when(to_ok | lift, OK).when(to_warn, WARN).otherwise(c("state"))
    named = lambda a, b: F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")), F.lit(""))
    new_label = (
        F.when(crit, F.coalesce(F.nullif(named(c("_el"), c("label")), F.lit("")), F.lit("anomaly"))).when(to_ok | lift, c("_el")).when(to_warn, "warn_refined_guard")
        .when(benign & ~was_crit, named(c("_el"), c("label"))).when(c("_el").isNotNull(), named(c("label"), c("_el"))).otherwise(c("label"))
    )
    g = g.withColumns({"_s": new_state, "_l": new_label})
    warn = c("warn_label").isNotNull() & (c("_s") == OK)
    soft = c("_l").isin("", "coverage_only", "normal", "curtailment_clipping", "meteo_bias")
    final = F.when(warn & soft, c("warn_label")).otherwise(c("_l"))
    g = g.withColumns({"state": F.when(warn, WARN).otherwise(c("_s")), "label": final})
    filled = V.lookup(c("state"), {NONE: "sem_diagnostico", OK: "normal", WARN: "warn_mismatch", CRIT: "anomaly"})
    return g.select(*k, "state", F.coalesce(F.nullif("label", F.lit("")), filled).alias("label"), "event_id")


def dense_heatmap(cells: DataFrame, ranges: DataFrame, keys: Sequence[str], bin_minutes: int = 15) -> DataFrame:
    """Every bin of every day in the range; empty ones have state 0."""
    day = F.explode(F.sequence(F.to_date("range_start"), F.date_sub(F.to_date("range_end"), 1)))
    full = over_steps(ranges.select(*keys, day.alias("day")), "bin", 1440 // bin_minutes)
    out = full.join(cells, [*keys, "day", "bin"], "left")
    return out.withColumns({"state": F.coalesce("state", F.lit(NONE)), "label": F.coalesce("label", F.lit("sem_diagnostico"))})


def bin_records(sources: DataFrame, model: DataFrame, keys: Sequence[str], source_cols: Sequence[str], groups: dict[str, Sequence[str]], tz: Column | str = "UTC",
                time: str = BIN) -> DataFrame:
    """One nested JSON record per bin: values by source plus named groups of the bin's own columns."""
    s = sources.groupBy(*keys, time).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source_oper", F.struct(*source_cols))))).alias("sources"))
    j = model.join(s, [*keys, time], "left")
    wall = tg.local(time, tz)
    parts = [F.struct(*[c for c in cols if c in model.columns]).alias(n) for n, cols in groups.items()]
    rec = F.to_json(F.struct(tg.minute_key(wall).alias("tkey"), F.col("sources"), *parts))
    return j.select(*keys, time, tg.minute_key(wall).alias("tkey"), rec.alias("record"))


def late_day(wall: Column) -> Column:
    return tg.minute_of_day(wall) >= 16 * 60 + 30
