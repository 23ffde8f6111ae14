"""Sky stability, gating, robust baselines and EWMA/CUSUM anomaly detection."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunloom.config import DetectConfig, LegacyConfig
from sunloom.functions import timegrid as tg
from sunloom.functions import values as V
from sunloom.operators import residuals as R
from sunloom.operators import series as S
from sunloom.session import stored

Channels = dict[str, tuple[Column, Column]]


def trailing_cv(g: str, w, window: int) -> Column:
    """Population coefficient of variation of the last rows; half the window must be known."""
    frame = w.rowsBetween(-(window - 1), 0)
    mean = F.avg(g).over(frame)
    enough = (F.count(g).over(frame) >= max(3, window // 2)) & (F.abs(mean) >= 1e-9)
    return F.when(enough, F.stddev_pop(g).over(frame) / F.abs(mean))


def abs_ramp(g: str, w) -> Column:
    """|change| to the previous row; the very first row counts as no change."""
    first = F.col(S.POS) == 0
    return F.when(first, F.when(F.col(g).isNotNull(), 0.0)).otherwise(F.abs(F.col(g) - F.lag(g).over(w)))


def hour_stability(g: str, w, rows: int = 4, eps_mean: float = 50.0) -> dict[str, Column]:
    """Trailing hour mean, deviation and CV, from the first complete hour on."""
    frame = w.rowsBetween(-(rows - 1), 0)
    full = F.col(S.POS) >= rows - 1
    mean, std = F.when(full, F.avg(g).over(frame)), F.when(full, F.stddev_pop(g).over(frame))
    return {"g_mean_60m": mean, "g_std_60m": std, "g_cv_60m": std / F.greatest(mean, F.lit(eps_mean))}


def sky_metrics(df: DataFrame, s: S.Series, cfg: DetectConfig = DetectConfig(), g: str = "g_poa") -> DataFrame:
    """Blocked table with cv and ramp, which depend on no threshold."""
    b = S.blocks(S.packed(df, [*s.keys, *s.order, g]), s, before=cfg.window)
    return S.unpacked(S.core(b.withColumns({"gpoa_cv": trailing_cv(g, s.blocked, cfg.window), "gpoa_ramp": abs_ramp(g, s.blocked)})), df.columns)


def sky_state(df: DataFrame, s: S.Series, cfg: DetectConfig = DetectConfig(), g: str = "g_poa") -> DataFrame:
    """Blocked table with cv, ramp, `stable_sky` and `meteo_quality_ok`."""
    return sky_flags(sky_metrics(df, s, cfg, g), cfg)


def sky_flags(b: DataFrame, cfg: DetectConfig = DetectConfig()) -> DataFrame:
    stable = V.flag(F.col("gpoa_cv") <= cfg.max_cv)
    return b.withColumns({"stable_sky": stable, "meteo_quality_ok": stable & V.flag(F.col("gpoa_ramp") <= cfg.max_ramp)})


def period_flags(df: DataFrame, cfg: DetectConfig, signal: str = "signal", g: str = "g_poa") -> DataFrame:
    """valid, coarse, ready and fine periods and the irradiance tier."""
    gv, vm = F.col(g), V.flag("valid_model")
    data_ok = ~V.flag("flag_meteo_missing") & ~V.flag("flag_inv_missing") & V.flag(F.col("inv_coverage") >= cfg.min_coverage)
    judged = vm & F.col(signal).isNotNull()
    df = df.withColumn("valid_period", data_ok & V.flag(gv >= cfg.sun_g))
    valid = F.col("valid_period")
    # what is cheap to test comes first: most rows need no signal
    df = df.withColumn("coarse_period", valid & V.flag(gv >= cfg.coarse_g) & judged)
    return df.withColumns(
        {
            "residual_ready": F.col("coarse_period") & F.col("meteo_quality_ok"),
            "fine_period": valid & V.flag(gv >= cfg.fine_g) & F.col("meteo_quality_ok") & judged
            & ~V.flag("flag_meteo_low_confidence") & ~V.flag("flag_meteo_interpolated"),
            "irradiance_tier": V.irradiance_tier(gv, cfg.coarse_g, cfg.fine_g),
        }
    )


def baseline(df: DataFrame, s: S.Series, cfg: DetectConfig, signal: str = "signal", g: str = "g_poa", store: bool = False) -> DataFrame:
    """Blocked table with the contextual median and scale of every row.

    Two small per-series aggregations (medians, then deviations) spread back over the blocks.  The
    base rows are the ready ones, or all coarse ones where those are too few: both are summarised at
    once and the choice is made on the summaries.  Rows outside the valid period are of neither kind and are left out.
    """
    x, gv = F.col(signal), F.col(g)
    groups = {"all": F.lit(True), "coarse": V.flag(gv < cfg.fine_g), "fine": V.flag(gv >= cfg.fine_g)}
    masks = {"r": F.col("residual_ready"), "c": F.col("coarse_period")}
    member = {(m, n): F.when(mask & c, x) for m, mask in masks.items() for n, c in groups.items()}
    # told by the cheap half of both tests: the optimizer would write the whole signal into the filter
    judged = df.filter(V.flag("valid_period"))
    stats = judged.groupBy(*s.keys).agg(
        F.count_if("residual_ready").alias("_n_ready"),
        *[F.percentile(v, 0.5).alias(f"_med_{m}_{n}") for (m, n), v in member.items()],
        *[F.stddev_pop(v).alias(f"_std_{m}_{n}") for (m, n), v in member.items()],
        *[F.count(v).alias(f"_cnt_{m}_{n}") for (m, n), v in member.items()],
    )
    ready = F.col("_n_ready") >= cfg.baseline_min
    med = stats.select(
        *s.keys, ready.alias("_use_ready"),
        *[F.when(ready, F.col(f"_{p}_r_{n}")).otherwise(F.col(f"_{p}_c_{n}")).alias(f"_{p}_{n}") for p in ("med", "std", "cnt") for n in groups],
    )
    med = stored(med) if store else med
    base = F.when(F.col("_use_ready"), masks["r"]).otherwise(masks["c"])
    mad = S.attach(judged, med, s, store).groupBy(*s.keys).agg(
        *[F.percentile(F.when(base & c, F.abs(x - F.col(f"_med_{n}"))), 0.5).alias(f"_mad_{n}") for n, c in groups.items()]
    )
    df = S.attach(df, S._join(med, mad, s.keys), s, store)
    df = df.withColumns({f"_cnt_{n}": F.coalesce(f"_cnt_{n}", F.lit(0).cast("long")) for n in groups})
    scale = {}
    for n in groups:
        robust = F.col(f"_mad_{n}") * 1.4826
        std = F.col(f"_std_{n}")
        sigma = F.when(robust >= 1e-6, robust).when(std >= 1e-6, std).otherwise(1.0)
        scale[n] = F.when(F.col(f"_cnt_{n}") > 0, F.greatest(sigma, F.lit(cfg.sigma_floor))).otherwise(max(1.0, cfg.sigma_floor))
    use_fine = V.flag(gv >= cfg.fine_g) & (F.col("_cnt_fine") >= cfg.context_min)
    use_coarse = gv.isNotNull() & (F.col("_cnt_coarse") >= cfg.context_min)
    chosen = lambda v: F.when(use_fine, v("fine")).when(use_coarse, v("coarse")).otherwise(v("all"))
    med_of = lambda n: F.coalesce(F.col(f"_med_{n}"), F.lit(0.0))
    out = df.withColumns({"ctx_median": chosen(med_of), "ctx_sigma": chosen(lambda n: scale[n]), "n_base": F.col("_cnt_all")})
    return out.drop("_use_ready", *[f"_{p}_{n}" for p in ("med", "std", "cnt", "mad") for n in groups])


def detect_anomalies(df: DataFrame, s: S.Series, channels: Channels | None = None, cfg: DetectConfig = DetectConfig(),
                     base: str = "mismatch_rel", g: str = "g_poa") -> DataFrame:
    """The full detector on one table: stability → fusion → periods → baseline → z → EWMA ∨ CUSUM.

    The table is needed several times (statistics, deviations, filters), so its blocks are stored
    instead of being recomputed in every branch.
    """
    s = S.for_ewma(s, cfg.ewma_lambda)
    return detect_blocked(stored(sky_metrics(df, s, cfg, g)), s, channels, cfg, base, g)


def detect_blocked(b: DataFrame, s: S.Series, channels: Channels | None = None, cfg: DetectConfig = DetectConfig(),
                   base: str = "mismatch_rel", g: str = "g_poa") -> DataFrame:
    """The detector from the stored blocks of `sky_metrics` on; they are read once for every summary.

    Only the last reading carries whole rows through a shuffle: the summaries are stored, so small ones are broadcast.
    """
    none = (F.lit(None).cast("double"),) * 2
    ch = {n: (channels or {}).get(n, none) for n in ("p_ac", "p_dc", "v_dc", "i_dc")}
    b = sky_flags(b, cfg)
    signal, support, conf = R.fused_signal(
        F.col(base), ch, F.col("valid_model"), dict(cfg.weights), cfg.default_conf_ac, cfg.default_conf_dc, cfg.min_support
    )
    b = b.withColumns({"signal": signal, "signal_support": support, "signal_confidence": conf})
    b = period_flags(b, cfg, "signal", g)
    b = baseline(b, s, cfg, "signal", g, store=True)
    extra = lambda f, gain: F.when(V.flag(f), gain).otherwise(0.0)
    inflation = (
        1.0 + cfg.gain_conf * F.greatest(F.lit(0.0), 1.0 - F.coalesce("signal_confidence", F.lit(0.75)))
        + extra("flag_meteo_low_confidence", cfg.gain_low) + extra("flag_meteo_interpolated", cfg.gain_interp)
    )
    b = b.withColumn("sigma_eff", F.greatest(F.col("ctx_sigma") * inflation, F.lit(cfg.sigma_floor)))
    b = b.withColumn("z", (F.col("signal") - F.col("ctx_median")) / F.col("sigma_eff"))
    b = S.add_filters(b, s, "z", F.col("residual_ready"), cfg.ewma_lambda, cfg.cusum_k, ewma="ewma_z", store=True)
    limit = cfg.ewma_limit * math.sqrt(cfg.ewma_lambda / (2.0 - cfg.ewma_lambda))
    anomaly = V.flag(F.abs("ewma_z") > limit) | V.flag(F.col("cusum_score") > cfg.cusum_h)
    return S.without_marks(b.withColumn("anomaly", anomaly))


def base_gate(g: Column, pac: Column, valid: Column, meteo_missing: Column, inv_missing: Column, gate: float, pmin: float) -> tuple[Column, Column]:
    """Interactive gate and the joined names of what failed (`ok` when nothing did)."""
    tests = {
        "invalid_model": V.flag(valid), "low_gpoa": V.flag(g >= gate), "low_pac": V.flag(pac >= pmin),
        "meteo_missing": ~V.flag(meteo_missing), "inv_missing": ~V.flag(inv_missing),
    }
    ok = F.lit(True)
    for t in tests.values():
        ok = ok & t
    why = F.concat_ws(";", *[F.when(~t, n) for n, t in tests.items()])
    return ok, F.when(why == "", "ok").otherwise(why)


def plot_mismatch(mm: Column, g: Column, model: Column, real: Column, missing: Column, g_min: float, model_min: float, clip: float) -> Column:
    shown = mm.isNotNull() & (g >= g_min) & (F.abs(model) >= model_min) & real.isNotNull() & ~V.flag(missing)
    return F.when(V.flag(shown), V.clip_abs(mm, clip))


# fixed values: 0 invalid, 1 normal, 2 degradation, 3 string_disconnected, 4 meteo_error
LEGACY_CODES = {"invalid": 0, "normal": 1, "degradation": 2, "string_disconnected": 3, "meteo_error": 4}


def legacy_label(mm: Column, g: Column, valid: Column, cfg: LegacyConfig = LegacyConfig()) -> Column:
    usable = V.flag(valid) & V.flag(g >= cfg.g_gate) & mm.isNotNull()
    return (
        F.when(~usable, "invalid").when(F.abs(mm) < cfg.normal_abs, "normal").when(mm >= cfg.meteo_error_pos, "meteo_error")
        .when(mm <= cfg.disconnected_neg, "string_disconnected").otherwise("degradation")
    )


def legacy_events(df: DataFrame, s: S.Series, label: str = "label", mm: str = "mismatch_rel", cfg: LegacyConfig = LegacyConfig()) -> DataFrame:
    """Runs of abnormal rows, joined when the pause between two runs is short enough."""
    d = df.withColumn("_abn", ~F.col(label).isin("invalid", "normal"))
    b = S.blocks(d, s, before=1)
    b = b.withColumns({"_prev": F.lag("_abn").over(s.blocked), "_prev_ts": F.lag(F.when(F.col("_abn"), F.col(s.time))).over(s.blocked)})
    b = S.running(S.core(b), s, {"_last": ("last", F.col("_prev_ts"))})
    pause = tg.minutes_between(s.time, "_last")
    opens = F.col("_abn") & ~V.flag("_prev") & (F.col("_last").isNull() | (pause > cfg.max_gap_minutes))
    rows = S.islands(b, s, V.flag(opens)).filter("_abn").withColumn("code", V.lookup(F.col(label), LEGACY_CODES))
    return rows.groupBy(*s.keys, "island").agg(
        F.min(s.time).alias("start_utc"), F.max(s.time).alias("end_utc"), F.count(F.lit(1)).alias("n_points"),
        F.max(F.abs(mm)).alias("max_abs_mismatch"), F.avg(F.abs(mm)).alias("mean_abs_mismatch"),
        F.mode(label, True).alias("dominant_label"), F.mode("code", True).alias("dominant_code"),
    ).drop("island")


def persistent_faults(df: DataFrame, s: S.Series, code: str = "code", bin_minutes: int = 15, min_minutes: int = 60,
                      normal: int = 0, invalid: int | None = -1) -> DataFrame:
    """Runs of one code that are too short become normal; the invalid code stays as it is."""
    need = math.ceil(min_minutes / bin_minutes)
    marked = S.previous(df, s, {"_was": code})
    rows = S.islands(marked, s, F.col("_was").isNull() | (F.col("_was") != F.col(code)))
    sizes = rows.groupBy(*s.keys, "island").agg(F.count(F.lit(1)).alias("_run"))
    out = S._join(rows, sizes, [*s.keys, "island"])
    fault = F.col(code) != normal
    if invalid is not None:
        fault = fault & (F.col(code) != invalid)
    stable = F.when(fault & (F.col("_run") < need), normal).otherwise(F.col(code))
    return S.without_marks(out.withColumn("code_stable", stable)).drop("_was", "island", "_run")
