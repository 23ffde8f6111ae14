"""Observed minus expected on four electrical channels, with gates and confidences."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunloom.functions import values as V

# fixed values: observed column, expected column, smallest denominator
CHANNELS = {
    "p_ac": ("p_ac_w", "p_ac_exp_w", 50.0), "p_dc": ("p_dc_w", "p_dc_exp_w", 50.0),
    "v_dc": ("v_dc_v", "v_dc_exp_v", 5.0), "i_dc": ("i_dc_a", "i_dc_exp_a", 0.25),
}


@dataclass(frozen=True)
class ResidualConfig:
    g_min: float = 50.0
    g_vdc_min: float = 150.0
    g_coarse: float = 700.0
    g_fine: float = 800.0
    clip: float = 2.0
    gate_on: str = "gti"               # raw tilted irradiance, or "g_poa" for the value finally used
    weights: dict[str, float] = field(default_factory=lambda: {"meteo": 0.35, "coverage": 0.20, "inputs": 0.25, "irradiance": 0.20})


def common_status(g: Column, cfg: ResidualConfig) -> Column:
    """NULL when the bin is usable, else the reason."""
    missing = V.flag("flag_inv_missing") | V.flag("flag_meteo_missing")
    return F.when(missing, "insufficient_input").when(g.isNull() | (g < cfg.g_min), "low_irradiance")


def channel_confidence(observed: Column, g: Column, cfg: ResidualConfig) -> Column:
    qc, cov = F.col("meteo_qc_score"), F.col("inv_coverage")
    low, interp = V.flag("flag_meteo_low_confidence"), V.flag("flag_meteo_interpolated")
    odd = V.flag("flag_meteo_outlier") | V.flag("flag_meteo_artifact")
    unknown = V.clamp01(
        F.when(low, 0.35).otherwise(0.55) - F.when(interp, 0.10).otherwise(0.0) - F.when(odd, 0.20).otherwise(0.0)
    )
    known = V.clamp01(qc) * F.when(interp, 0.90).otherwise(1.0) * F.when(odd, 0.70).otherwise(1.0)
    meteo = F.when(qc.isNull(), unknown).otherwise(known)
    coverage = F.when(cov.isNull(), F.when(V.flag("flag_inv_missing"), 0.0).otherwise(0.70)).otherwise(V.clamp01(cov))
    inputs = (
        F.when(observed.isNull(), 0.0).otherwise(1.0) * F.when(F.col("temp_air").isNull(), 0.70).otherwise(1.0)
        * F.when(g.isNull() & F.col("ghi").isNull(), 0.25).otherwise(1.0)
    )
    light = (
        F.when(g >= cfg.g_fine, 1.0).when(g >= cfg.g_coarse, 0.85).when(g >= cfg.g_vdc_min, 0.70)
        .when(g >= cfg.g_min, 0.50).otherwise(0.0)
    )
    w = cfg.weights
    return V.clamp01(w["meteo"] * meteo + w["coverage"] * coverage + w["inputs"] * inputs + w["irradiance"] * light)


def residual_channels(df: DataFrame, cfg: ResidualConfig = ResidualConfig()) -> DataFrame:
    """Adds `r_<channel>` (abs, rel, norm, status, confidence structs) and `bundle_confidence`.

    Expects the observed columns, `*_exp_*`, `model_valid`, weather values and flags.
    """
    g = F.col(cfg.gate_on)
    df = df.withColumn("_status", common_status(g, cfg))
    out = {}
    for name, (obs, exp, eps) in CHANNELS.items():
        o, e = F.col(obs), F.col(exp)
        own = F.when(F.col("_status").isNotNull(), F.col("_status")).when(o.isNull(), "insufficient_input")
        if name == "v_dc":
            own = own.when(g < cfg.g_vdc_min, "low_irradiance")
        status = F.when(~V.flag("model_valid") | e.isNull(), "model_unavailable").otherwise(F.coalesce(own, F.lit("valid")))
        ok = status == "valid"
        rel = V.residual_rel(o, e, eps)
        out[f"r_{name}"] = F.struct(
            F.when(ok, V.residual_abs(o, e)).alias("abs"), F.when(ok, rel).alias("rel"),
            F.when(ok, V.clip_abs(rel, cfg.clip)).alias("norm"), status.alias("status"),
            F.when(ok, channel_confidence(o, g, cfg)).otherwise(0.0).alias("confidence"),
        )
    df = df.withColumns(out).drop("_status")
    total = sum((F.col(f"r_{n}.confidence") for n in list(CHANNELS)[1:]), F.col("r_p_ac.confidence"))
    return df.withColumn("bundle_confidence", V.clamp01(total / len(CHANNELS)))


def diagnosis_ready(g: Column, cfg: ResidualConfig = ResidualConfig()) -> Column:
    return common_status(g, cfg).isNull() & (g >= cfg.g_fine)


def effective_poa(df: DataFrame, keys: list[str], transposed: str = "g_poa_transposed", gti: str = "gti", ghi: str = "ghi") -> DataFrame:
    """Tilted irradiance, else the transposed one; a series without either geometry or GTI uses GHI."""
    if transposed not in df.columns:
        df = df.withColumn(transposed, F.lit(None).cast("double"))
    has = df.groupBy(*keys).agg(F.max(F.col(gti).isNotNull()).alias("_gti"), F.max(F.col(transposed).isNotNull()).alias("_tr"))
    flat = ~F.col("_gti") & ~F.col("_tr")
    return df.join(has, keys).withColumn(
        "g_poa", F.coalesce(F.col(gti), F.col(transposed), F.when(flat, F.col(ghi)))
    ).drop("_gti", "_tr")


def fused_signal(base: Column, channels: dict[str, tuple[Column, Column]], valid: Column, weights: dict[str, float],
                 default_ac: float, default_dc: float, min_support: float) -> tuple[Column, Column, Column]:
    """Weighted mean of AC mismatch and DC residuals: (signal, support, confidence)."""
    conf = lambda c, d: F.greatest(F.least(F.coalesce(c, F.lit(d)), F.lit(1.0)), F.lit(0.0))
    parts = [(base, F.lit(weights["p_ac"]), conf(channels["p_ac"][1], default_ac))]
    parts += [(channels[n][0], F.lit(weights[n]), conf(channels[n][1], default_dc)) for n in ("p_dc", "v_dc", "i_dc")]
    # plain sums, not folds over an array: those would be interpreted row by row
    fold = lambda f: sum((F.when(v.isNotNull(), f(v, w, c)).otherwise(0.0) for v, w, c in parts), F.lit(0.0))
    num, den, nominal = fold(lambda v, w, c: w * c * v), fold(lambda v, w, c: w * c), fold(lambda v, w, c: w)
    some = V.flag(valid) & (den > 0)
    support = F.when(some, den / sum(weights.values())).otherwise(0.0)
    mean = num / den
    signal = F.when(some, F.when((support < min_support) & base.isNotNull(), base).otherwise(mean))
    return signal, support, F.when(some, den / F.greatest(nominal, F.lit(1e-9)))


def combined_signal(base: Column, channels: dict[str, tuple[Column, Column]], gate: Column) -> Column:
    """Interactive variant: fixed weight for AC, confidence-weighted DC, NULL outside the gate."""
    weights = {"p_dc": 0.25, "v_dc": 0.15, "i_dc": 0.20}
    num = F.coalesce(base * 0.40, F.lit(0.0))
    den = F.when(base.isNotNull(), 0.40).otherwise(0.0)
    for n, w in weights.items():
        v, c = channels[n]
        cf = F.when(c.isNull(), 1.0).otherwise(V.clamp01(c))
        num = num + F.coalesce(v * cf * w, F.lit(0.0))
        den = den + F.when(v.isNotNull(), cf * w).otherwise(0.0)
    return F.when(V.flag(gate), F.when(den > 0, num / den).otherwise(base))


def residual_event_score(channels: dict[str, tuple[Column, Column]]) -> tuple[Column, Column]:
    """Confidence-weighted size of the DC residuals and the trigger at 0.45."""
    weights = {"p_dc": 0.40, "v_dc": 0.25, "i_dc": 0.35}
    num, den = F.lit(0.0), F.lit(0.0)
    for n, w in weights.items():
        v, c = channels[n]
        both = v.isNotNull() & c.isNotNull()
        num = num + F.when(both, F.least(F.abs(v), F.lit(2.0)) / 2.0 * V.clamp01(c) * w).otherwise(0.0)
        den = den + F.when(both, w).otherwise(0.0)
    score = F.when(den > 0, V.clamp01(num / den))
    return score, F.coalesce(score >= 0.45, F.lit(False))


def combined_event_score(signal: Column, score: Column, gate: Column) -> Column:
    power = F.least(F.coalesce(F.abs(signal), F.lit(0.0)), F.lit(2.0)) / 2.0
    return F.when(V.flag(gate), F.when(score.isNull(), power).otherwise(0.60 * power + 0.40 * score))
