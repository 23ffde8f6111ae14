"""Parameters of every operator, as frozen dataclasses.

The defaults are fixed values: results only agree with the published rules when they are kept.
"""
from __future__ import annotations

from dataclasses import dataclass, replace

BIN_MINUTES = 15
BIN_SECONDS = 900
BINS_PER_DAY = 96

METER_COLS = ("p_ac_w", "p_dc_w", "v_dc_v", "i_dc_a", "v_ac_v", "i_ac_a", "freq_hz")
MPPT_KINDS = ("vdc_v", "idc_a", "p_dc_w")
WEATHER_COLS = ("ghi", "dni", "dhi", "gti", "temp_air", "wind_speed", "rh", "pressure")
WEATHER_SCORE = "meteo_qc_score"
WEATHER_FLAGS = (
    "flag_meteo_low_confidence", "flag_meteo_interpolated", "flag_meteo_outlier", "flag_meteo_artifact",
)


@dataclass(frozen=True)
class BucketConfig:
    mean_cols: tuple[str, ...] | None = None  # the meter's and those of every tracker that the table has
    sampling_minutes: int = 5
    max_dt_minutes: int = 15
    energy_dt: str = "fixed"            # or "next"
    coverage_threshold: float = 0.7
    expected_samples: int | None = None

    @property
    def expected(self) -> int:
        return max(1, self.expected_samples or round(BIN_MINUTES / self.sampling_minutes))


@dataclass(frozen=True)
class WeatherConfig:
    label: str = "period_start"         # period_end, midpoint
    duplicates: str = "mean"            # median, first


@dataclass(frozen=True)
class QcConfig:
    interval_min: int = 15
    source: str = "OPENMETEO"
    window: int = 9
    solar_sigma: float = 4.5
    solar_floor: float = 80.0
    temp_sigma: float = 4.0
    temp_floor: float = 6.0
    wind_sigma: float = 4.0
    wind_floor: float = 6.0
    daylight_wm2: float = 50.0
    artifact_tol: float = 0.5
    low_score: float = 0.75


# fixed values: physical limits per weather column
PHYSICAL_BOUNDS = {
    "ghi": (0.0, 1500.0), "dni": (0.0, 1500.0), "dhi": (0.0, 1200.0), "gti": (0.0, 1700.0),
    "temp_air": (-40.0, 65.0), "wind_speed": (0.0, 75.0), "rh": (0.0, 100.0), "pressure": (70000.0, 110000.0),
}


@dataclass(frozen=True)
class DetectConfig:
    sun_g: float = 180.0
    coarse_g: float = 320.0
    fine_g: float = 500.0
    max_cv: float = 0.08
    max_ramp: float = 120.0
    window: int = 6
    ewma_lambda: float = 0.20
    ewma_limit: float = 3.0
    cusum_k: float = 0.5
    cusum_h: float = 8.0
    baseline_min: int = 24
    context_min: int = 12
    sigma_floor: float = 0.08
    weights: tuple[tuple[str, float], ...] = (("p_ac", 0.45), ("p_dc", 0.20), ("v_dc", 0.15), ("i_dc", 0.20))
    default_conf_ac: float = 1.0
    default_conf_dc: float = 0.75
    min_support: float = 0.20
    min_coverage: float = 0.30
    gain_conf: float = 1.00
    gain_low: float = 0.25
    gain_interp: float = 0.15

    def shifted_floor(self, gate: float) -> "DetectConfig":
        """Interactive profile: thresholds never fall below the user's irradiance gate."""
        return replace(self, sun_g=max(self.sun_g, gate), coarse_g=max(self.coarse_g, gate),
                       fine_g=max(self.fine_g, gate))


@dataclass(frozen=True)
class RcaConfig:
    sun_g: float = 180.0
    zero_abs_w: float = 15.0
    zero_rel: float = 0.02
    expected_min_w: float = 150.0
    degraded_rel: float = 0.25
    severe_rel: float = 0.65
    clip_margin: float = 0.98
    clip_model_margin: float = 1.02
    low_i_warn: float = 0.35
    low_i_crit: float = 0.15
    low_v_warn: float = 0.80
    low_v_crit: float = 0.60
    vac_low: float = 0.90
    vac_high: float = 1.10
    vac_margin_v: float = 10.0
    freq_tol_hz: float = 1.0
    baseline_min: int = 24
    open_i: float = -0.85
    open_v_low: float = -0.20
    short_v: float = -0.45
    short_p: float = -0.70
    shading_i: float = -0.25
    shading_v_abs: float = 0.18
    degradation_i: float = -0.12
    degradation_p: float = -0.15
    mppt_v: float = -0.18


@dataclass(frozen=True)
class EventConfig:
    gap_bins: int = 1
    min_bins: int = 2
    bin_minutes: int = BIN_MINUTES


@dataclass(frozen=True)
class LegacyConfig:
    g_gate: float = 180.0
    normal_abs: float = 0.40
    meteo_error_pos: float = 0.25
    disconnected_neg: float = -0.90
    max_gap_minutes: int = 30
    min_event_minutes: int = 60
