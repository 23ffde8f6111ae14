"""Diagnosis vocabularies and the rules over them."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sunloom.functions import values as V

# fixed values: diagnosis → coarse event or truth group
GROUP_OF = {
    "grid_overvoltage_trip": "grid_fault", "grid_overvoltage_derating": "grid_fault",
    "grid_undervoltage_trip": "grid_fault", "grid_undervoltage_derating": "grid_fault",
    "grid_overfrequency_trip": "grid_fault", "grid_underfrequency_trip": "grid_fault",
    "inverter_off_under_sun": "inverter_shutdown", "unknown_shutdown_with_sun": "inverter_shutdown",
    "dc_side_partial_loss_probable": "dc_side_partial_loss", "dc_side_voltage_anomaly_probable": "dc_side_partial_loss",
    "partial_generation_loss_probable": "dc_side_partial_loss",
    "persistent_underperformance": "persistent_underperformance", "curtailment_clipping": "curtailment_clipping",
}
TRUTH_GROUP_OF = {**GROUP_OF, "normal_window": "normal", "normal": "normal"}
BENIGN_DIAGNOSES = ("ok", "invalid", "low_irradiance")

# fixed values: severity sets
CRITICAL = ("grid_overvoltage_trip", "grid_undervoltage_trip", "grid_overfrequency_trip", "grid_underfrequency_trip",
            "inverter_off_under_sun", "unknown_shutdown_with_sun")
WARNING = ("grid_overvoltage_derating", "grid_undervoltage_derating", "partial_generation_loss_probable",
           "persistent_underperformance", "dc_side_partial_loss_probable", "dc_side_voltage_anomaly_probable", "curtailment_clipping")

# fixed values: diagnosis → code (0 ok, 1 limited, 2 anomaly, 3 critical, 4 other)
CODE_ANOMALY = ("dc_shading_soiling_probable", "dc_degradation_probable", "dc_mppt_tracking_anomaly_probable",
                "dc_partial_open_circuit_probable", "dc_side_partial_loss_probable", "dc_side_voltage_anomaly_probable",
                "partial_generation_loss_probable", "persistent_underperformance")
CODE_CRITICAL = ("dc_open_circuit_probable", "dc_short_circuit_probable", "inverter_off_under_sun", "unknown_shutdown_with_sun")


def diagnosis_code(label: Column) -> Column:
    return (
        F.when(label.isin("ok", "invalid", "low_irradiance"), 0).when(label.isin("curtailment_clipping", "operational_curtailment"), 1)
        .when(label.isin(*CODE_ANOMALY), 2).when(label.startswith("grid_") | label.isin(*CODE_CRITICAL), 3).otherwise(4)
    )


def truth_group(label: Column, state: Column) -> Column:
    name = V.normal_label(label)
    return F.when(state == "normal", "normal").otherwise(V.lookup(name, TRUTH_GROUP_OF, name))


def coarse_event(label: Column) -> Column:
    return V.lookup(label, GROUP_OF, label)


def matches_or_empty(column: str, wanted: str) -> Column:
    """Truth rows without a source apply to every source."""
    return (F.col(column) == "") | (F.col(column) == wanted)


def runtime_severity(state: Column, diagnosis: Column, grid_evidence: Column, anomaly: Column) -> Column:
    s, d = F.lower(F.trim(F.coalesce(state, F.lit("")))), F.lower(F.trim(F.coalesce(diagnosis, F.lit(""))))
    return (
        F.when(d.isin("ok", "normal") | (s == "injecting_normal"), "ok")
        .when(d.isin(*CRITICAL), "crit")
        .when(d.isin(*WARNING) | (s == "injecting_degraded"), "warn")
        .when(V.flag(grid_evidence) & (s == "sun_available_not_injecting"), "crit")
        .when((d == "invalid") | s.isin("telemetry_invalid", "unknown", "low_irradiance"), "none")
        .when(V.flag(anomaly), "warn").otherwise("none")
    )


def review_state(review: Column, status: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    r = F.lower(F.trim(F.coalesce(review, F.lit(""))))
    return (
        F.when(r != "", r).when(s == "dismissed", "dismissed").when(s == "reviewed", "confirmed")
        .otherwise(F.coalesce(F.nullif(s, F.lit("")), F.lit("pending")))
    )


def display_label(final: Column, prelim: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(final), F.lit("")), F.nullif(F.trim(prelim), F.lit("")), F.lit("unknown"))
