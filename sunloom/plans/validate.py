"""Validation of detections against expert truth as five result tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from sunloom.operators import validation as VA


def validation_report(bins: DataFrame, preds: DataFrame, truths: DataFrame, keys: Sequence[str], time: str = "ts_15",
                      tz: Column | str = "UTC", truth_ready: bool = False) -> dict[str, DataFrame]:
    """Bins need anomaly_flag, diagnosis_label, g_poa and meteo_quality_ok."""
    judged = bins if truth_ready else bins.join(VA.bin_truth(bins, truths, keys, time), [*keys, time])
    matches = VA.match_events(preds, truths, keys)
    events = VA.event_metrics(preds, truths, matches, keys)
    return {
        "bins": judged, "matches": matches, "event_metrics": events, "bin_metrics": VA.bin_metrics(judged, keys),
        "bin_confusion": VA.bin_confusion(judged, keys), "event_confusion": VA.multiclass_counts(matches, keys, "truth_label", "pred_label"),
        "false_alarms": VA.false_alarm_rates(judged, events, keys, time, tz),
    }
