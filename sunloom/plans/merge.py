"""Telemetry + weather → aligned, complete quarter-hours for all plants in one lazy plan."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from sunloom.config import BucketConfig, WeatherConfig
from sunloom.operators import bins


def merge_quarter_hours(
    telemetry: DataFrame, weather: DataFrame, ranges: DataFrame, keys: Sequence[str] = ("plant_id",),
    power_cfg: BucketConfig = BucketConfig(), weather_cfg: WeatherConfig = WeatherConfig(), how: str = "outer",
    dense: bool = True, to_mppt: bool = False,
) -> DataFrame:
    """Both inputs shuffle once on (keys, bin); the joins reuse that partitioning."""
    power = bins.bucket_power(telemetry, keys, power_cfg)
    sky = bins.bucket_weather(weather, keys, weather_cfg)
    merged = bins.join_weather(power, sky, keys, how)
    if dense:
        merged = bins.densify(merged, ranges, keys, power_cfg.coverage_threshold)
    return bins.allocate_to_mppt(merged) if to_mppt else merged
