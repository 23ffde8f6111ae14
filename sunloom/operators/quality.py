"""Weather quality control: physical limits, Hampel filter, interpolation artefacts, score."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunloom.config import PHYSICAL_BOUNDS, WEATHER_COLS, WEATHER_FLAGS, WEATHER_SCORE, QcConfig
from sunloom.functions import values as V
from sunloom.operators import series as S

SOLAR = ("gti", "ghi", "dni", "dhi")


def apply_bounds(df: DataFrame) -> DataFrame:
    """Impossible values become NULL and raise `_bad`; diffuse above global + 25 loses the diffuse."""
    have = [c for c in PHYSICAL_BOUNDS if c in df.columns]
    outside = [V.flag((F.col(c) < PHYSICAL_BOUNDS[c][0]) | (F.col(c) > PHYSICAL_BOUNDS[c][1])) for c in have]
    bad = F.lit(False)
    for o in outside:
        bad = bad | o
    df = df.withColumn("_bad", bad).withColumns({c: F.when(F.col(c).between(*PHYSICAL_BOUNDS[c]), F.col(c)) for c in have})
    if "ghi" in have and "dhi" in have:
        odd = V.flag(F.col("dhi") > F.col("ghi") + 25.0)
        df = df.withColumn("_odd", odd).withColumns({"_bad": F.col("_bad") | F.col("_odd"), "dhi": F.when(~F.col("_odd"), F.col("dhi"))}).drop("_odd")
    return df


def _near_median(c: Column, w, half: int, least: int) -> Column:
    """Median of a row's value and those up to `half` rows away; NULL where fewer than `least` are known.

    The neighbours come as lagged values, so that no frame is collected: one small array per row is sorted.
    """
    near = [F.lag(c, k).over(w) for k in range(half, 0, -1)] + [c] + [F.lead(c, k).over(w) for k in range(1, half + 1)]

    def middle(x: Column) -> Column:
        n = F.size(x)
        return F.when(n >= least, (F.get(x, F.floor((n - 1) / 2).cast("int")) + F.get(x, F.floor(n / 2).cast("int"))) / 2)

    return F.get(F.transform(F.array(F.sort_array(F.array_compact(F.array(*near)))), middle), F.lit(0))


def hampel(c: str, w, sigma: float, floor: float, window: int, only: Column | None = None) -> tuple[dict[str, Column], Column]:
    """Median and median deviation over a centred frame; outlier when the distance beats both limits.

    Returns the two intermediate columns (in order) and the outlier test.
    """
    half, least = window // 2, max(3, window // 2)
    med, dev = f"_med_{c}", f"_mad_{c}"
    steps = {
        med: _near_median(F.col(c), w, half, least),
        dev: _near_median(F.abs(F.col(c) - F.col(med)), w, half, least),
    }
    limit = F.greatest(F.col(dev) * 1.4826 * sigma, F.lit(floor))
    test = F.col(med).isNotNull() & F.col(dev).isNotNull() & (F.abs(F.col(c) - F.col(med)) > limit)
    if only is not None:
        test = test & only
    return steps, V.flag(test)


def weather_qc(df: DataFrame, s: S.Series, cfg: QcConfig = QcConfig(), native: Column | None = None) -> DataFrame:
    """Cleaned weather with score and flags; whole series, no per-import edges.

    `native` marks rows of sites with true 15-minute solar data (no artefact test, no penalty).
    """
    interpolated = F.lit(False)
    if cfg.source.upper() == "OPENMETEO" and cfg.interval_min == 15:
        interpolated = ~V.flag(native if native is not None else F.lit(False))
    d = apply_bounds(df.withColumn("_interp", interpolated))
    solar = [c for c in SOLAR if c in df.columns]
    # the first solar column with any value in the series decides what counts as daylight
    b = S.blocks(d, s, before=11, after=9, seen={f"_has_{c}": F.col(c).isNotNull() for c in solar})

    def primary(prefix: str = "") -> Column:
        out = F.lit(None).cast("double")
        for c in reversed(solar):
            out = F.when(F.col(f"_has_{c}"), F.col(c)).otherwise(out)
        return out

    b = b.withColumn("_day", V.flag(primary() >= cfg.daylight_wm2))
    checks = [(c, cfg.solar_sigma, cfg.solar_floor, F.col("_day")) for c in solar]
    checks += [("temp_air", cfg.temp_sigma, cfg.temp_floor, None), ("wind_speed", cfg.wind_sigma, cfg.wind_floor, None)]
    first, second, tests = {}, {}, {}
    for c, sigma, floor, only in checks:
        if c in df.columns:
            steps, test = hampel(c, s.blocked, sigma, floor, cfg.window, only)
            (m, me), (a, ae) = steps.items()
            first[m], second[a], tests[c] = me, ae, test
    b = b.withColumns(first).withColumns(second).withColumns({f"_out_{c}": t for c, t in tests.items()})
    spike = F.lit(False)
    for c in tests:
        spike = spike | F.col(f"_out_{c}")
    b = b.withColumn("_bad", F.col("_bad") | spike).withColumns({c: F.when(~F.col(f"_out_{c}"), F.col(c)) for c in tests})
    w = s.blocked
    b = b.withColumn("_x", primary())
    b = b.withColumn("_d1", F.col("_x") - F.lag("_x").over(w))
    b = b.withColumn("_d2", F.abs(F.col("_d1") - F.lag("_d1").over(w)))
    b = b.withColumn("_line", V.flag((F.col("_x") >= cfg.daylight_wm2) & (F.col("_d2") <= cfg.artifact_tol)))
    near = F.coalesce(F.lag("_line").over(w), F.lit(False)) & F.coalesce(F.lead("_line").over(w), F.lit(False))
    b = b.withColumn("_art", F.col("_line") & near & F.col("_interp"))
    b = S.core(b)
    phys = [c for c in WEATHER_COLS if c in df.columns]
    gone = F.coalesce(*phys).isNull()
    one = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0.0))
    score = 1.0 - one(F.col("_bad"), 0.55) - one(F.col("_art"), 0.10) - one(F.col("_interp"), 0.20) - one(gone, 0.35)
    score = F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0))
    keep = [c for c in df.columns if c not in (WEATHER_SCORE, *WEATHER_FLAGS)]
    return b.select(
        *keep, score.alias(WEATHER_SCORE), (score < cfg.low_score).alias("flag_meteo_low_confidence"),
        F.col("_interp").alias("flag_meteo_interpolated"), F.col("_bad").alias("flag_meteo_outlier"),
        F.col("_art").alias("flag_meteo_artifact"),
    )


def qc_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("flag_meteo_outlier").alias("flagged_outliers"),
        F.count_if("flag_meteo_artifact").alias("flagged_artifacts"),
        F.count_if("flag_meteo_low_confidence").alias("flagged_low_confidence"),
        F.avg(WEATHER_SCORE).alias("qc_score_mean"), F.min(WEATHER_SCORE).alias("qc_score_min"),
    )


def qc_by_day(df: DataFrame, keys: Sequence[str], day: Column) -> DataFrame:
    have = [c for c in WEATHER_FLAGS if c in df.columns]
    return df.groupBy(*keys, day.alias("day")).agg(
        F.avg(WEATHER_SCORE).alias("qc_score_mean"), F.min(WEATHER_SCORE).alias("qc_score_min"),
        *[F.max(V.flag(c)).alias(c) for c in have],
    )
