"""Quarter-hour buckets, the weather join, complete grids, coverage and rollups."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunloom.config import (
    BIN_MINUTES, BIN_SECONDS, METER_COLS, MPPT_KINDS, WEATHER_COLS, WEATHER_FLAGS, WEATHER_SCORE, BucketConfig, WeatherConfig,
)
from sunloom.functions import timegrid as tg
from sunloom.functions.values import flag
from sunloom.operators import keys as K
from sunloom.operators import series as S
from sunloom.operators.selection import medians

BIN = "ts_15"


def mean_columns(df: DataFrame, cfg: BucketConfig) -> list[str]:
    """Columns of the table that a bucket takes the mean of."""
    names = cfg.mean_cols
    if names is None:
        trackers = sorted({k for c in MPPT_KINDS for k in K.trackers_in(df.columns, c)})
        names = (*METER_COLS, *[f"mppt{k}_{c}" for k in trackers for c in MPPT_KINDS])
    return [c for c in names if c in df.columns]


def sample_energy_fixed(pac: Column, cfg: BucketConfig) -> Column:
    return pac * (cfg.sampling_minutes / 60.0)


def with_energy_to_next(df: DataFrame, s: S.Series, cfg: BucketConfig, pac: str = "p_ac_w") -> DataFrame:
    """Energy of each sample up to the next one; the last sample of a series gets the median gap."""
    b = S.blocks(df, s, after=1)
    gap = F.lead(F.unix_micros(F.col(s.time))).over(s.blocked) - F.unix_micros(F.col(s.time))
    b = S.core(b.withColumn("_gap_us", gap))
    fill = medians(b, s.keys, {"_gap_med": F.col("_gap_us")}).withColumn("_gap_med", F.col("_gap_med") / 3.6e9)
    b = b.withColumn("_gap_h", F.col("_gap_us") / 3.6e9).drop("_gap_us")
    hours = F.coalesce("_gap_h", "_gap_med", F.lit(cfg.sampling_minutes / 60.0))
    hours = F.greatest(F.least(hours, F.lit(cfg.max_dt_minutes / 60.0)), F.lit(0.0))
    return S.without_marks(
        S.attach(b, fill, s).withColumn("_energy_wh", F.col(pac) * hours).drop("_gap_h", "_gap_med")
    )


def bucket_power(
    df: DataFrame, keys: Sequence[str], cfg: BucketConfig = BucketConfig(), time: str = "ts_utc",
    series: S.Series | None = None, extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Samples → quarter-hours: means, energy, sample count and coverage.

    One shuffle on (keys, bin); the partial aggregate runs before it, so a hot plant arrives
    already reduced to its bins.
    """
    if cfg.energy_dt == "next":
        df = with_energy_to_next(df, series or S.Series(tuple(keys), time), cfg)
        energy = F.col("_energy_wh")
    elif "p_ac_w" in df.columns:
        energy = sample_energy_fixed(F.col("p_ac_w"), cfg)
    else:
        energy = F.lit(None).cast("double")
    means = [F.avg(c).alias(c) for c in mean_columns(df, cfg)]
    more = [e.alias(n) for n, e in (extra or {}).items()]
    out = (
        df.filter(F.col(time).isNotNull())
        .groupBy(*keys, tg.floor_to(time).alias(BIN))
        .agg(*means, F.sum(energy).alias("e_ac_wh_15"), F.count(F.lit(1)).alias("inv_n"), *more)
    )
    coverage = F.least(F.col("inv_n") / cfg.expected, F.lit(1.0))
    return out.withColumn("inv_coverage", coverage).withColumns(
        {
            "flag_inv_missing": F.lit(False),
            "flag_low_coverage": (F.col("inv_n") > 0) & (F.col("inv_coverage") < cfg.coverage_threshold),
        }
    )


def bucket_weather(
    df: DataFrame, keys: Sequence[str], cfg: WeatherConfig = WeatherConfig(), time: str = "ts_utc",
    value_cols: Sequence[str] = WEATHER_COLS,
) -> DataFrame:
    shift = {"period_end": -BIN_SECONDS, "midpoint": -BIN_SECONDS // 2}.get(cfg.label, 0)
    values = [c for c in value_cols if c in df.columns]

    def pick(c: str) -> Column:
        if cfg.duplicates == "median":
            return F.percentile(c, 0.5)
        if cfg.duplicates == "first":
            return F.min_by(c, F.when(F.col(c).isNotNull(), F.col(time)))
        return F.avg(c)

    aggs = [pick(c).alias(c) for c in values]
    if WEATHER_SCORE in df.columns:
        aggs.append(F.min(WEATHER_SCORE).alias(WEATHER_SCORE))
    aggs += [F.max(flag(c)).alias(c) for c in WEATHER_FLAGS if c in df.columns]
    grouped = df.filter(F.col(time).isNotNull()).groupBy(*keys, tg.floor_to(tg.plus_seconds(time, shift)).alias(BIN))
    return grouped.agg(*aggs) if aggs else grouped.agg(F.count(F.lit(1)).alias("_n")).drop("_n")


def all_missing(df: DataFrame, cols: Sequence[str] = WEATHER_COLS) -> Column:
    have = [c for c in cols if c in df.columns]
    return F.coalesce(*have).isNull() if have else F.lit(True)


def _presence(df: DataFrame, low: Column, weather_cols: Sequence[str]) -> DataFrame:
    if "inv_n" not in df.columns:
        df = df.withColumn("inv_n", F.lit(0).cast("long"))
    if "inv_coverage" not in df.columns:
        df = df.withColumn("inv_coverage", F.lit(None).cast("double"))
    missing = F.coalesce(F.col("inv_n"), F.lit(0)) == 0
    return df.withColumns(
        {
            "inv_n": F.coalesce(F.col("inv_n"), F.lit(0)).cast("long"),
            "flag_inv_missing": missing,
            "inv_coverage": F.when(~missing, F.col("inv_coverage")),
            "flag_low_coverage": F.when(missing, F.lit(False)).otherwise(F.coalesce(low, F.lit(False))),
            "flag_meteo_missing": all_missing(df, weather_cols),
        }
    )


def join_weather(
    power: DataFrame | None, weather: DataFrame, keys: Sequence[str], how: str = "left",
    weather_cols: Sequence[str] = WEATHER_COLS,
) -> DataFrame:
    """Power bins ⋈ weather bins; presence flags are recomputed.  Weather alone is allowed."""
    if power is None:
        return _presence(weather, F.lit(False), weather_cols)
    how = {"outer": "full"}.get(how, how)
    joined = power.join(weather, [*keys, BIN], how)
    low = F.col("flag_low_coverage") if "flag_low_coverage" in joined.columns else F.lit(False)
    return _presence(joined, low, weather_cols)


def over_steps(days: DataFrame, step: str, count: int) -> DataFrame:
    """Every row with the numbers 0 … count - 1 in a column `step`, the rows dealt over all shuffle partitions first.

    A few rows may stand for very many, so they must not stay in the task they come from.  The numbers come from a join, not from
    an array: the optimizer takes an exploded array for no larger than the rows it comes from and would broadcast the whole grid.
    """
    spark = days.sparkSession
    dealt = days.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *days.columns)
    return dealt.crossJoin(F.broadcast(spark.range(count).select(F.col("id").alias(step))))


def grid_of(ranges: DataFrame, start: str, end: str, name: str = BIN, minutes: int = BIN_MINUTES) -> DataFrame:
    """One row per bin of [floor(start), floor(end)) for every row of `ranges`, by way of stretches of a day."""
    step, per_day = minutes * 60, max(1, 24 * 60 // minutes)
    keep = [c for c in ranges.columns if c not in (start, end)]
    first, last = F.unix_seconds(tg.floor_to(start, minutes)), F.unix_seconds(tg.floor_to(end, minutes)) - step
    days = F.when(last >= first, F.sequence(first, last, F.lit(per_day * step).cast("long")))
    bins = over_steps(ranges.select(*keep, last.alias("_last"), F.explode(days).alias("_day")), "_step", per_day)
    second = F.col("_day") + F.col("_step") * step
    return bins.filter(second <= F.col("_last")).select(*keep, F.timestamp_seconds(second).alias(name))


def densify(
    df: DataFrame, ranges: DataFrame, keys: Sequence[str], coverage_threshold: float = 0.7,
    start: str = "range_start", end: str = "range_end", weather_cols: Sequence[str] = WEATHER_COLS,
) -> DataFrame:
    """Reindex every series to its complete grid; bins outside the range are dropped."""
    full = grid_of(ranges.select(*keys, start, end), start, end)
    out = full.join(df, [*keys, BIN], "left")
    have = "inv_coverage" in df.columns
    low = (F.col("inv_n") > 0) & (F.col("inv_coverage") < coverage_threshold) if have else F.lit(False)
    return _presence(out, low, weather_cols)


def fill_on_grid(df: DataFrame, ranges: DataFrame, keys: Sequence[str], columns: Sequence[str],
                 start: str = "range_start", end: str = "range_end") -> DataFrame:
    """Values at the exact grid instants, NULL elsewhere."""
    full = grid_of(ranges.select(*keys, start, end), start, end)
    return full.join(df.select(*keys, BIN, *columns), [*keys, BIN], "left")


def missing_bins(df: DataFrame, ranges: DataFrame, keys: Sequence[str], start: str = "range_start",
                 end: str = "range_end", minutes: int = BIN_MINUTES) -> DataFrame:
    full = grid_of(ranges.select(*keys, start, end), start, end, minutes=minutes)
    return full.join(df.select(*keys, BIN), [*keys, BIN], "left_anti")


def coverage(df: DataFrame, ranges: DataFrame, keys: Sequence[str], start: str = "range_start",
             end: str = "range_end", minutes: int = BIN_MINUTES, inclusive_end: bool = False) -> DataFrame:
    """Expected, existing and missing grid points with the covered share (an empty grid is 100 %).

    Only points on the grid count.  The grid is never built: sizes are arithmetic.
    """
    step = minutes * 60
    lo, hi = F.unix_seconds(tg.floor_to(start, minutes)), F.unix_seconds(tg.floor_to(end, minutes))
    expected = F.greatest(F.floor((hi - lo) / step) + (1 if inclusive_end else 0), F.lit(0)).cast("long")
    r = ranges.select(*keys, lo.alias("_lo"), hi.alias("_hi"), expected.alias("expected"))
    sec = F.unix_seconds(BIN)
    upper = F.col("_hi") + (step if inclusive_end else 0)
    points = df.select(*keys, BIN).distinct()
    inside = points.join(r, list(keys)).filter(
        (sec >= F.col("_lo")) & (sec < upper) & (F.pmod(sec - F.col("_lo"), F.lit(step)) == 0)
    )
    found = inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("existing"))
    out = r.join(found, list(keys), "left").withColumn("existing", F.coalesce("existing", F.lit(0)).cast("long"))
    return out.select(
        *keys, "expected", "existing", (F.col("expected") - F.col("existing")).alias("missing"),
        F.when(F.col("expected") == 0, 100.0).otherwise(F.col("existing") / F.col("expected") * 100.0).alias("pct"),
    )


def missing_ranges(df: DataFrame, ranges: DataFrame, keys: Sequence[str], limit: int | None = None,
                   start: str = "range_start", end: str = "range_end", minutes: int = BIN_MINUTES) -> DataFrame:
    """Consecutive missing points as inclusive ranges; all of them, or the first `limit` of each series for a page that asks for it."""
    gone = missing_bins(df, ranges, keys, start, end, minutes)
    s = S.Series(tuple(keys), BIN, slice_seconds=30 * 86400)
    marked = S.previous(gone, s, {"_prev": BIN})
    new = F.col("_prev").isNull() | (tg.seconds_between(BIN, "_prev") > minutes * 60)
    found = (
        S.islands(marked, s, new)
        .groupBy(*keys, "island")
        .agg(F.min(BIN).alias("gap_start"), F.max(BIN).alias("gap_end"), F.count(F.lit(1)).alias("n_bins"))
    )
    if limit is not None:
        found = found.filter(F.col("island") <= limit)
    return found.drop("island")


def rollup_hour(df: DataFrame, keys: Sequence[str], label: str = "left", closed: str = "left") -> DataFrame:
    """Hourly means, energy and sample sums, worst score and OR of flags (no value sums to 0)."""
    sec = F.unix_seconds(BIN)
    if closed == "right":
        start = F.ceil(sec / 3600) * 3600 - 3600
    else:
        start = F.floor(sec / 3600) * 3600
    hour = F.timestamp_seconds(start + (3600 if label == "right" else 0)).alias("ts_hour")
    have = set(df.columns)
    aggs = [F.avg(c).alias(c) for c in (*METER_COLS, *WEATHER_COLS, "inv_coverage") if c in have]
    aggs += [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("e_ac_wh_15", "inv_n") if c in have]
    aggs += [F.min(c).alias(c) for c in (WEATHER_SCORE,) if c in have]
    flags = ("flag_low_coverage", "flag_meteo_missing", "flag_inv_missing", *WEATHER_FLAGS)
    aggs += [F.max(flag(c)).alias(c) for c in flags if c in have]
    return df.groupBy(*keys, hour).agg(*aggs)


def merge_statistics(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Missing shares, coverage where present and the share of good bins, one row per series."""
    def share(c: Column) -> Column:
        return F.avg(c.cast("double"))

    bad = [F.coalesce(F.col(c), F.lit(True)) for c in ("flag_inv_missing", "flag_meteo_missing", "flag_low_coverage")]
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(BIN).alias("ts_min"),
        F.max(BIN).alias("ts_max"),
        share(flag("flag_inv_missing")).alias("inv_missing_frac"),
        share(flag("flag_meteo_missing")).alias("meteo_missing_frac"),
        F.coalesce(F.avg("inv_coverage"), F.lit(0.0)).alias("inv_coverage_mean"),
        share(flag("flag_low_coverage")).alias("low_coverage_frac"),
        share(~(bad[0] | bad[1] | bad[2])).alias("good_frac"),
        (F.floor((F.unix_seconds(F.max(BIN)) - F.unix_seconds(F.min(BIN))) / BIN_SECONDS) + 1).cast("long").alias(
            "rows_expected"
        ),
    )


def allocate_to_mppt(df: DataFrame, source: str = "source_oper", trackers: Sequence[int] | None = None) -> DataFrame:
    """Total row → one row per tracker; AC power and energy follow the DC share.

    Without any positive DC power the total row stays as it is.  Trackers are those the columns name.
    """
    trackers = K.trackers_in(df.columns, "p_dc_w") if trackers is None else trackers
    p = [F.col(f"mppt{k}_p_dc_w") for k in trackers]
    positive = [F.when(x > 0, x).otherwise(F.lit(0.0)) for x in p]
    total = sum(positive[1:], positive[0])
    rows = []
    for k, pos in zip(trackers, positive):
        share = F.when(pos > 0, pos / F.col("_total"))
        rows.append(
            F.struct(
                F.concat(F.col(source), F.lit(f"|MPPT{k}")).alias("_source"), F.lit(k).alias("mppt"),
                F.col(f"mppt{k}_p_dc_w").alias("_p_dc"), (F.col("p_ac_w") * share).alias("_p_ac"),
                F.col(f"mppt{k}_vdc_v").alias("_v_dc"), F.col(f"mppt{k}_idc_a").alias("_i_dc"),
                (F.col("e_ac_wh_15") * share).alias("_e"),
            )
        )
    whole = F.struct(
        F.col(source).alias("_source"), F.lit(None).cast("int").alias("mppt"), F.col("p_dc_w").alias("_p_dc"),
        F.col("p_ac_w").alias("_p_ac"), F.col("v_dc_v").alias("_v_dc"), F.col("i_dc_a").alias("_i_dc"),
        F.col("e_ac_wh_15").alias("_e"),
    )
    tracker_cols = [f"mppt{k}_{c}" for k in trackers for c in ("vdc_v", "idc_a", "p_dc_w")]
    out = df.withColumn("_total", total).withColumn(
        "_r", F.explode(F.when(F.col("_total") > 0, F.array(*rows)).otherwise(F.array(whole)))
    )
    return out.withColumns(
        {
            source: F.col("_r._source"), "mppt": F.col("_r.mppt"), "p_dc_w": F.col("_r._p_dc"),
            "p_ac_w": F.col("_r._p_ac"), "v_dc_v": F.col("_r._v_dc"), "i_dc_a": F.col("_r._i_dc"),
            "e_ac_wh_15": F.col("_r._e"),
        }
    ).drop("_total", "_r", *tracker_cols)
