"""Per-tracker (MPPT) tables: rule labels, scalers, features, event classification, training data."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunloom.functions import timegrid as tg
from sunloom.functions import values as V
from sunloom.operators import keys as K
from sunloom.operators import series as S
from sunloom.operators.bins import BIN

WINDOW_STEPS = 96


def tracker_bins(samples: DataFrame, keys: Sequence[str], time: str = "ts_utc", trackers: Sequence[int] | None = None) -> DataFrame:
    """Raw samples with mpptK columns → quarter-hour means per device, partial sums before the shuffle; all trackers by default."""
    trackers = wide_trackers(samples) if trackers is None else trackers
    cols = [c for k in trackers for c in (f"mppt{k}_vdc_v", f"mppt{k}_idc_a") if c in samples.columns]
    more = [c for c in ("p_dc_w",) if c in samples.columns]
    return samples.groupBy(*keys, tg.floor_to(time).alias(BIN)).agg(*[F.avg(c).alias(c) for c in (*cols, *more)])


def wide_trackers(df: DataFrame) -> list[int]:
    """Trackers with a current or a voltage column."""
    return sorted({*K.trackers_in(df.columns, "vdc_v"), *K.trackers_in(df.columns, "idc_a")})


def long_trackers(wide: DataFrame, keep: Sequence[str], trackers: Sequence[int] | None = None) -> DataFrame:
    trackers = wide_trackers(wide) if trackers is None else trackers
    rows = F.array(*[F.struct(F.lit(k).alias("mppt"), F.col(f"mppt{k}_vdc_v").alias("v"), F.col(f"mppt{k}_idc_a").alias("i")) for k in trackers])
    return wide.select(*keep, F.inline(rows))


def merge_layouts(canonical: DataFrame, legacy: DataFrame, raw: DataFrame | None, keys: Sequence[str], time: str = BIN,
                  trackers: Sequence[int] | None = None) -> DataFrame:
    """One row per instant from the canonical row, else the `|MPPTk` rows.

    Tracker currents come from raw buckets when those have any, else canonical, else legacy.  Without `trackers` they are
    those that any of the three tables has.
    """
    if trackers is None:
        trackers = sorted({*K.trackers_seen(legacy), *K.trackers_in(canonical.columns, "idc_a"), *K.trackers_in(raw.columns if raw is not None else [], "idc_a")})
    k = K.mppt_number(F.col("source_oper"))
    rows = legacy.withColumn("_k", k).filter(F.col("_k").isin(*trackers))
    sky = [c for c in ("gti", "ghi", "temp_air") if c in legacy.columns and c in canonical.columns]
    old = rows.groupBy(*keys, time).agg(
        *[F.max_by("i_dc_a", F.when(F.col("_k") == n, F.col("source_oper"))).alias(f"_l{n}") for n in trackers],
        F.sum("p_dc_w").alias("_pdc"), F.sum("p_ac_w").alias("_pac"), F.min_by(F.struct("i_dc_a", *sky), "source_oper").alias("_first"),
    )
    base = canonical.withColumn("_base", F.lit(True))
    j = base.join(old, [*keys, time], "full")
    if raw is not None:
        r = raw.select(*keys, time, *[(F.col(f"mppt{n}_idc_a") if f"mppt{n}_idc_a" in raw.columns else F.lit(None).cast("double")).alias(f"_r{n}") for n in trackers])
        j = j.join(r, [*keys, time], "left")
    else:
        j = j.withColumns({f"_r{n}": F.lit(None).cast("double") for n in trackers})
    use_raw = F.coalesce(*[F.col(f"_r{n}") for n in trackers]).isNotNull()
    own = {n: F.col(f"mppt{n}_idc_a") if f"mppt{n}_idc_a" in canonical.columns else F.lit(None).cast("double") for n in trackers}
    have = F.coalesce("_base", F.lit(False))
    pick = lambda c, alt: F.when(have, F.col(c)).otherwise(F.col(alt))
    out = {f"mppt{n}_idc_a": F.when(use_raw, F.col(f"_r{n}")).otherwise(F.coalesce(own[n], f"_l{n}")) for n in trackers}
    out |= {"p_dc_w": pick("p_dc_w", "_pdc"), "p_ac_w": pick("p_ac_w", "_pac"), "i_dc_a": pick("i_dc_a", "_first.i_dc_a")}
    out |= {c: pick(c, f"_first.{c}") for c in sky}
    return j.select(*keys, time, *[e.alias(n) for n, e in out.items()])


@dataclass(frozen=True)
class SeedConfig:
    trackers: int = 4
    day_g: float = 50.0
    day_p: float = 50.0
    disconnect_g: float = 300.0
    zero_a: float = 0.10
    peer_a: float = 0.50
    disconnect_ratio: float = 0.05
    off_g: float = 400.0
    off_p: float = 25.0
    imbalance_g: float = 300.0
    imbalance_peer_a: float = 1.00
    imbalance_ratio: float = 0.25
    total_fallback: bool = True


def rule_labels(df: DataFrame, keys: Sequence[str], cfg: SeedConfig = SeedConfig()) -> DataFrame:
    """Rule label per tracker and bin from currents, their peers, irradiance and power.

    Input is wide (mpptK_idc_a, i_dc_a, p_ac_w, p_dc_w, gti, ghi); without tracker currents the total
    is split evenly and the label stays at lower confidence.
    """
    ks = range(1, cfg.trackers + 1)
    g = F.coalesce("gti", "ghi")
    p = F.coalesce("p_dc_w", "p_ac_w")
    d = df.withColumns({"_g": g, "_real": F.coalesce(*[F.col(f"mppt{k}_idc_a") for k in ks]).isNotNull()})
    d = d.filter(V.flag(F.col("_g") >= cfg.day_g) | V.flag(p >= cfg.day_p))
    d = d.filter(F.col("_real") | (F.col("i_dc_a").isNotNull() & F.lit(cfg.total_fallback)))
    off = V.flag(F.col("_g") >= cfg.off_g) & (V.flag(F.col("p_ac_w") <= cfg.off_p) | V.flag(F.col("p_dc_w") <= cfg.off_p))
    d = d.withColumns(
        {
            "_off": off,
            "_i": F.when(F.col("_real"), F.array(*[F.struct(F.lit(k).alias("mppt"), F.col(f"mppt{k}_idc_a").alias("i")) for k in ks])).otherwise(
                F.array(*[F.struct(F.lit(k).alias("mppt"), (F.col("i_dc_a") / cfg.trackers).alias("i")) for k in ks])
            ),
        }
    )
    d = d.select(*keys, "_g", "_real", "_off", "_i", F.inline("_i")).filter(F.col("i").isNotNull())
    peers = F.sort_array(F.transform(F.filter("_i", lambda x: (x["mppt"] != F.col("mppt")) & x["i"].isNotNull()), lambda x: x["i"]))
    d = d.withColumn("_peers", peers)
    top = F.coalesce(F.array_max("_peers"), F.lit(0.0))
    middle = F.coalesce(F.get("_peers", F.floor(F.size("_peers") / 2).cast("int")), F.lit(0.0))
    i, real = F.col("i"), F.col("_real")
    gone = real & V.flag(F.col("_g") >= cfg.disconnect_g) & (top >= cfg.peer_a) & ((i <= cfg.zero_a) | ((top > 0) & (i <= cfg.disconnect_ratio * top)))
    weak = real & V.flag(F.col("_g") >= cfg.imbalance_g) & (middle >= cfg.imbalance_peer_a) & (middle > 0) & (i <= cfg.imbalance_ratio * middle)
    # fixed values: label, code and probability of each rule
    out = (
        F.when(F.col("_off"), F.struct(F.lit("inverter_off_under_sun").alias("label"), F.lit(2).alias("code"), F.lit(0.93).alias("p")))
        .when(gone, F.struct(F.lit("mppt_disconnected").alias("label"), F.lit(1).alias("code"), F.lit(0.95).alias("p")))
        .when(weak, F.struct(F.lit("mppt_imbalance").alias("label"), F.lit(3).alias("code"), F.lit(0.88).alias("p")))
        .otherwise(F.struct(F.lit("normal").alias("label"), F.lit(0).alias("code"), F.when(real, 0.80).otherwise(0.60).alias("p")))
    )
    d = d.withColumn("_o", out)
    return d.select(*keys, "mppt", F.col("_o.label").alias("pred_label"), F.col("_o.code").alias("pred_code"), F.col("_o.p").alias("pred_pmax"))


def scalers(bins: DataFrame, trackers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """99th percentiles per plant with floors; an empty channel scales by its floor or 1."""
    floors = {"pac": ("p_ac_w", 1.0), "vdc_total": ("v_dc_v", 1.0), "iac": ("i_ac_a", 0.1), "pac_model": ("pac_model_w", 1.0), "g": ("g_poa", 50.0), "t": ("temp_air", 10.0)}
    p99 = lambda c, f: F.greatest(F.coalesce(F.percentile(c, 0.99), F.lit(1.0)), F.lit(f))
    a = bins.groupBy(*keys).agg(*[p99(F.col(c), f).alias(f"{n}_p99") for n, (c, f) in floors.items() if c in bins.columns])
    b = trackers.groupBy(*keys).agg(
        p99(F.col("v"), 1.0).alias("mppt_vdc_p99"), p99(F.col("i"), 0.1).alias("mppt_idc_p99"), p99(F.col("v") * F.col("i"), 1.0).alias("mppt_pdc_p99")
    )
    return a.join(b, list(keys), "left")


def scaled(x: Column, scale: Column, clip: float = 3.0, positive: bool = True) -> Column:
    y = F.coalesce(x, F.lit(0.0)) / F.greatest(scale, F.lit(1e-9))
    return F.greatest(F.least(y, F.lit(clip)), F.lit(0.0 if positive else -clip))


def scaled_mismatch(mm: Column, clip: float = 2.0) -> Column:
    return F.greatest(F.least(F.coalesce(mm, F.lit(0.0)), F.lit(clip)), F.lit(-clip)) / clip


def scaled_frequency(freq: Column, median: Column) -> Column:
    base = F.when(median > 55.0, 60.0).otherwise(50.0)
    return F.when(median.isNull(), 0.0).otherwise(F.greatest(F.least((F.coalesce(freq, base) - base) / 5.0, F.lit(1.0)), F.lit(-1.0)))


def nominal_normalise(v: Column, i: Column, n_series: Column, n_parallel: Column, voc: Column, isc: Column) -> tuple[Column, Column, Column]:
    """Voltage and current against the string's open-circuit and short-circuit values, and their product."""
    vn = v / F.greatest(n_series * voc, F.lit(1e-6))
    cn = i / F.greatest(n_parallel * isc, F.lit(1e-6))
    return vn, cn, vn * cn


def weather_inputs(g: Column, air: Column) -> tuple[Column, Column]:
    return V.clamp(g / 1000.0, 0.0, 2.0), V.clamp((air + 10.0) / 60.0, -1.0, 2.0)


NODE_FEATURES = ("v_mppt_n", "i_mppt_n", "pdc_est_n", "i_rel", "v_rel", "share_p", "dv_mppt", "di_mppt", "pac_n", "vdc_total_n", "iac_n",
                 "pac_model_n", "mismatch_n", "g_n", "t_n", "dpac", "dmm", "vac_n", "freq_n")


def node_features(trackers: DataFrame, keys: Sequence[str], day: str = "day", time: str = BIN, eps: float = 1e-9) -> DataFrame:
    """The fixed 19 features of each tracker and step.

    Needs v, i and the plant's values and scalers on each row.  Differences restart every day, so the
    windows are one day long; peer statistics are per instant, and an instant lies in one day of its keys.
    Rows are dealt by day once, with their finished features; all windows work on that one shuffle.
    """
    c = F.col
    pdc = c("v") * c("i")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    clip = lambda x, lo, hi: F.greatest(F.least(x, F.lit(hi)), F.lit(lo))
    own = {
        "v_mppt_n": scaled(c("v"), c("mppt_vdc_p99")), "i_mppt_n": scaled(c("i"), c("mppt_idc_p99")), "pdc_est_n": scaled(pdc, c("mppt_pdc_p99")),
        "pac_n": scaled(c("p_ac_w"), c("pac_p99")), "vdc_total_n": scaled(c("v_dc_v"), c("vdc_total_p99")), "iac_n": scaled(c("i_ac_a"), c("iac_p99")),
        "pac_model_n": scaled(c("pac_model_w"), c("pac_model_p99")), "mismatch_n": scaled_mismatch(c("mismatch_rel")),
        "g_n": scaled(c("g_poa"), c("g_p99")), "t_n": scaled(c("temp_air"), c("t_p99")), "vac_n": scaled(c("v_ac_v"), F.lit(1000.0)),
    }
    freq = c("freq_hz") if "freq_hz" in trackers.columns else F.lit(None).cast("double").alias("freq_hz")
    for k in (*keys, time):
        trackers = trackers.filter(c(k).isNotNull())
    d = trackers.select(*keys, day, time, "mppt", "v", "i", "mppt_vdc_p99", freq, *[e.alias(n) for n, e in own.items()]).repartition(*keys, day)
    instant, whole = Window.partitionBy(*keys, day, time), Window.partitionBy(*keys, day)
    w = Window.partitionBy(*keys, day, "mppt").orderBy(time)
    step = lambda n: zero(c(n) - F.lag(n).over(w))
    d = d.withColumns(
        {
            "_im": zero(F.percentile("i", 0.5).over(instant)), "_vm": zero(F.percentile("v", 0.5).over(instant)), "_ps": zero(F.sum(pdc).over(instant)),
            "_fm": F.when(c(day).isNotNull(), F.percentile("freq_hz", 0.5).over(whole)),
        }
    ).withColumns(
        {
            "i_rel": clip(zero(c("i")) / (c("_im") + eps), 0.0, 5.0), "v_rel": clip((zero(c("v")) - c("_vm")) / (c("mppt_vdc_p99") + eps), -3.0, 3.0),
            "share_p": clip(zero(pdc) / (c("_ps") + eps), 0.0, 1.0), "freq_n": scaled_frequency(c("freq_hz"), c("_fm")),
            "dv_mppt": clip(step("v_mppt_n"), -1.0, 1.0), "di_mppt": clip(step("i_mppt_n"), -1.0, 1.0), "dpac": step("pac_n"), "dmm": step("mismatch_n"),
        }
    )
    return d.select(*keys, day, time, "mppt", *NODE_FEATURES)


def day_vectors(features: DataFrame, keys: Sequence[str], day: str = "day", time: str = BIN, names: Sequence[str] = NODE_FEATURES) -> DataFrame:
    """One flat feature array per tracker and day, steps in time order (at most one day per group)."""
    row = F.struct(F.col(time).alias("t"), F.array(*names).alias("f"))
    return features.groupBy(*keys, day, "mppt").agg(F.flatten(F.transform(F.sort_array(F.collect_list(row)), lambda r: r["f"])).alias("features"))


def sliding_windows(df: DataFrame, s: S.Series, columns: Sequence[str], stride: int = 4, steps: int = WINDOW_STEPS,
                    active: Sequence[str] = (), min_active: int = 2) -> DataFrame:
    """Trailing windows of `steps` rows every `stride` rows, as arrays per column.

    Kept when at least `min_active` of the `active` columns are above 0.001 in 10 % of their steps.
    """
    b = S.blocks(df, s, before=steps - 1)
    marks = [F.when(F.col(c) > 0.001, 1).otherwise(0).alias(f"_a{n}") for n, c in enumerate(active)]
    row = F.struct(S.POS, S.HALO, F.col(s.time).alias("_t"), *columns, *marks)
    # one array for a block and its halo; every due row takes its slice, so a row is copied once per window it is due in
    held = b.groupBy(*s.keys, S.BLOCK).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    places = F.filter(F.sequence(F.lit(0), F.size("_rows") - 1), lambda k: ~_at(k)[S.HALO] & (_at(k)[S.POS] >= steps - 1) & ((_at(k)[S.POS] - (steps - 1)) % stride == 0))
    due = held.select(*s.keys, "_rows", F.explode(places).alias("_k"))
    due = due.select(*s.keys, _at(F.col("_k"))["_t"].alias("ts_end"), F.slice("_rows", F.col("_k") - (steps - 2), F.lit(steps)).alias("_w"))
    if active:
        total = lambda n: F.aggregate("_w", F.lit(0), lambda sum_, r: sum_ + r[f"_a{n}"])
        live = sum((F.when(total(n) / steps >= 0.10, 1).otherwise(0) for n in range(len(active))), F.lit(0))
        due = due.filter(live >= min_active)
    return due.select(*s.keys, "ts_end", *[F.transform("_w", _field(c)).alias(c) for c in columns])


def _at(k: Column) -> Column:
    return F.get(F.col("_rows"), k)


def _field(name: str):
    return lambda row: row[name]


IGNORE = -100


def weak_labels(df: DataFrame, s: S.Series, currents: Sequence[str], g: str = "g_poa", gate: float = 300.0, low: float = 0.02, peer: float = 0.05,
                min_sun: int = 12, min_peer: int = 12, steps: int = WINDOW_STEPS, stride: int = 1) -> DataFrame:
    """Per window and tracker: 1 disconnected, 0 normal, -100 not judged (framed counts, no arrays)."""
    b = S.blocks(df, s, before=steps - 1)
    frame = s.blocked.rowsBetween(-(steps - 1), 0)
    sun = V.flag(F.col(g) >= gate)
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).over(frame)
    cols = {"_sun": count(sun)}
    for n, c in enumerate(currents):
        ok = sun & F.col(c).isNotNull()
        cols |= {f"_n{n}": count(ok), f"_low{n}": count(ok & (F.col(c) <= low)), f"_on{n}": count(ok & (F.col(c) >= peer))}
    b = S.core(b.withColumns(cols)).filter((F.col(S.POS) >= steps - 1) & ((F.col(S.POS) - (steps - 1)) % stride == 0))
    live = {n: (F.col(f"_n{n}") >= min_peer) & (F.col(f"_on{n}") / F.col(f"_n{n}") >= 0.5) for n in range(len(currents))}
    out = []
    for n in range(len(currents)):
        others = F.lit(False)
        for m in live:
            if m != n:
                others = others | F.coalesce(live[m], F.lit(False))
        judged = (F.col("_sun") >= min_sun) & (F.col(f"_n{n}") >= min_sun)
        dead = others & (F.col(f"_low{n}") / F.col(f"_n{n}") >= 0.7)
        out.append(F.when(~judged, IGNORE).when(dead, 1).otherwise(0).alias(f"y{n + 1}"))
    return b.select(*s.keys, F.col(s.time).alias("ts_end"), *out)


def edge_features(nominals: DataFrame, key: str = "plant_id") -> DataFrame:
    """Normalised differences of series and parallel counts between trackers of one plant."""
    a = nominals.select(key, F.col("mppt").alias("mppt_a"), F.col("n_series").alias("_sa"), F.col("n_parallel").alias("_pa"))
    b = nominals.select(key, F.col("mppt").alias("mppt_b"), F.col("n_series").alias("_sb"), F.col("n_parallel").alias("_pb"))
    delta = lambda x, y: (F.col(x) - F.col(y)) / F.greatest(F.abs(x), F.abs(y), F.lit(1.0))
    return a.join(b, key).filter("mppt_a != mppt_b").select(
        key, "mppt_a", "mppt_b", F.lit(0.0).alias("d_tilt"), F.lit(0.0).alias("d_azimuth"), delta("_sa", "_sb").alias("d_series"), delta("_pa", "_pb").alias("d_parallel")
    )


def event_windows(events: DataFrame, bins: DataFrame, keys: Sequence[str], event: str, margin_bins: int = 8, time: str = BIN,
                  start: str = "ts_start_utc", end: str = "ts_end_utc") -> DataFrame:
    """Bins of each event with its context before and after; grid instants without data stay as NULL rows."""
    pad = margin_bins * 900
    grid = F.sequence(F.unix_seconds(start) - pad, F.unix_seconds(end) + pad, F.lit(900).cast("long"))
    e = events.withColumn("_s", F.explode(grid)).withColumn(time, F.timestamp_seconds("_s")).drop("_s")
    e = e.withColumn("in_event", F.col(time).between(F.col(start), F.col(end)))
    return e.join(bins, [*keys, time], "left")


def event_plant_features(win: DataFrame, event: str, cap: str = "pac_cap") -> DataFrame:
    """Plant-level facts of each event (missing power counts as zero power)."""
    c = F.col
    caps = win.groupBy(event).agg(F.coalesce(F.percentile("p_ac_w", 0.99), F.lit(0.0)).alias(cap))
    d = win.filter("in_event").join(caps, event)
    ratio = F.when(c("p_ac_w").isNotNull() & c("pac_model_w").isNotNull(), c("p_ac_w") / F.greatest(F.abs("pac_model_w"), F.lit(50.0))).otherwise(0.0)
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    g = F.coalesce("g_poa", F.lit(0.0))
    zero = F.coalesce("p_ac_w", F.lit(0.0)) <= F.greatest(F.lit(100.0), 0.05 * c(cap))
    clipped = V.flag((c(cap) > 0) & (c("p_ac_w") >= 0.98 * c(cap)) & (c("pac_model_w") > c("p_ac_w") * 1.02))
    none = lambda x: F.coalesce(x, F.lit(0.0))
    return d.groupBy(event).agg(
        F.count(F.lit(1)).alias("duration_bins"), none(F.avg("mismatch_rel")).alias("mismatch_mean"), none(F.min("mismatch_rel")).alias("mismatch_min"),
        none(F.max(F.abs("mismatch_rel"))).alias("mismatch_abs_max"), F.avg(ratio).alias("pac_ratio_mean"), share(zero).alias("zero_power_frac"),
        share(clipped).alias("clip_frac"), none(F.avg("g_poa")).alias("g_mean"), share(g >= 800).alias("g_high_frac"), share((g >= 700) & (g < 800)).alias("g_mid_frac"),
    )


def event_tracker_features(win: DataFrame, event: str, time: str = BIN, eps: float = 1e-9) -> DataFrame:
    """Relative current, voltage and power share per tracker; a missing value counts as ratio 0."""
    c = F.col
    d = win.filter("in_event").withColumn("_p", c("v") * c("i"))
    peers = d.groupBy(event, time).agg(
        F.percentile("i", 0.5).alias("_im"), F.percentile("v", 0.5).alias("_vm"), F.coalesce(F.sum("_p"), F.lit(0.0)).alias("_ps")
    )
    n = d.groupBy(event).agg(F.count_distinct("mppt").alias("_n"))
    d = d.join(peers, [event, time]).join(n, event)
    part = lambda x, y: F.when(c(x).isNotNull(), c(x) / F.greatest(y, F.lit(eps))).otherwise(0.0)
    d = d.withColumns({"_ir": part("i", c("_im")), "_vr": part("v", F.abs("_vm")), "_sh": part("_p", c("_ps"))})
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    return d.groupBy(event, "mppt").agg(
        F.percentile("_ir", 0.5).alias("i_rel_med"), F.min("_ir").alias("i_rel_min"), F.percentile("_vr", 0.5).alias("v_rel_med"),
        F.percentile("_sh", 0.5).alias("share_p_med"), F.min("_sh").alias("share_p_min"), share(c("_ir") <= 0.15).alias("outage_frac"),
        share(c("_ir") <= 0.50).alias("low_i_frac"), share(c("_vr") <= 0.80).alias("low_v_frac"),
        share(c("_sh") <= 0.50 / F.greatest("_n", F.lit(1))).alias("share_low_frac"), F.coalesce(F.avg("_p"), F.lit(0.0)).alias("pdc_mean_w"),
    )


# fixed values: codes of the event classifier
EVENT_CODES = {"normal": 0, "probable_mppt_disconnect": 1, "dc_side_partial_loss": 2, "mppt_imbalance": 3, "grid_fault": 4,
               "inverter_shutdown": 5, "curtailment_clipping": 6, "persistent_underperformance": 7, "unknown_fault": 99}


def classify_events(features: DataFrame, threshold: float = 0.60, prelim: str = "event_label_prelim") -> DataFrame:
    """Ordered rules per event and tracker; weak results become unknown_fault (open set)."""
    c = F.col
    pre = c(prelim)
    loss = pre.isin("dc_side_partial_loss", "persistent_underperformance")
    result = lambda label, conf: F.struct(F.lit(label).alias("label"), (conf if isinstance(conf, Column) else F.lit(conf)).alias("conf"))
    r = (
        F.when(pre == "grid_fault", result("grid_fault", 0.92)).when(pre == "inverter_shutdown", result("inverter_shutdown", 0.88))
        .when((pre == "curtailment_clipping") | (c("clip_frac") >= 0.50), result("curtailment_clipping", 0.90))
        .when(loss & (c("outage_frac") >= 0.60) & (c("i_rel_med") <= 0.20), result("probable_mppt_disconnect", F.least(F.lit(0.95), 0.72 + 0.20 * c("outage_frac"))))
        .when(loss & (c("low_i_frac") >= 0.60) & (c("share_low_frac") >= 0.50) & (c("i_rel_med") <= 0.65), result("mppt_imbalance", 0.78))
        .when(loss & (c("pac_ratio_mean") <= 0.75) & (c("g_mean") >= 700.0), result("dc_side_partial_loss", 0.70))
        .when(loss, result("persistent_underperformance", 0.58)).otherwise(result("normal", 0.55))
    )
    d = features.withColumn("_r", r)
    label, conf = c("_r.label"), c("_r.conf")
    open_set = (conf < threshold) & ~label.isin("grid_fault", "inverter_shutdown")
    d = d.withColumns({"pred_label": F.when(open_set, "unknown_fault").otherwise(label), "confidence": conf, "novelty_score": 1.0 - conf})
    return d.withColumn("pred_code", V.lookup(c("pred_label"), EVENT_CODES, F.lit(99))).drop("_r")


def resolve_events(preds: DataFrame, event: str, prelim: str = "event_label_prelim", dominant: str = "dominant_diagnosis") -> DataFrame:
    """Final label of an event from its trackers' predictions: known labels by summed confidence."""
    c = F.col
    known = ~c("pred_label").isin("normal", "unknown_fault")
    sums = preds.groupBy(event, prelim, dominant, "pred_label").agg(
        F.sum("confidence").alias("_c"), F.sum("novelty_score").alias("_v"), F.count(F.lit(1)).alias("_n"))
    g = sums.groupBy(event, prelim, dominant).agg(
        F.min_by("pred_label", F.when(known, F.struct(-c("_c"), c("pred_label")))).alias("_k"),
        *[F.sum(F.when(known, c(x))).alias(f"_k{x}") for x in ("_c", "_v", "_n")],
        *[F.sum(F.when(c("pred_label") == "unknown_fault", c(x))).alias(f"_u{x}") for x in ("_c", "_v", "_n")],
    )
    pre = c(prelim)
    told = F.coalesce(F.nullif(c(dominant), F.lit("")), pre)
    row = lambda label, kind, conf, nov: F.struct(label.alias("final_label"), F.lit(kind).alias("known_vs_unknown"), conf.alias("confidence"), nov.alias("novelty_score"))
    r = (
        F.when(pre == "curtailment_clipping", row(told, "known", F.lit(0.82), F.lit(0.12)))
        .when(pre.isin("grid_fault", "inverter_shutdown"), row(told, "known", F.lit(0.88), F.lit(0.12)))
        .when(c("_k").isNotNull(), row(c("_k"), "known", c("_k_c") / c("_k_n"), c("_k_v") / c("_k_n")))
        .when(pre.isin("dc_side_partial_loss", "persistent_underperformance"), row(told, "known", F.lit(0.62), F.lit(0.38)))
        .when(c("_u_n") > 0, row(F.lit("unknown_fault"), "unknown", c("_u_c") / c("_u_n"), c("_u_v") / c("_u_n")))
        .otherwise(row(F.lit("normal"), "known", F.lit(0.55), F.lit(0.45)))
    )
    return g.select(event, r.alias("_r")).select(event, "_r.*")


@dataclass(frozen=True)
class DayConfig:
    g_gate: float = 120.0
    min_points: int = 12
    pac_gate: float = 80.0
    model_gate: float = 80.0
    max_abs_p90: float = 0.50
    days: int = 60


def training_days(df: DataFrame, keys: Sequence[str], day: str = "day", cfg: DayConfig = DayConfig()) -> DataFrame:
    """Usable and normal flag per day and the newest base days (normal ones, else usable ones)."""
    c = F.col
    lit_ = V.flag(c("g_poa") >= cfg.g_gate) & c("p_ac_w").isNotNull()
    d = df.withColumn("_sun", lit_)
    modelled = F.count(F.when(c("_sun"), c("pac_model_w")))
    flags = d.groupBy(*keys, day).agg(
        F.count_if("_sun").alias("_n"), F.percentile(F.when(c("_sun"), c("p_ac_w")), 0.9).alias("_p90"), modelled.alias("_nm"),
        F.percentile(F.when(c("_sun"), F.abs("mismatch_rel")), 0.9).alias("_m_all"), F.count(F.when(c("_sun"), c("mismatch_rel"))).alias("_k_all"),
        F.percentile(F.when(c("_sun") & (c("pac_model_w") >= cfg.model_gate), F.abs("mismatch_rel")), 0.9).alias("_m_mod"),
        F.count(F.when(c("_sun") & (c("pac_model_w") >= cfg.model_gate), c("mismatch_rel"))).alias("_k_mod"),
    )
    usable = (c("_n") >= cfg.min_points) & V.flag(c("_p90") >= cfg.pac_gate)
    gated = c("_nm") >= cfg.min_points
    k, m = F.when(gated, c("_k_mod")).otherwise(c("_k_all")), F.when(gated, c("_m_mod")).otherwise(c("_m_all"))
    normal = usable & F.when(k >= cfg.min_points, m <= cfg.max_abs_p90).otherwise(True)
    flags = flags.select(*keys, day, usable.alias("usable"), normal.alias("normal"))
    any_normal = flags.groupBy(*keys).agg(F.max("normal").alias("_any"))
    picked = flags.join(any_normal, list(keys)).withColumn("_pick", F.when(c("_any"), c("normal")).otherwise(c("usable")))
    w = Window.partitionBy(*keys, "_pick").orderBy(c(day).desc())
    return picked.withColumn("_r", F.row_number().over(w)).withColumn("base", c("_pick") & (c("_r") <= cfg.days)).drop("_any", "_pick", "_r")


# fixed values: share and multipliers of the injected faults
FAULT_SHARES = ((1, 0.25), (2, 0.20), (3, 0.25), (4, 0.20), (5, 0.10))


def inject_faults(trackers: DataFrame, keys: Sequence[str], copies: int = 6, day: str = "day", time: str = BIN, g_gate: float = 120.0) -> DataFrame:
    """Copies of each day with one planted fault; the choice depends only on plant, day and copy.

    Faults: 1 one tracker disconnected, 2 inverter off, 3 one tracker weak around noon, 4 curtailed,
    5 inflated irradiance.  Mismatch is recomputed afterwards.  A single-tracker fault hits one of the trackers
    that the plant has rows of on that day.
    """
    c = F.col
    part = [*keys, day]
    whole = Window.partitionBy(*part)
    # what does not depend on the copy is told on the rows of a day, which one shuffle brings together; copies are made after it.
    # the number of partitions is given: merged by their size before the copies they would hold too much after them
    tasks = int(trackers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = trackers.withColumn("_sun", V.flag(c("g_poa") >= g_gate)).repartition(tasks, *part)
    steps = Window.partitionBy(*part, "_sun").orderBy(time)
    peers = Window.partitionBy(*part, time).orderBy("mppt").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # trackers of a bin share its expected power: it counts once
    once = F.row_number().over(Window.partitionBy(*part, time, "_sun", "pac_model_w").orderBy("mppt")) == 1
    d = d.withColumns({"_i": F.dense_rank().over(steps) - 1, "_once": once, "_peers": F.collect_list(F.struct("mppt", "v", "i")).over(peers)})
    d = d.withColumns({
        "_there": F.sort_array(F.collect_set("mppt").over(whole)), "_n": F.max("_i").over(Window.partitionBy(*part, "_sun")) + 1,
        "_ref": F.percentile(F.when(c("_sun") & c("_once"), c("pac_model_w")), 0.95).over(whole),
    })
    d = d.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    draw = lambda n: F.pmod(F.xxhash64(*keys, F.col(day).cast("string"), "copy", F.lit(n)), F.lit(10000)) / 10000.0
    u, code, reach = draw(1), None, 0.0
    for k, share in FAULT_SHARES[:-1]:
        reach += share
        code = F.when(u < reach, k) if code is None else code.when(u < reach, k)
    d = d.withColumns({"fault": code.otherwise(FAULT_SHARES[-1][0]), "hit": F.get("_there", F.floor(draw(2) * F.size("_there")).cast("int")).cast("int"),
                       "_a": 0.35 + 0.10 * draw(3), "_b": 0.70 + 0.10 * draw(4), "_standby": 0.85 + 0.10 * draw(5)})
    mine, sun, f = c("mppt") == c("hit"), c("_sun"), c("fault")
    noon = (c("_n") <= 10) | ((c("_i") >= F.floor(c("_n") * c("_a"))) & (c("_i") < F.floor(c("_n") * c("_b"))))

    def planted(own: Column, v: Column, i: Column) -> tuple[Column, Column]:
        current = F.when(sun & (f == 2), i * 0.01).when(sun & own & (f == 1), i * 0.02).when(sun & own & (f == 3) & noon, i * 0.35).otherwise(i)
        return F.when(sun & own & (f == 1), v * 1.10).otherwise(v), current

    def power_of(row: Column) -> Column:
        v, i = planted(row["mppt"] == c("hit"), row["v"], row["i"])
        return F.coalesce(v * i, F.lit(0.0))

    volts, current = planted(mine, c("v"), c("i"))
    total = F.aggregate("_peers", F.lit(0.0), lambda a, row: a + power_of(row))
    limit = F.coalesce(F.when(c("_ref") > 0, c("_ref")), F.lit(1000.0)) * 0.65
    pac = (
        F.when(sun & (f == 2), c("p_ac_w") * 0.01).when(sun & f.isin(1, 3) & c("p_ac_w").isNotNull(), F.least("p_ac_w", total))
        .when(sun & (f == 4) & c("p_ac_w").isNotNull(), F.least(c("p_ac_w"), limit)).otherwise(c("p_ac_w"))
    )
    grow = F.when(sun & (f == 5), 1.35).otherwise(1.0)
    extra = {"i_ac_a": F.when(sun & (f == 2), c("i_ac_a") * 0.01).otherwise(c("i_ac_a"))} if "i_ac_a" in trackers.columns else {}
    if "v_dc_v" in trackers.columns:
        extra["v_dc_v"] = F.when(sun & (f == 2), c("v_dc_v") * c("_standby")).otherwise(c("v_dc_v"))
    d = d.withColumns({"i": current, "v": volts, "p_ac_w": pac, "g_poa": c("g_poa") * grow, "pac_model_w": c("pac_model_w") * grow, **extra})
    y = F.when(f.isin(2, 4, 5), f).when(mine, f).otherwise(0)
    d = d.withColumns({"mismatch_rel": V.residual_rel(c("p_ac_w"), c("pac_model_w")), "y": y})
    return d.drop("_sun", "_a", "_b", "_standby", "_i", "_n", "_ref", "_once", "_peers", "_there")


def temporal_split(df: DataFrame, keys: Sequence[str], day: str = "day", fraction: float = 0.2, min_days: int = 1) -> DataFrame:
    """Newest days are held out: max(round(n·fraction), minimum), clamped to 1..n-1; one day trains only."""
    days = df.select(*keys, day).distinct()
    n = days.groupBy(*keys).agg(F.count(F.lit(1)).alias("_days"))
    w = Window.partitionBy(*keys).orderBy(F.col(day).desc())
    d = days.withColumn("_r", F.row_number().over(w)).join(n, list(keys))
    k = F.greatest(F.lit(1), F.least(F.greatest(F.bround(F.col("_days") * fraction), F.lit(min_days)), F.col("_days") - 1))
    held = (F.col("_days") >= 2) & (F.col("_r") <= k)
    return df.join(d.select(*keys, day, F.when(held, "validation").otherwise("train").alias("split")), [*keys, day])


def model_health(meta: DataFrame) -> DataFrame:
    """Verdict on a trained version from its validation numbers (`metrics_source`, f1, samples, days)."""
    c = F.col
    share = c("validation_samples") / F.nullif(c("total_samples"), F.lit(0))
    valid = (c("metrics_source") == "validation") & c("f1_macro").isNotNull() & c("balanced_accuracy").isNotNull()
    short = (c("validation_samples") < 50) | (c("validation_days") < 5) | V.flag(share < 0.10)
    good = (c("f1_macro") >= 0.75) & (c("balanced_accuracy") >= 0.70) & (c("validation_samples") >= 500) & (c("validation_days") >= 14)
    fair = (c("f1_macro") >= 0.55) & (c("balanced_accuracy") >= 0.60) & (c("validation_samples") >= 300) & (c("validation_days") >= 10)
    status = (
        F.when(valid & short, "atencao").when(valid & good, "confiavel").when(valid & fair, "atencao").when(valid, "recalibrar")
        .when((c("metrics_source") == "train") & (c("train_samples") > 0), "atencao").otherwise("recalibrar")
    )
    return meta.withColumns({"coverage_fraction": V.clamp(share, 0.0, 1.0), "status": status})
