"""Bins → fault events, event look-ups, reviews and rankings."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunloom.config import EventConfig
from sunloom.functions import labels as LB
from sunloom.functions import timegrid as tg
from sunloom.functions import values as V
from sunloom.operators import keys as K
from sunloom.operators import series as S

DAY_SECONDS = 86400


def sessions(df: DataFrame, s: S.Series, cfg: EventConfig = EventConfig(), dt: str = "fixed") -> DataFrame:
    """Group rows whose distance to the previous one is at most bin · (gap_bins + 1).

    `dt="first_gap"` takes the bin length from the first two rows of the series.
    """
    marked = S.previous(df, s, {"_prev": s.time})
    gap = tg.minutes_between(s.time, "_prev")
    if dt == "first_gap":
        first = marked.filter(F.col(S.POS) == 1).select(*s.keys, F.greatest(F.bround(gap), F.lit(1.0)).alias("_dt"))
        marked = S.attach(marked, S._join(marked.select(*s.keys).distinct(), first, s.keys), s)
        limit = F.coalesce("_dt", F.lit(float(cfg.bin_minutes))) * (cfg.gap_bins + 1)
        opens = F.col("_prev").isNull() | (gap > limit)
        return S.without_marks(S.islands(marked, s, opens)).drop("_prev", "_dt")
    opens = F.col("_prev").isNull() | (gap > cfg.bin_minutes * (cfg.gap_bins + 1))
    return S.without_marks(S.islands(marked, s, opens)).drop("_prev")


def fault_events(diag: DataFrame, s: S.Series, cfg: EventConfig = EventConfig()) -> DataFrame:
    """Anomalous bins → events with scores, energy loss, preliminary label, domain and state."""
    return events_of(sessions(diag.filter(V.flag("anomaly_flag")), s, cfg), s, cfg).drop("island")


def events_of(rows: DataFrame, s: S.Series, cfg: EventConfig = EventConfig()) -> DataFrame:
    """Bins with their session number `island` → one row per session that is long enough."""
    name = V.first_filled("diagnosis_label")
    text = lambda c: V.normal_label(F.col(c))
    loss = F.greatest(F.col("pac_model_w") - F.col("pac_real_w"), F.lit(0.0)) * F.when(
        F.col("pac_model_w").isNotNull() & F.col("pac_real_w").isNotNull(), cfg.bin_minutes / 60.0)
    events = rows.groupBy(*s.keys, "island").agg(
        F.min(s.time).alias("ts_start_utc"), F.max(s.time).alias("ts_end_utc"), F.count(F.lit(1)).alias("n_bins"),
        F.max(F.abs("detector_score")).alias("detector_score_max"), F.avg("detector_score").alias("detector_score_mean"),
        F.max(F.abs("mismatch_rel")).alias("severity_score"), F.sum(loss).alias("energy_loss_wh"),
        F.coalesce(F.mode(F.when(~name.isin(*LB.BENIGN_DIAGNOSES), name), True), F.lit("unknown")).alias("_fault"),
        F.coalesce(F.mode(F.coalesce(name, F.lit("unknown")), True), F.lit("unknown")).alias("dominant_diagnosis"),
        F.mode(text("domain_label"), True).alias("domain_prelim"), F.mode(text("state_label"), True).alias("state_prelim"),
    ).filter(F.col("n_bins") >= cfg.min_bins)
    return events.withColumns({"event_label_prelim": LB.coarse_event(F.col("_fault")), "status": F.lit("open"),
                               "known_vs_unknown": F.lit("pending")}).drop("_fault")


def day_cells(df: DataFrame, start: str, end: str, name: str = "_cell", seconds: int = DAY_SECONDS) -> DataFrame:
    """One row per day an interval touches: turns interval joins into equi-joins on the day."""
    lo, hi = (F.floor(F.unix_seconds(c) / seconds) for c in (start, end))
    return df.withColumn(name, F.explode(F.sequence(lo, F.greatest(lo, hi))))


def bins_in_events(bins: DataFrame, events: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str],
                   start: str = "ts_start_utc", end: str = "ts_end_utc", how: str = "left") -> DataFrame:
    """Bins joined to every event covering them (both ends included)."""
    e = day_cells(events.select(*keys, *dict.fromkeys([start, end, *columns])), start, end)
    b = bins.withColumn("_cell", F.floor(F.unix_seconds(time) / DAY_SECONDS))
    renamed = e.select(*[F.col(k).alias(f"_e_{k}") for k in (*keys, "_cell")], F.struct(*dict.fromkeys([start, end, *columns])).alias("_ev"))
    cond = F.col("_cell") == F.col("_e__cell")
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_e_{k}"))
    cond = cond & F.col(time).between(F.col(f"_ev.{start}"), F.col(f"_ev.{end}"))
    return b.join(renamed, cond, how).drop("_cell", *[f"_e_{k}" for k in (*keys, "_cell")])


def first_event_per_bin(bins: DataFrame, events: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str], tie: str) -> DataFrame:
    """Overlay of the earliest-starting event covering each bin (NULL columns when none does)."""
    j = bins_in_events(bins, events, keys, time, list(dict.fromkeys([tie, *columns])))
    first = F.min_by("_ev", F.when(F.col("_ev").isNotNull(), F.struct(F.col("_ev.ts_start_utc"), F.col(f"_ev.{tie}"))))
    return j.groupBy(*keys, time).agg(first.alias("_f")).select(*keys, time, *[F.col(f"_f.{c}").alias(c) for c in columns])


def event_bins(events: DataFrame, keys: Sequence[str], score: Column, columns: Sequence[str], tz: Column | str = "UTC",
               bin_minutes: int = 15, tie: str = "ts_start_utc", start: str = "ts_start_utc", end: str = "ts_end_utc") -> DataFrame:
    """Events spread over their local day bins; the best score keeps each bin."""
    lo = tg.floor_to(tg.local(start, tz), bin_minutes)
    hi = tg.local(end, tz)
    steps = F.sequence(F.unix_seconds(lo), F.unix_seconds(hi), F.lit(bin_minutes * 60).cast("long"))
    e = events.withColumns({"_score": score, "_sec": F.explode(steps)})
    wall = F.timestamp_seconds("_sec")
    best = F.max_by(F.struct("_score", *columns), F.struct(F.col("_score"), -F.unix_seconds(F.col(start)), F.col(tie)))
    return e.groupBy(*keys, F.to_date(wall).alias("day"), tg.bin_of_day(wall, bin_minutes).alias("bin")).agg(best.alias("_b")).select(
        *keys, "day", "bin", F.col("_b._score").alias("score"), *[F.col(f"_b.{c}").alias(c) for c in columns]
    )


# fixed values: severity of event labels in rankings (unlisted labels count 2)
LABEL_SEVERITY = {"normal": 0, "curtailment_clipping": 1, "meteo_bias": 1, "mppt_imbalance": 2, "mppt_disconnected": 3,
                  "inverter_off_under_sun": 3, "localized_loss": 3, "plant_wide_loss": 3, "unknown_fault": 2, "invalid": 0,
                  "anomaly": 2, "no_oper_data": 0}
BENIGN_EVENTS = ("normal", "curtailment_clipping", "meteo_bias")


def _lower(label: Column) -> Column:
    return F.lower(F.trim(F.coalesce(label, F.lit(""))))


def label_severity(label: Column) -> Column:
    return V.lookup(_lower(label), LABEL_SEVERITY, F.lit(2))


def label_state(label: Column) -> Column:
    """0 none, 1 ok, 2 warn, 3 critical."""
    t = _lower(label)
    return F.when(t.isin("", "invalid", "no_oper_data"), 0).when(t.isin(*BENIGN_EVENTS), 1).otherwise(3)


def _or(c: Column, default: float) -> Column:
    """Missing and exactly 0 both fall back to the default, as the ranking rule has it."""
    return F.when(c.isNull() | (c == 0), F.lit(default)).otherwise(c)


def prediction_rank(label: Column, confidence: Column, novelty: Column) -> Column:
    known = F.coalesce((label != "") & (label != "unknown_fault"), F.lit(False)).cast("double")
    return label_severity(label) * 1e6 + known * 1e5 + _or(confidence, 0.0) * 1e4 - _or(novelty, 1.0) * 100.0


def event_score(label: Column, severity: Column, confidence: Column, novelty: Column) -> Column:
    return label_severity(label) * 1e9 + F.abs(_or(severity, 0.0)) * 1e6 + _or(confidence, 0.0) * 1e4 - _or(novelty, 1.0) * 1e3


def best_predictions(preds: DataFrame, key: str, rank: Column, tie: str) -> DataFrame:
    rest = [c for c in preds.columns if c != key]
    return preds.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(rank, -F.col(tie))).alias("_b")).select(key, "_b.*")


def event_at(instants: DataFrame, events: DataFrame, keys: Sequence[str], time: str, score: Column, columns: Sequence[str], tie: str) -> DataFrame:
    """Best-scoring event covering each instant."""
    j = bins_in_events(instants, events.withColumn("_score", score), keys, time, list(dict.fromkeys(["_score", tie, *columns])), how="inner")
    best = F.max_by("_ev", F.struct(F.col("_ev._score"), -F.col(f"_ev.{tie}")))
    return j.groupBy(*keys, time).agg(best.alias("_b")).select(*keys, time, *[F.col(f"_b.{c}").alias(c) for c in columns])


def event_listing(events: DataFrame, predictions: DataFrame, keys: Sequence[str], key: str, limit: int | None = None, start: str = "ts_start_utc") -> DataFrame:
    """Events of each plant in order of start with their best prediction: all, or the first `limit` that a page asks for."""
    top = K.rank_rows(events, keys, [F.col(start), F.col(key)], limit)
    return top.join(predictions, key, "left")


def review_events(events: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """Apply review decisions: status, known flag and final label follow the review state."""
    r = reviews.select(key, F.lower(F.trim("review_state")).alias("_state"), F.coalesce(F.col("final_label"), F.lit("")).alias("_final"))
    j = events.join(r, key, "left")
    st, final = F.col("_state"), F.col("_final")
    seen = st.isNotNull()
    named = (final != "") & (final != "unknown")
    return j.withColumns(
        {
            "status": F.when(st == "dismissed", "dismissed").when(st.isin("confirmed", "uncertain"), "reviewed")
            .when(seen, "open").otherwise(F.col("status")),
            "known_vs_unknown": F.when(st == "dismissed", "dismissed").when(st == "confirmed", F.when(named, "known").otherwise("unknown"))
            .when(st == "uncertain", "unknown").when(seen, "pending").otherwise(F.col("known_vs_unknown")),
            "final_label": F.when(seen & (final != ""), final).otherwise(F.col("final_label")),
            "review_state": F.coalesce(st, LB.review_state(F.lit(None).cast("string"), F.col("status"))),
        }
    ).drop("_state", "_final")


def truth_from_reviews(reviewed: DataFrame, key: str) -> DataFrame:
    """Truth rows of decided reviews: confirmed → fault with its group, dismissed and uncertain as such."""
    st = F.col("review_state")
    label = LB.display_label(F.col("final_label"), F.col("event_label_prelim"))
    return reviewed.filter(st.isin("confirmed", "dismissed", "uncertain")).select(
        "plant_id", F.col(key).alias("linked_event_id"), "ts_start_utc", "ts_end_utc", st.alias("truth_state"), label.alias("truth_label"),
        LB.truth_group(label, st).alias("truth_group"),
    )
