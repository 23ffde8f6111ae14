"""Streams run to their end over the event files, compared with the batch answers."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sunloom.config import BucketConfig, EventConfig
from sunloom.functions import timegrid as tg
from sunloom.gallery.landing_queries import REPLACED, replacement
from sunloom.gallery.registry import query
from sunloom.session import checkpoint_ready
from sunloom.sources.versions import VersionedTable
from sunloom.streaming import filters as X, jobs as J

P = ["plant_id"]


class _Stream:
    """The adapter tables over a streaming read of the events file."""

    def __init__(self, t):
        from sunloom.gallery.fixtures import Tables

        raw = t.raw("events")
        src = t.spark.readStream.schema(raw.schema).option("pathGlobFilter", "events.parquet").parquet(t.dir)

        class Streaming(Tables):
            def raw(self, name):
                return src

        self.tables = Streaming(t.spark, t.dir)


def live(t):
    return _Stream(t).tables


# every sixteenth row is delivered when its bucket has long been closed
LATE = "event_id % 16 = 5"


def in_parts(rows, time="ts_utc"):
    """Two halves of the month in time order, the row that closes them, then the late rows; all rows are delivered."""
    late, first = F.expr(LATE), F.dayofmonth(time) <= 15
    return [rows.filter(~late & first), rows.filter(~late & ~first), J.closing_row(rows, time), rows.filter(late)]


def delivered(rows, job, time="ts_utc"):
    landed, closed = J.run_deliveries(in_parts(rows, time), job)
    return landed.filter("event_id IS NOT NULL"), closed


@query("i04_stream_drop_repeats",
       f"""WITH m AS (SELECT device_key, date_trunc('minute', ts_utc) AS ts_utc, bool_and({LATE}) AS only_late FROM telemetry GROUP BY 1, 2)
           SELECT device_key, count_if(NOT only_late) AS n, count_if(only_late) AS late_n FROM m GROUP BY 1""", longs=["n", "late_n"])
def repeats(t):
    rows = t.telemetry.select("device_key", "event_id", F.date_trunc("minute", "ts_utc").alias("ts_utc"))
    landed, kept = delivered(rows, lambda s: J.drop_repeats(s, ["device_key"]))
    kept = kept.filter("event_id IS NOT NULL").groupBy("device_key").agg(F.count(F.lit(1)).alias("n"))
    return J.count_late(landed.select("device_key", "ts_utc").distinct(), kept, ["device_key"], "n").withColumn("n", F.coalesce("n", F.lit(0)))


@query("i05_stream_buckets",
       f"""WITH b AS (SELECT plant_id, time_bucket(INTERVAL 15 MINUTE, ts_utc) AS ts_15, avg(p_ac_w) FILTER (NOT ({LATE})) AS p_ac_w, sum(p_ac_w * (5.0::DOUBLE / 60.0::DOUBLE)) FILTER (NOT ({LATE})) AS e_ac_wh_15,
             nullif(count_if(NOT ({LATE})), 0) AS inv_n, count_if({LATE}) AS late_n FROM telemetry GROUP BY 1, 2)
           SELECT plant_id, ts_15, p_ac_w, e_ac_wh_15, inv_n, CASE WHEN inv_n IS NOT NULL THEN least(inv_n / 3.0::DOUBLE, 1.0::DOUBLE) END AS inv_coverage,
             CASE WHEN inv_n IS NOT NULL THEN least(inv_n / 3.0::DOUBLE, 1.0::DOUBLE) < 0.7 END AS flag_low_coverage, late_n FROM b""",
       ["p_ac_w", "e_ac_wh_15", "inv_coverage"], longs=["inv_n", "late_n"])
def buckets(t):
    rows = t.telemetry.select("plant_id", "ts_utc", "p_ac_w", "event_id")
    landed, closed = delivered(rows, lambda s: J.bucket_power(s, P, BucketConfig(mean_cols=("p_ac_w",))))
    return J.count_late(landed.select("plant_id", tg.floor_to("ts_utc").alias("ts_15")), closed, ["plant_id", "ts_15"], "inv_n")


@query("i06_stream_sky_stability",
       f"""WITH w AS (SELECT plant_id, time_bucket(INTERVAL 15 MINUTE, ts_utc) + to_minutes(15 * k) AS ts_15, v_dc_v, {LATE} AS late FROM telemetry, (SELECT unnest(range(0, 6)) AS k)),
             a AS (SELECT plant_id, ts_15, count(v_dc_v) FILTER (NOT late) AS n, avg(v_dc_v) FILTER (NOT late) AS m, stddev_pop(v_dc_v) FILTER (NOT late) AS s, count_if(late) AS late_n FROM w GROUP BY 1, 2)
           SELECT plant_id, ts_15, nullif(n, 0) AS n, CASE WHEN n >= 3 THEN s / m END AS gpoa_cv, CASE WHEN n > 0 THEN coalesce(CASE WHEN n >= 3 THEN s / m END <= 0.08, false) END AS stable_sky, late_n FROM a""",
       ["gpoa_cv"], longs=["n", "late_n"])
def stability(t):
    rows = t.telemetry.select("plant_id", F.col("ts_utc").alias("ts_15"), F.col("v_dc_v").alias("g_poa"), "event_id")
    landed, closed = delivered(rows, lambda s: J.sky_stability(s, P), "ts_15")
    steps = F.explode(F.sequence(F.lit(0), F.lit(5)))
    spread = landed.select("plant_id", tg.floor_to("ts_15").alias("bin"), steps.alias("k")).select("plant_id", F.expr("bin + make_interval(0, 0, 0, 0, 0, 15 * k)").alias("ts_15"))
    return J.count_late(spread, closed, ["plant_id", "ts_15"], "n")


@query("i07_stream_fault_sessions",
       f"""WITH o AS (SELECT plant_id, ts_utc, {LATE} AS late FROM samples WHERE event_type = 'error'),
             e AS (SELECT plant_id, ts_utc, sum(CASE WHEN p IS NULL OR ts_utc - p > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY plant_id ORDER BY ts_utc) AS isl FROM (SELECT plant_id, ts_utc, lag(ts_utc) OVER (PARTITION BY plant_id ORDER BY ts_utc) AS p FROM o WHERE NOT late)),
             s AS (SELECT plant_id, count(*) AS n_bins, min(ts_utc) AS ts_start_utc, max(ts_utc) AS ts_end_utc FROM e GROUP BY plant_id, isl HAVING count(*) >= 2),
             l AS (SELECT plant_id, count_if(late) AS late_n FROM o GROUP BY 1)
           SELECT plant_id, n_bins, ts_start_utc, ts_end_utc, late_n FROM l LEFT JOIN s USING (plant_id)""", longs=["n_bins", "late_n"])
def sessions(t):
    rows = t.samples.filter("event_type = 'error'").select("plant_id", F.col("ts_utc").alias("ts_15"), "event_id")
    landed, closed = delivered(rows, lambda s: J.fault_sessions(s, P, cfg=EventConfig(min_bins=1)), "ts_15")
    taken = closed.groupBy(*P).agg(F.sum("n_bins").alias("taken"))
    late = J.count_late(landed.select(*P), taken, P, "taken").drop("taken")
    return late.join(closed.filter(F.col("n_bins") >= EventConfig().min_bins), P, "left")


@query("i08_stream_filter_state",
       f"""WITH RECURSIVE r AS MATERIALIZED (SELECT user_id, event_id, (value - 50) / 50 AS z, event_id % 10 <> 0 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE NOT ({LATE})),
          f(user_id, i, e, up, dn) AS (SELECT DISTINCT user_id, 0::BIGINT, NULL::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM r UNION ALL SELECT r.user_id, r.i, CASE WHEN NOT ok THEN e WHEN e IS NULL THEN z ELSE 0.2::DOUBLE * z + 0.8::DOUBLE * e END,
            CASE WHEN ok THEN greatest(0, up + z - 0.5) ELSE 0 END, CASE WHEN ok THEN greatest(0, dn - z - 0.5) ELSE 0 END FROM f JOIN r ON r.user_id = f.user_id AND r.i = f.i + 1)
          SELECT CAST(r.user_id AS VARCHAR) AS series, event_id AS tie, CASE WHEN ok THEN e END AS ewma_z, CASE WHEN ok THEN greatest(up, dn) END AS cusum_score, false AS late FROM f JOIN r ON r.user_id = f.user_id AND r.i = f.i
          UNION ALL SELECT CAST(user_id AS VARCHAR), event_id, NULL, NULL, true FROM events WHERE {LATE}""", ["ewma_z", "cusum_score"], recursive=True)
def filters(t):
    rows = t.samples.select("user_id", "ts_utc", "event_id", ((F.col("value") - 50) / 50).alias("z"))
    root = f"{checkpoint_ready(t.spark).sparkContext.getCheckpointDir()}/filters-{uuid.uuid4().hex}"
    for part in in_parts(rows):
        part.select(*rows.columns).write.mode("append").parquet(f"{root}/in")
        s = t.spark.readStream.schema(rows.schema).parquet(f"{root}/in")
        X.filter_state(s, root, "user_id", "ts_utc", "z", F.col("event_id") % 10 != 0, "event_id")
    return X.finished(t.spark, root).drop("time")


@query("i09_stream_reprocess", REPLACED, ["p_ac_w"])
def reprocessed(t):
    target, new, _ = [x.withColumn("day", F.to_date("ts_15")) if "ts_15" in x.columns else x for x in replacement(t)]
    root = f"{checkpoint_ready(t.spark).sparkContext.getCheckpointDir()}/reprocessed-{uuid.uuid4().hex}"
    for delivery in (target, new):
        delivery.write.mode("append").parquet(f"{root}/in")
        s = t.spark.readStream.schema(target.schema).parquet(f"{root}/in")
        J.reprocess(s, f"{root}/table", P, "ts_15", ["day"], f"{root}/log").awaitTermination()
    return VersionedTable(t.spark, f"{root}/table", target.schema, ("day",)).read().drop("day")
