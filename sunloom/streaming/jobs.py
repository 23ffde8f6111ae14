"""Streaming twins: deduplication, buckets, stability, sessions and reprocessing; the filters are in `filters`."""
from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunloom.config import BucketConfig, DetectConfig, EventConfig
from sunloom.functions import values as V
from sunloom.operators.bins import BIN, mean_columns
from sunloom.session import checkpoint_ready
from sunloom.sources import tables as TB
from sunloom.sources.versions import VersionedTable

LATE = "2 hours"


def drop_repeats(stream: DataFrame, keys: Sequence[str], time: str = "ts_utc", delay: str = LATE) -> DataFrame:
    """First row per key within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([*keys, time])


def bucket_power(stream: DataFrame, keys: Sequence[str], cfg: BucketConfig = BucketConfig(), time: str = "ts_utc", delay: str = LATE) -> DataFrame:
    """Quarter-hours with coverage; rows later than the watermark are dropped and counted by the query metrics."""
    means = [F.avg(c).alias(c) for c in mean_columns(stream, cfg)]
    energy = F.sum(F.col("p_ac_w") * (cfg.sampling_minutes / 60.0)).alias("e_ac_wh_15")
    g = stream.withWatermark(time, delay).groupBy(*keys, F.window(time, "15 minutes").alias("w")).agg(*means, energy, F.count(F.lit(1)).alias("inv_n"))
    g = g.select(*keys, F.col("w.start").alias(BIN), *[c for c in g.columns if c not in (*keys, "w")])
    g = g.withColumn("inv_coverage", F.least(F.col("inv_n") / cfg.expected, F.lit(1.0)))
    return g.withColumn("flag_low_coverage", F.col("inv_coverage") < cfg.coverage_threshold)


def sky_stability(stream: DataFrame, keys: Sequence[str], g: str = "g_poa", time: str = BIN, cfg: DetectConfig = DetectConfig(), delay: str = LATE) -> DataFrame:
    """CV of the last window (6 bins) ending at each bin, as sliding event-time windows."""
    span = f"{cfg.window * 15} minutes"
    w = stream.withWatermark(time, delay).groupBy(*keys, F.window(time, span, "15 minutes").alias("w"))
    a = w.agg(F.count(g).alias("n"), F.avg(g).alias("mean"), F.stddev_pop(g).alias("std"))
    enough = (F.col("n") >= max(3, cfg.window // 2)) & (F.abs("mean") >= 1e-9)
    cv = F.when(enough, F.col("std") / F.abs("mean"))
    last = F.timestamp_seconds(F.unix_seconds("w.end") - 900)
    return a.select(*keys, last.alias(time), "n", cv.alias("gpoa_cv"), V.flag(cv <= cfg.max_cv).alias("stable_sky"))


def fault_sessions(stream: DataFrame, keys: Sequence[str], time: str = BIN, cfg: EventConfig = EventConfig(), delay: str = LATE) -> DataFrame:
    """Anomalous bins joined while the gap stays within bin · (gap_bins + 1)."""
    gap = f"{cfg.bin_minutes * (cfg.gap_bins + 1)} minutes"
    s = stream.withWatermark(time, delay).groupBy(*keys, F.session_window(time, gap).alias("w"))
    a = s.agg(F.count(F.lit(1)).alias("n_bins"), F.min(time).alias("ts_start_utc"), F.max(time).alias("ts_end_utc"))
    return a.filter(F.col("n_bins") >= cfg.min_bins).drop("w")


def reprocess(stream: DataFrame, path: str, keys: Sequence[str], time: str, partitions: Sequence[str], checkpoint: str):
    """Each micro-batch replaces its own time range of every series it touches; a replayed batch changes nothing.

    The result is a versioned table: read it with `VersionedTable(...).read()`.  Batches are named after the checkpoint,
    so a stream that starts over with a new one applies its batches again.
    """
    table = VersionedTable(stream.sparkSession, path, stream.schema, tuple(partitions))

    def write(batch: DataFrame, n: int) -> None:
        ranges = batch.groupBy(*keys).agg(F.min(time).alias("range_start"), F.timestamp_micros(F.unix_micros(F.max(time)) + 1).alias("range_end"))
        table.replace(batch, ranges, keys, time, batch=f"{checkpoint}#{n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def record_state(keys: Sequence[str], path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer keeping the ingest state table up to date."""

    def write(batch: DataFrame, _: int) -> None:
        state = TB.ingest_state(batch, keys).withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(16))).checkpoint(eager=True)
        TB.upsert_table(state.filter("last_ok_day is not null"), path, keys, ["part"])
        # without a good day in the batch the stored one stays
        TB.upsert_table(state.filter("last_ok_day is null"), path, keys, ["part"], columns=["status", "error"])

    return write


def closing_row(rows: DataFrame, time: str, after: str = "7 days") -> DataFrame:
    """One row without any value but a time this far after the last one: it moves the watermark past all that came before.

    Its own bucket stays open, so an append stream of groups never returns it.  An empty table has no last time: no row.
    """
    end = rows.agg((F.max(time) + F.expr(f"INTERVAL {after}")).alias(time)).filter(F.col(time).isNotNull())
    return end.select(*[F.col(f.name) if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields])


def run_deliveries(parts: Sequence[DataFrame], job: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(all delivered rows, what the append stream `job` returned) after the parts were landed one after the other.

    Every delivery is an available-now run that goes on from the checkpoint of the one before, with its state and its
    watermark; the file sink commits a batch as a whole, so a run that is repeated after a crash adds nothing twice.
    """
    spark: SparkSession = checkpoint_ready(parts[0].sparkSession)
    root = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    schema = parts[0].schema
    for part in parts:
        part.select(*schema.names).write.mode("append").parquet(f"{root}/in")
        out = job(spark.readStream.schema(schema).parquet(f"{root}/in"))
        sink = out.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/log")
        sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{root}/in"), spark.read.schema(out.schema).parquet(f"{root}/rows")


def count_late(landed: DataFrame, closed: DataFrame, keys: Sequence[str], seen: str, late: str = "late_n") -> DataFrame:
    """The closed groups with the number of landed rows that came too late for them.

    `landed` has one row per delivered row and group, `closed` the number of rows that the stream took (`seen`).  A group
    whose rows all came late is returned too, with no other values; null keys meet null keys.
    """
    there = landed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__landed")).select(*[F.col(k).alias(f"__{k}") for k in keys], "__landed")
    same = [F.col(f"__{k}").eqNullSafe(closed[k]) for k in keys]
    j = there.join(closed, on=same, how="left")
    rest = [c for c in closed.columns if c not in keys]
    return j.select(*[F.col(f"__{k}").alias(k) for k in keys], *rest, (F.col("__landed") - F.coalesce(seen, F.lit(0))).alias(late))


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run an available-now stream to its end into a table in the shared checkpoint folder and read it."""
    spark: SparkSession = checkpoint_ready(stream.sparkSession)
    root = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    save = "append" if mode == "append" else "overwrite"

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode(save).parquet(f"{root}/rows")

    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")
