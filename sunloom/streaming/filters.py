"""EWMA and CUSUM of endless series, micro-batch by micro-batch, with the block operators of the batch jobs.

A row waits until the watermark has passed it, so rows are taken in order of time however they are spread over batches:
the result does not depend on the cuts.  Between batches only the waiting rows and one row of state per series are kept:

    waiting/<n>/  rows not yet passed       carry/<n>/  state per series
    out/<n>/      finished and late rows    mark/<n>/   watermark; written last, makes batch n count

Every batch writes folders of its own from those of the batch before, so a batch that is run again after a crash
overwrites what the lost run left.  A series with a third of all rows is cut into blocks like any other.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sunloom.config import DetectConfig
from sunloom.functions import values as V
from sunloom.operators import series as S
from sunloom.session import checkpoint_ready

SEED, ROW, EPOCH = "_seed", 3, "_epoch"


def _finished(spark: SparkSession, root: str) -> list[int]:
    """Batches whose watermark is written, ascending."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    place = path(f"{root}/mark")
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return []
    return sorted(n for s in fs.listStatus(place) if fs.exists(path(s.getPath(), "_SUCCESS")) for n in [int(s.getPath().getName())])


def _forget(spark: SparkSession, root: str, batches: Sequence[int]) -> None:
    """Remove waiting rows and states that no batch will read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for n in batches:
        for name in ("waiting", "carry"):
            place = path(f"{root}/{name}/{n}")
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _seeds(carry: DataFrame, k: float) -> DataFrame:
    """Three rows per series that bring the filters to the carried state.

    The first sets the mean and restarts the sums; from nothing, the second (up + down + 3k) and the third (-down - k) lead
    the upper sum to `up` and the lower one to `down`.
    """
    rows = [
        F.struct(F.lit(0).alias(SEED), F.col("ewma").alias("z"), F.col("ewma").isNotNull().alias("ok")),
        F.struct(F.lit(1).alias(SEED), (F.col("up") + F.col("down") + 3 * k).alias("z"), F.lit(True).alias("ok")),
        F.struct(F.lit(2).alias(SEED), (-F.col("down") - k).alias("z"), F.lit(True).alias("ok")),
    ]
    return carry.select("series", F.timestamp_micros("last").alias("time"), F.lit(None).cast("long").alias("tie"), F.inline(F.array(*rows)))


def _epochs(rows: DataFrame, idle_s: int | None) -> DataFrame:
    """`_epoch`: the number of silences longer than `idle_s` in front of a row of this batch."""
    if idle_s is None:
        return rows.withColumn(EPOCH, F.lit(0).cast("long"))
    s = S.Series(("series",), "time", (SEED, "tie"))
    d = S.previous(rows, s, {"_last": "time"})
    silent = F.unix_micros("time") - F.unix_micros("_last") > idle_s * 1_000_000
    return S.without_marks(S.islands(d, s, F.coalesce(silent, F.lit(False)), EPOCH)).drop("_last")


def filter_batch(ready: DataFrame, carry: DataFrame | None, cfg: DetectConfig = DetectConfig(), idle_s: int | None = None) -> DataFrame:
    """`ewma_z`, `cusum_score` and the sums `up`, `down` of rows (series, time, tie, z, ok) that all follow the carried state.

    The rows of the state itself are returned too, with `_seed` below 3.
    """
    rows = ready.select("series", "time", "tie", F.lit(ROW).alias(SEED), "z", "ok")
    if carry is not None:
        rows = rows.unionByName(_seeds(carry, cfg.cusum_k))
    rows = _epochs(rows, idle_s)
    s = S.for_ewma(S.Series(("series", EPOCH), "time", (SEED, "tie")), cfg.ewma_lambda)
    kind, d = F.col(SEED), S.blocks(rows, s)
    d = S.add_filters(d, s, "z", F.col("ok") & kind.isin(0, ROW), lam=cfg.ewma_lambda, ewma="ewma_z")
    d = S.add_filters(d, s, "z", F.col("ok") & (kind != 0), k=cfg.cusum_k, cusum="c")
    return d.drop(S.BLOCK, S.HALO).withColumnsRenamed({"c_score": "cusum_score", "c_pos": "up", "c_neg": "down"})


def filter_state(stream: DataFrame, root: str, key: str, time: str, value: str, eligible: Column, tie: str | None = None,
                 cfg: DetectConfig = DetectConfig(), delay_s: int = 7200, idle_s: int | None = None):
    """Run an available-now stream to its end; `finished` reads what came out under `root`.

    Rows pass when a row `delay_s` later has come.  A row behind the watermark of the batches before its own, or without a
    time, is handed on at once with `late` true and no values, and changes nothing.  A series silent for longer than
    `idle_s` starts anew and its state is dropped; without that figure a state is kept for ever.  Rows with equal time go by `tie`; a null key is a series of its own.
    """
    spark = checkpoint_ready(stream.sparkSession)
    tied = F.col(tie).cast("long") if tie else F.lit(None).cast("long")
    rows = stream.select(F.col(key).cast("string").alias("series"), F.col(time).alias("time"), tied.alias("tie"),
                         F.col(value).cast("double").alias("z"), V.flag(eligible).alias("ok"))

    def write(batch: DataFrame, n: int) -> None:
        done = [d for d in _finished(spark, root) if d < n]
        t = F.unix_micros("time")
        newest = batch.agg(F.max(t)).first()[0]
        if done:
            old = spark.read.parquet(f"{root}/mark/{done[-1]}").first()["mark"]
        else:
            old = -(2**62)
        mark = old if newest is None else max(old, newest - delay_s * 1_000_000)
        behind = F.coalesce(t < old, F.lit(True))
        live = batch.filter(~behind)
        if done:
            live = live.unionByName(spark.read.schema(batch.schema).parquet(f"{root}/waiting/{done[-1]}"))
        live.filter(t >= mark).write.mode("overwrite").parquet(f"{root}/waiting/{n}")
        carry = spark.read.parquet(f"{root}/carry/{done[-1]}") if done else None
        found = filter_batch(live.filter(t < mark), carry, cfg, idle_s).checkpoint(eager=True)
        columns = ["series", "time", "tie", "ewma_z", "cusum_score"]
        none = F.lit(None).cast("double")
        late = batch.filter(behind).select("series", "time", "tie", none.alias("ewma_z"), none.alias("cusum_score"), F.lit(True).alias("late"))
        passed = found.filter(F.col(SEED) == ROW).select(*columns, F.lit(False).alias("late"))
        passed.unionByName(late).write.mode("overwrite").parquet(f"{root}/out/{n}")
        place = F.col(S.POS)
        state = found.groupBy("series", EPOCH).agg(
            F.max(t).alias("last"), F.max_by("ewma_z", F.when(F.col("ewma_z").isNotNull(), place)).alias("ewma"),
            F.max_by("up", place).alias("up"), F.max_by("down", place).alias("down"),
        )
        state = state.groupBy("series").agg(F.max_by(F.struct("last", "ewma", "up", "down"), EPOCH).alias("s")).select("series", "s.*")
        awake = F.lit(True) if idle_s is None else F.col("last") >= mark - idle_s * 1_000_000
        state.filter(awake).write.mode("overwrite").parquet(f"{root}/carry/{n}")
        spark.range(1).select(F.lit(mark).cast("long").alias("mark")).write.mode("overwrite").parquet(f"{root}/mark/{n}")
        _forget(spark, root, done[:-1])

    q = rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start()
    q.awaitTermination()


def finished(spark: SparkSession, root: str) -> DataFrame:
    """Rows of all finished batches: series, time, tie, ewma_z, cusum_score, late."""
    schema = "series string, time timestamp, tie long, ewma_z double, cusum_score double, late boolean"
    places = [f"{root}/out/{n}" for n in _finished(spark, root)]
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)
