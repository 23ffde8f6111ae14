"""Row-level merges and the table sinks built on them."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sunloom.functions import timegrid as tg
from sunloom.operators import keys as K
from sunloom.session import checkpoint_ready


def merge_rows(target: DataFrame, updates: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Upsert: new keys are added, known keys get the listed columns (default: all) from the update."""
    names = target.columns
    listed = [c for c in (columns or names) if c not in keys]
    mark = F.lit(True)
    u = updates.select(*keys, F.struct(*[c for c in names if c not in keys]).alias("_u"), mark.alias("_new"))
    t = target.select(*keys, F.struct(*[c for c in names if c not in keys]).alias("_t"), mark.alias("_old"))
    j = t.join(u, list(keys), "full")
    pick = {
        c: (F.when(F.col("_new"), F.col(f"_u.{c}")).otherwise(F.col(f"_t.{c}")) if c in listed
            else F.when(F.col("_old"), F.col(f"_t.{c}")).otherwise(F.col(f"_u.{c}")))
        for c in names if c not in keys
    }
    return j.select(*keys, *[e.alias(c) for c, e in pick.items()]).select(*names)


def split_upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Label every update row `insert` or `update`."""
    known = target.select(*keys).distinct().withColumn("_known", F.lit(True))
    return updates.join(known, list(keys), "left").withColumn(
        "action", F.when(F.col("_known"), "update").otherwise("insert")
    ).drop("_known")


def replace_range(target: DataFrame, new: DataFrame, ranges: DataFrame, keys: Sequence[str], time: str, end_time: str | None = None) -> DataFrame:
    """Delete rows of the listed series inside their range, then add the new ones.

    With `end_time` the rows are intervals and every overlapping one goes.
    """
    r = ranges.select(*keys, F.col("range_start").alias("_lo"), F.col("range_end").alias("_hi"))
    start = F.col(time)
    end = F.col(end_time) if end_time else start
    hit = target.join(r, list(keys), "left")
    keep = F.col("_lo").isNull() | ~((start < F.col("_hi")) & (end >= F.col("_lo")))
    return hit.filter(keep).drop("_lo", "_hi").unionByName(new.select(*target.columns))


def drop_plain_totals(target: DataFrame, written: DataFrame, keys: Sequence[str], time: str, source: str = "source_oper") -> DataFrame:
    """Tracker rows replace the plain total of their root source over the written range."""
    span = (
        written.filter(K.is_mppt(source)).groupBy(*keys, K.root(source).alias(source))
        .agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    )
    j = target.join(span, [*keys, source], "left")
    return j.filter(F.col("_lo").isNull() | ~F.col(time).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def insert_only(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows whose key is not stored yet, first one per key."""
    return K.first_row_per_key(incoming, keys, order).join(existing.select(*keys), list(keys), "left_anti")


def start_days(requests: DataFrame, stored: DataFrame, keys: Sequence[str], safety_days: int = 1, time: str = "ts_utc") -> DataFrame:
    """First day to fetch: last stored day minus the safety margin, unless that day lies beyond the request."""
    last = stored.groupBy(*keys).agg(F.to_date(F.max(time)).alias("last_day"))
    out = requests.join(last, list(keys), "left")
    use = F.col("last_day").isNotNull() & (F.col("last_day") <= F.col("end_day"))
    return out.withColumns(
        {
            "effective_start": F.when(use, F.greatest("start_day", F.date_sub("last_day", safety_days))).otherwise(F.col("start_day")),
            "reason": F.when(F.col("last_day").isNull(), "user_range").when(use, "incremental_from_last").otherwise("backfill_preserved_start"),
        }
    )


def days_to_fetch(requests: DataFrame, stored: DataFrame, keys: Sequence[str], tz: str = "tz", time: str = "ts_utc") -> DataFrame:
    """Requested local days without any stored row."""
    days = requests.withColumn("day", F.explode(F.sequence("start_day", "end_day"))).select(*keys, tz, "day")
    have = stored.join(requests.select(*keys, tz), list(keys)).select(*keys, tg.local_day(time, F.col(tz)).alias("day")).distinct()
    return days.join(have, [*keys, "day"], "left_anti")


def ingest_state(results: DataFrame, keys: Sequence[str], attempt: str | None = None) -> DataFrame:
    """Latest outcome per series: last good day, status, the whole error text.

    Of several results for a day the last `attempt` counts; without that column an error counts before a success.
    """
    ok = F.col("error").isNull()
    last = F.struct("day", F.col(attempt) if attempt else F.lit(0), F.coalesce("error", F.lit("")))
    return results.groupBy(*keys).agg(
        F.max(F.when(ok, F.col("day"))).alias("last_ok_day"),
        F.max_by(F.when(ok, "ok").otherwise("error"), last).alias("status"),
        F.coalesce(F.max_by(F.coalesce("error", F.lit("")), last), F.lit("")).alias("error"),
    )


def write_partitions(df: DataFrame, path: str, partitions: Sequence[str]) -> None:
    """Overwrite only the partitions present in `df`."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path))


def _stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame | None:
    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _latest_updates(updates: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One update per key: the last one by `order`, then by its values."""
    rest = [c for c in updates.columns if c not in keys]
    if not rest:
        return updates.distinct()
    rank = F.struct(*order, F.xxhash64(*rest), *[F.col(c).cast("string") for c in rest])
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_u")).select(*keys, "_u.*").select(*updates.columns)


def upsert_table(updates: DataFrame, path: str, keys: Sequence[str], partitions: Sequence[str], columns: Sequence[str] | None = None,
                 order: Sequence[str] = ()) -> dict[str, int]:
    """Merge into a partitioned Parquet table, rewriting only touched partitions; returns both counts.

    A key that is updated several times takes its last update by `order`.  Where the partition is no part of the key,
    a key whose partition changes leaves its old one.  The merged rows are checkpointed before the overwrite, because
    they are read from the same folder.
    """
    spark = checkpoint_ready(updates.sparkSession)
    updates = _latest_updates(updates, keys, order).checkpoint(eager=True)
    seen = Observation()
    target = _stored(spark, path, updates)
    if target is None:
        counted = updates.observe(seen, F.count(F.lit(1)).alias("insert"))
        write_partitions(counted, path, partitions)
        return {"insert": int(seen.get["insert"]), "update": 0}
    places = updates.select(*partitions)
    if not set(partitions) <= set(keys):
        places = places.union(target.join(updates.select(*keys), list(keys), "left_semi").select(*partitions))
    touched = target.join(places.distinct(), list(partitions), "left_semi")
    before = touched.select(*partitions).distinct().checkpoint(eager=True)
    labelled = split_upsert(touched, updates, keys).observe(
        seen, F.count_if(F.col("action") == "insert").alias("insert"), F.count_if(F.col("action") == "update").alias("update")
    )
    merged = merge_rows(touched, labelled.drop("action"), keys, columns).checkpoint(eager=True)
    write_partitions(merged, path, partitions)
    _drop_partitions(before.join(merged.select(*partitions).distinct(), list(partitions), "left_anti"), path, partitions)
    return {k: int(v) for k, v in seen.get.items()}


def _drop_partitions(gone: DataFrame, path: str, partitions: Sequence[str]) -> None:
    """Remove the folders of partitions without rows left, through the file system that Spark itself uses for the path."""
    spark = gone.sparkSession
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    for row in gone.select(*[F.col(c).cast("string").alias(c) for c in partitions]).toLocalIterator():
        fs.delete(jvm.org.apache.hadoop.fs.Path(root, "/".join(escape(c, row[c]) for c in partitions)), True)


def replace_range_table(new: DataFrame, ranges: DataFrame, path: str, keys: Sequence[str], time: str, partitions: Sequence[str],
                        end_time: str | None = None) -> None:
    """Rewrite the partitions the range touches; those that end up empty go."""
    spark = checkpoint_ready(new.sparkSession)
    target = _stored(spark, path, new)
    if target is None:
        write_partitions(new, path, partitions)
        return
    parts = list(partitions)
    r = ranges.select(*keys, F.col("range_start").alias("_lo"), F.col("range_end").alias("_hi"))
    end = F.col(end_time or time)
    hit = target.join(r, list(keys)).filter((F.col(time) < F.col("_hi")) & (end >= F.col("_lo")))
    touched = hit.select(*parts).union(new.select(*parts)).distinct()
    before = touched.checkpoint(eager=True)
    rows = replace_range(target.join(before, parts, "left_semi"), new, ranges, keys, time, end_time).checkpoint(eager=True)
    write_partitions(rows, path, partitions)
    _drop_partitions(before.join(rows.select(*parts).distinct(), parts, "left_anti"), path, partitions)


def append_provenance(spark: SparkSession, path: str, record: dict[str, object]) -> None:
    """One audit row per import: endpoints, first and last chunk parameters, row count."""
    one = spark.range(1).select(*[F.lit(v).alias(k) for k, v in record.items()], F.current_timestamp().alias("created_at"))
    one.write.mode("append").parquet(path)


def date_chunks(ranges: DataFrame, interval_min: int, start: str = "start_day", end: str = "end_day") -> DataFrame:
    """Request chunks: 31 days at 15 minutes, 370 days at 60 minutes; both ends inclusive."""
    step = 31 if interval_min == 15 else 370
    starts = F.sequence(F.col(start), F.col(end), F.expr(f"INTERVAL {step} DAYS"))
    return ranges.withColumn("chunk_start", F.explode(starts)).withColumn(
        "chunk_end", F.least(F.date_add("chunk_start", step - 1), F.col(end))
    )


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
