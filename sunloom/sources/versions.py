"""Partitioned tables whose replacements are staged as a whole and take effect by one rename.

    data/version=<id>/<partitions>/…    rows; a version is written once and never changed
    commits/<n>/                        one row per live partition: the version that holds it

Readers take the commit with the greatest number.  A writer that is lost between staging and commit leaves a version
that no commit names: the table still reads as before and the repeated write starts over.  A batch name that some
commit carries is not applied again, so a replayed micro-batch changes nothing.

One writer at a time: a second one on the same commit is told so, as far as the file system's rename can tell.
"""
from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sunloom.session import checkpoint_ready
from sunloom.sources import tables as TB

VERSION, BATCH = "version", "__batch"


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str], how: str) -> DataFrame:
    """Semi or anti join where null equals null."""
    r = right.select(*[F.col(c).alias(f"__right_{c}") for c in columns])
    return left.join(r, [F.col(c).eqNullSafe(F.col(f"__right_{c}")) for c in columns], how)


@dataclass(frozen=True)
class VersionedTable:
    """`schema` is the one of the rows, partition columns included; these are strings, dates, or numbers."""

    spark: SparkSession
    path: str
    schema: T.StructType
    partitions: tuple[str, ...]

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path, path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def commits(self) -> list[int]:
        """Numbers of the commits, ascending."""
        path, fs = self._fs()
        place = path(f"{self.path}/commits")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(place)) if fs.exists(place) else []

    def _pointers(self, n: int) -> DataFrame:
        fields = [f for f in self.schema.fields if f.name in self.partitions]
        names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        return self.spark.read.schema(f"{names}, {VERSION} string, {BATCH} string").parquet(f"{self.path}/commits/{n}")

    def read(self) -> DataFrame:
        """The rows of the last commit; without one, no rows."""
        done = self.commits()
        if not done:
            return self.spark.createDataFrame([], self.schema)
        live = self._pointers(done[-1]).filter(F.col(VERSION).isNotNull())
        # the pointers are the pruning side of the join: only folders that they name are scanned
        return _same(self._data(), live, (*self.partitions, VERSION), "left_semi").select(*self.schema.names)

    def _data(self) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField(VERSION, T.StringType())])
        return self.spark.read.schema(schema).parquet(f"{self.path}/data")

    def applied(self, batch: str) -> bool:
        """Whether some commit carries this batch name: every commit hands on the names of those before it."""
        done = self.commits()
        return bool(done) and not self._pointers(done[-1]).filter(F.col(BATCH) == batch).isEmpty()

    def stage(self, rows: DataFrame) -> str:
        """Write the rows beside the table and return their version; nothing refers to it yet."""
        version = uuid.uuid4().hex
        place = f"{self.path}/data/{VERSION}={version}"
        rows.select(*self.schema.names).write.partitionBy(*self.partitions).parquet(place)
        return version

    def commit(self, version: str, touched: DataFrame, present: DataFrame, batch: str | None = None, base: int | None = None) -> int:
        """Point the touched partitions to the version, those without rows in it to nothing; returns the commit's number.

        `base` is the commit that the rows were made from (default: the last): when another writer was faster, the new
        number is taken already and the write has to be made again on top of the newer table.
        """
        done = self.commits()
        base = base if base is not None else (done[-1] if done else 0)
        parts = list(self.partitions)
        new = present.select(*parts).distinct().withColumns({VERSION: F.lit(version), BATCH: F.lit(None).cast("string")})
        if base:
            old = self._pointers(base)
            t = touched.select(*parts).unionByName(present.select(*parts)).distinct()
            kept = _same(old.filter(F.col(VERSION).isNotNull()), t, parts, "left_anti")
            new = new.unionByName(kept).unionByName(old.filter(F.col(BATCH).isNotNull()))
        if batch is not None:
            mark = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields if f.name in parts]
            new = new.unionByName(self.spark.range(1).select(*mark, F.lit(None).cast("string").alias(VERSION), F.lit(batch).alias(BATCH)))
        path, fs = self._fs()
        place = f"{self.path}/pending/{uuid.uuid4().hex}"
        new.write.parquet(place)
        fs.mkdirs(path(f"{self.path}/commits"))
        target = path(f"{self.path}/commits/{base + 1}")
        if fs.exists(target) or not fs.rename(path(place), target):
            raise FileExistsError(f"{self.path}: commit {base + 1} was taken by another writer")
        return base + 1

    def replace(self, new: DataFrame, ranges: DataFrame, keys: Sequence[str], time: str, end_time: str | None = None, batch: str | None = None) -> int | None:
        """Replace the rows of the listed series inside their range; returns the commit, or None for a batch applied before.

        Only partitions that lose or gain rows are written.  Rows and partitions may be null; without rows in `new` the
        ranges are emptied; two equal rows stay two.
        """
        checkpoint_ready(self.spark)
        if batch is not None and self.applied(batch):
            return None
        done = self.commits()
        base = done[-1] if done else 0
        target, parts = self.read(), list(self.partitions)
        r = ranges.select(*keys, F.col("range_start").alias("_lo"), F.col("range_end").alias("_hi"))
        hit = target.join(r, list(keys)).filter((F.col(time) < F.col("_hi")) & (F.col(end_time or time) >= F.col("_lo")))
        touched = hit.select(*parts).unionByName(new.select(*parts)).distinct().checkpoint(eager=True)
        inside = _same(target, touched, parts, "left_semi")
        version = self.stage(TB.replace_range(inside, new, ranges, keys, time, end_time))
        return self.commit(version, touched, self._data().filter(F.col(VERSION) == version), batch, base)
