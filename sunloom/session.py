"""Session settings the operators rely on."""
from __future__ import annotations

import contextlib
import pathlib
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # shuffled bins unpack to ten times their bytes where they are sorted: a task takes at most this much of them, whatever the input
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # the one-diode solver expands every row to 60 voltages: keep Arrow batches small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "8192",
    # whole texts travel in batches too: a few workers with a batch each must fit beside the executor
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package once per application, so that no worker needs it on its path."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        _SHIPPED.add(sc.applicationId)
        root = pathlib.Path(__file__).resolve().parent
        archive = pathlib.Path(tempfile.mkdtemp(prefix="sunloom-code-")) / f"{root.name}.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, path.relative_to(root.parent))
        sc.addPyFile(str(archive))
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Hand out the package and pin the run-time settings (all are per-session, none needs a restart)."""
    ship(spark)
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def checkpoint_ready(spark: SparkSession) -> SparkSession:
    """Use the cluster's shared checkpoint folder; without that setting only a local session gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not shared:
            if not re.match(r"local(\[|$)", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            # one machine runs everything here, so its own folder is shared
            shared = tempfile.mkdtemp(prefix="sunloom-ckpt-")
        sc.setCheckpointDir(shared)
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder: survives lost executors, ends the lineage."""
    checkpoint_ready(df.sparkSession)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def short_methods(spark: SparkSession) -> Iterator[None]:
    """Jobs of long rule chains: a generated method beyond 8,000 bytes of code is never compiled by the JVM but interpreted.

    With this limit Spark runs such a stage operator by operator, whose methods are split and are compiled.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "8000")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame) -> DataFrame:
    """Materialise as Parquet in the shared checkpoint folder.

    Compressed, a reader takes only the columns it needs, and the optimizer knows the size: a small table is broadcast to rows that
    are then not shuffled for it.  Columns without a type are not written and come back as NULL.
    """
    checkpoint_ready(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/rows-{uuid.uuid4().hex}"
    kept = [f for f in df.schema if not isinstance(f.dataType, T.NullType)]
    with short_methods(df.sparkSession):
        df.select(*[F.col(f"`{f.name}`") for f in kept]).write.parquet(path)
    out = df.sparkSession.read.schema(T.StructType(kept)).parquet(path)
    return out.select(*[F.lit(None).alias(f.name) if isinstance(f.dataType, T.NullType) else F.col(f"`{f.name}`") for f in df.schema])
