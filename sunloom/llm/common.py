"""What the training-data operators share: input columns, scratch tables, word cutting."""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sunloom.session import checkpoint_ready

#: fixed values: the white space that ends a word (space, tab, line feed, vertical tab, form feed, carriage return)
BLANKS = " \t\n\x0b\f\r"
#: the same as a Java regular expression
BLANK_RUN = "[ \\t\\n\\x0B\\f\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ids_and_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so that any others cannot clash; a null text is empty."""
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder."""
    checkpoint_ready(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: ends the lineage, and the size of the files is then known to the optimizer."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than the blanks, in order."""
    return F.array_remove(F.split(text, BLANK_RUN), "")


def give_back() -> None:
    """Hand freed memory back to the system: a worker process outlives its task and may idle beside others."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library, with other habits


def lean(work: Callable):
    """The function of a task, with `give_back` after it: of an iterator once that is read to its end, else at once."""

    def run(rows):
        found = work(rows)
        if not isinstance(found, Iterator):
            give_back()
            return found
        return _read(found)

    def _read(found: Iterator) -> Iterator:
        try:
            yield from found
        finally:
            found.close()
            give_back()

    return run


def batches_of(batches: Iterable[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the strings or bytes of one column stay near `limit`; one longer value stays whole."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
