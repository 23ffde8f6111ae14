"""Exact duplicates: a persistent index of text digests, bucketed and sorted, that new data is anti-joined with and appended to."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunloom.llm.common import ids_and_text, scratch_path, written


def stored_buckets(spark: SparkSession, path: str) -> int | None:
    """The bucket number that is kept beside an index; None if there is no index yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}-buckets")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    return int(spark.read.text(f"{path}-buckets").first()[0])


class DigestIndex:
    """A table (digest, keep_id) with one row per distinct text ever seen, stored in buckets that are sorted by digest.

    `add` finds the texts of a batch that the index does not hold by a sort-merge anti-join, whose index side is neither
    shuffled nor gathered, and appends them. Within a batch the row with the largest id stands for its text; across
    batches the earlier batch wins. The table outlives the session at `path`; opening the path again continues it, with
    the bucket number it was made with, whatever is asked for then.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        known = stored_buckets(spark, path)
        if known is None:
            spark.range(1).select(F.lit(str(buckets)).alias("value")).write.mode("overwrite").text(f"{path}-buckets")
        self.spark, self.path, self.buckets = spark, path, known or buckets
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, signed: DataFrame) -> None:
        """Append the digests of `signed` (doc_id, digest) that are new. Safe to repeat: a second run finds nothing new."""
        # written: otherwise the optimizer moves the anti-join below the aggregation, and all copies of a text meet in one task
        batch = written(signed.groupBy("digest").agg(F.max("doc_id").alias("keep_id")), "batch-digests")
        fresh = batch.hint("merge").join(self.rows(), "digest", "left_anti")
        # the new rows are settled before the table they were compared with is written to
        fresh = written(fresh, "fresh-digests")
        fresh.repartition(self.buckets, "digest").write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.name)


def sign(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of the UTF-8 text as 32 bytes; a null text counts as empty."""
    rows = ids_and_text(docs, key, text)
    return rows.select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))


def exact_duplicates(docs: DataFrame, index: DigestIndex | None = None, key: str = "doc_id", text: str = "text", buckets: int | None = None, arrivals: int = 2) -> DataFrame:
    """Verdict on every row: (doc_id, keep_id, group_size, kept, text_sha256); equal texts share keep_id.

    Texts are equal when identical; null counts as empty. The row with the largest doc_id stays (a null id is the smallest).
    Rows that repeat both id and text stay once. With `index`, texts it already holds keep the row it holds, and the rest is
    appended to it; without, an index is made for this call. The rows arrive in `arrivals` batches by falling doc_id, so that
    the largest id of a text is always the first one seen. An empty table gives an empty result.

    Only digests are shuffled, never texts. A text with very many copies costs one partial sum per task, and the joins that
    carry its verdict back to its rows are plain shuffles that adaptive execution splits.
    """
    spark = docs.sparkSession
    signed = written(sign(docs, key, text).groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("copies")), "signed")
    if index is None:
        index = DigestIndex(spark, scratch_path(spark, "digest-index"), buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
    low, high = signed.agg(F.min("doc_id"), F.max("doc_id")).first()
    span = 0 if low is None else high - low + 1
    cuts = [low + span * k // arrivals for k in range(arrivals)] if span else []
    for k in reversed(range(len(cuts))):
        rows = F.col("doc_id") >= cuts[k]
        if k + 1 < len(cuts):
            rows &= F.col("doc_id") < cuts[k + 1]
        if k == 0:
            rows |= F.col("doc_id").isNull()
        index.add(signed.filter(rows))
    if not cuts:
        index.add(signed)
    sizes = signed.groupBy("digest").agg(F.sum("copies").alias("group_size"))
    groups = written(sizes.join(index.rows(), "digest"), "digest-groups")
    rows = signed.join(groups, "digest")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    # rows with the same id and text come back as often as they were there, the first of them kept
    return rows.select("doc_id", "keep_id", "group_size", stays.alias("stays"), F.lower(F.hex("digest")).alias("text_sha256"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select(
        "doc_id", "keep_id", "group_size", (F.col("stays") & (F.col("copy") == 1)).alias("kept"), "text_sha256"
    )


def drop_exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without the rows that `exact_duplicates` drops, all columns kept.

    Rows are found again by id and digest. Only where a row repeats both are rows themselves compared by a shuffle: any one
    of them stays. Without such rows no row is gathered with another.
    """
    # a row without id goes by the number below all ids
    known = lambda c: F.coalesce(c.cast("long"), F.lit(-(2**63)))
    verdict = exact_duplicates(docs, key=key, text=text)
    pairs = verdict.groupBy(known(F.col("doc_id")).alias("id"), F.unhex("text_sha256").alias("digest"))
    kept = written(pairs.agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("copies")).filter("kept"), "kept-digests")
    digest = F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"), 256))
    here = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), known(F.col(f"`{key}`")).alias("id"), digest.alias("digest"))
    repeats = kept.filter("copies > 1").select("id", "digest")
    if repeats.isEmpty():
        out = here.join(kept.select("id", "digest"), ["id", "digest"], "left_semi")
    else:
        single = here.join(kept.filter("copies = 1").select("id", "digest"), ["id", "digest"], "left_semi")
        out = single.unionByName(here.join(repeats, ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"]))
    return out.select("row.*")
