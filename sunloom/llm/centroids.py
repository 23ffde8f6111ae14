"""Centroid clustering in integers: a vector's nearest centroid is the one that no bisecting plane to another one eliminates."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunloom.llm.common import written

#: components beyond this are refused: below it every plane test and squared distance is exact in 64 bits
LARGEST = 1 << 27


@dataclass(frozen=True)
class ClusterConfig:
    dimensions: int = 64
    #: also the bound on what a task holds: clusters² × dimensions integers
    clusters: int = 40
    rounds: int = 5
    #: real components are multiplied by this and rounded down
    scale: int = 256
    #: goes before the id in the hash that draws the first centroids
    draw: str = "2:"


def integer_vectors(vectors: DataFrame, config: ClusterConfig = ClusterConfig(), key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, v): kept vectors as little-endian 32-bit integers, one binary value each.

    Kept are vectors of the right length without null, NaN or infinite components and without one beyond ±2^27 after scaling,
    whose squared distances need not fit 64 bits. Repeated rows and null ids are vectors like others.
    """
    import numpy as np

    width, scale = config.dimensions, config.scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # nulls become NaN, which no finite test lets through
            x = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, width)
            x = np.floor(x * scale)
            fine = (np.isfinite(x) & (np.abs(x) <= LARGEST)).all(axis=1)
            raw = np.ascontiguousarray(x[fine].astype("<i4")).tobytes()
            values = [raw[i : i + 4 * width] for i in range(0, len(raw), 4 * width)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(fine)), pa.array(values, pa.binary())], ["vec_id", "v"])

    # null lists and those of other lengths do not leave the JVM
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{column}`").alias("v"))
    return rows.filter(F.size("v") == width).mapInArrow(run, "vec_id long, v binary")


def matrix(column: pa.Array, width: int):
    """Rows of 64-bit integers from binary values of 32-bit ones."""
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i4").reshape(-1, width).astype(np.int64)


class Bisectors:
    """For centroids a < b: a vector x is nearer to b if x · normal[a, b] exceeds threshold[a, b], and else a keeps it.

    |x-a|² - |x-b|² = x · 2(b-a) - (|b|² - |a|²), so one product of integers settles a pair, and zero is a tie.
    """

    def __init__(self, centroids):
        import numpy as np

        self.centroids = c = np.asarray(centroids, dtype=np.int64)
        squares = (c * c).sum(axis=1)
        self.normals = 2 * (c[None, :, :] - c[:, None, :])
        self.thresholds = squares[None, :] - squares[:, None]

    def nearest(self, x):
        """(number of the nearest centroid, squared distance) of each row: k-1 tests, the winner so far against the next."""
        import numpy as np

        best = np.zeros(len(x), dtype=np.int64)
        for other in range(1, len(self.centroids)):
            side = np.einsum("ij,ij->i", x, self.normals[best, other]) - self.thresholds[best, other]
            # the winner so far has the smaller number: a tie leaves it in place
            best[side > 0] = other
        away = x - self.centroids[best]
        return best, np.einsum("ij,ij->i", away, away)


def first_centroids(vectors: DataFrame, config: ClusterConfig) -> list[list[int]]:
    """The vectors with the smallest hashes of their ids, ascending; equal hashes by components, a null id last."""
    import numpy as np

    named = vectors.select(F.sha2(F.concat(F.lit(config.draw), F.col("vec_id").cast("string")).cast("binary"), 256).alias("h"), "v")
    drawn = named.orderBy(F.asc_nulls_last("h"), "v").limit(config.clusters).collect()  # bounded: one row per cluster
    decoded = [(r["h"] or "g", np.frombuffer(r["v"], dtype="<i4").tolist()) for r in drawn]
    return [v for _, v in sorted(decoded)]


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Every non-empty centroid becomes the exact floor of its vectors' mean.

    A task sends one row of sums per cluster it met, so what is shuffled and collected depends on clusters and tasks only.
    """
    import numpy as np

    width = len(centroids[0])
    sums = [f"s{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = Bisectors(centroids)
        count, total = np.zeros(len(centroids), dtype=np.int64), np.zeros((len(centroids), width), dtype=np.int64)
        for batch in batches:
            x = matrix(batch.column(0), width)
            cluster, _ = planes.nearest(x)
            count += np.bincount(cluster, minlength=len(centroids))
            order = np.argsort(cluster, kind="stable")
            met, starts = np.unique(cluster[order], return_index=True)
            if len(met):
                total[met] += np.add.reduceat(x[order], starts, axis=0)
        met = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(count[met]), *(pa.array(total[met, i]) for i in range(width))], ["cluster", "n", *sums])

    partial = vectors.select("v").mapInArrow(run, ", ".join(f"{c} long" for c in ["cluster", "n", *sums]))
    # decimals: sums over many tasks may leave 64 bits
    exact = partial.groupBy("cluster").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ["n", *sums]])
    out = [list(c) for c in centroids]
    for r in exact.collect():  # bounded: one row per cluster
        out[r["cluster"]] = [int(r[c]) // int(r["n"]) for c in sums]
    return out


def assigned(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance) of every integer vector."""
    width = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = Bisectors(centroids)
        for batch in batches:
            cluster, distance = planes.nearest(matrix(batch.column(1), width))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster).cast(pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, cluster int, distance long")


def clustered(vectors: DataFrame, config: ClusterConfig = ClusterConfig(), key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """One row per kept vector: (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256).

    Lloyd's rounds in integers: the first centroids are drawn by hash, vectors go to the nearest centroid (ties: smaller
    number), non-empty centroids move to the floor of the mean, and after the last round vectors are assigned once more.
    With fewer kept vectors than clusters every one begins a cluster. Equal vectors always share a cluster. A table
    without a kept vector, or an empty one, gives no rows; other columns are not read.

    Vectors are written once as integers and read in every round; no vector is shuffled.
    """
    spark = vectors.sparkSession
    kept = written(integer_vectors(vectors, config, key, column), "integer-vectors")
    centroids = first_centroids(kept, config)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(config.rounds):
        centroids = moved(kept, centroids)
    rows = written(assigned(kept, centroids), "assigned")
    # bounded: one row per cluster
    inertia = {r["cluster"]: r["d"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    whole = sum(inertia.values())
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(k, d, whole, digest[k]) for k, d in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
