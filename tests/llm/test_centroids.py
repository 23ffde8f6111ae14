"""Integer clustering against a plain Python version; the query against its SQL twin runs with all other twins."""
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators_small import rows

from sunloom.llm.centroids import LARGEST, Bisectors, ClusterConfig, clustered

VECTORS = "vec_id long, embedding array<float>, cluster string, v int"


def plain(vectors, config):
    kept = []
    for i, v in vectors:
        if v is not None and len(v) == config.dimensions and all(x is not None and math.isfinite(x) for x in v):
            ints = [math.floor(config.scale * float(np.float32(x))) for x in v]
            if max(map(abs, ints)) <= LARGEST:
                kept.append((i, ints))
    name = lambda i: "g" if i is None else hashlib.sha256(f"{config.draw}{i}".encode()).hexdigest()
    cents = [v for _, v in sorted((name(i), v) for i, v in kept)[: config.clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(cents))

    for _ in range(config.rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        for k, vs in members.items():
            cents[k] = [sum(col) // len(vs) for col in zip(*vs, strict=True)]
    last = [(i, *nearest(v)) for i, v in kept]
    inertia = {}
    for _, d, k in last:
        inertia[k] = inertia.get(k, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i is None, i or 0), k, d, inertia[k], sum(inertia.values()), digest[k]) for i, d, k in last)


def result(df):
    return sorted(((r["vec_id"] is None, r["vec_id"] or 0), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in rows(df))


def test_tournament_equals_all_distances():
    rng = np.random.default_rng(4)
    for span, width in ((3, 2), (300, 64), (LARGEST, 64)):
        c = rng.integers(-span, span + 1, (17, width))
        c[9] = c[2]  # equal centroids: the smaller number has to win
        x = np.concatenate([rng.integers(-span, span + 1, (200, width)), c, (c[0:1] + c[1:2]) // 2])
        best, distance = Bisectors(c).nearest(x)
        exact = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, w, strict=True)), k) for k, w in enumerate(c)) for v in x]
        assert list(zip(distance.tolist(), best.tolist(), strict=True)) == exact
    # x = 0 lies on the plane between -1 and 1
    assert Bisectors([[1], [-1]]).nearest(np.array([[0]]))[0].tolist() == [0]


@pytest.mark.parametrize("config", [ClusterConfig(dimensions=3, clusters=5, rounds=4), ClusterConfig(dimensions=3, clusters=40, rounds=2), ClusterConfig(dimensions=3, clusters=1, rounds=1)])
def test_clusters_equal_a_plain_version(spark, config):
    rng = random.Random(6)
    vectors = [(k, [rng.choice([-1.0, -0.3, 0.0, 0.001, 0.5]) for _ in range(3)]) for k in range(30)]
    # repeated rows, an id with two vectors, no id, ties, and what is not kept
    vectors += [(3, vectors[3][1]), (3, [9.0, 9.0, 9.0]), (None, [0.1, 0.1, 0.1]), (50, [-0.0, 0.0, -1e-30])]
    vectors += [(60, None), (61, []), (62, [1.0, 2.0]), (63, [1.0, 2.0, 3.0, 4.0]), (64, [1.0, None, 3.0]), (65, [1.0, float("nan"), 3.0]), (66, [1.0, float("inf"), 3.0]), (67, [1.0, 3e38, 3.0])]
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in vectors], VECTORS).repartition(5)
    assert result(clustered(df, config)) == plain(vectors, config)


def test_no_vectors(spark):
    nothing = spark.createDataFrame([(1, None, "x", 1), (2, [1.0], "x", 1)], VECTORS)
    for df in (nothing, nothing.limit(0)):
        out = clustered(df)
        assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and out.count() == 0


def test_query_equals_a_plain_version(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    df = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding"))
    want = plain([(r["vec_id"], r["embedding"]) for r in df.collect()], ClusterConfig(rounds=5))
    assert result(entry.queries()["op12_centroid_clusters"](spark, sf)) == want
