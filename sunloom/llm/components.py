"""Connected components of a link table by alternating large-star and small-star steps."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunloom.llm.common import written


def _toward_least(links: DataFrame) -> DataFrame:
    """Every link (u, v) with `least`: the smallest neighbour of u. The minima are written first, so that both sides of the
    join are plain shuffles and a node with very many links can be split."""
    least = written(links.groupBy("u").agg(F.min("v").alias("least")), "least-neighbours")
    return links.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (u, v), both long and not null: root is the smallest node it is connected with.

    Each round replaces links by links to smaller nodes, which keeps components and ends in stars around their smallest
    nodes after about log² rounds; every step is an aggregation and a join, nothing is collected but a count and a checksum.
    """
    now = written(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if state == before or state[0] == 0:
            break
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: the larger neighbours of a node go to the smallest node around it, itself included
        large = _toward_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v")).distinct()
        # small star: the smaller neighbours of a node, and the node, go to the smallest of them
        small = _toward_least(large)
        moved = small.select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u <> v").unionByName(small.select("u", F.col("least").alias("v")))
        now = written(moved.distinct(), "links")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
