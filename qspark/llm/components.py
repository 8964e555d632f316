"""Connected components by alternating large-star and small-star, each round a written table.

Defined cases: a link with a null end, or of a node with itself, is no link; repeated links count once; no links give no rows. Only u
and v are read. A hub's neighbours meet in a join on the hub, which AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _links(e: DataFrame) -> DataFrame:
    return e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")


def _large(e: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest of its neighbours and itself."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) → node, component (its smallest node) for all nodes with an edge to another. Stars at the end: each node once."""
    e = stage(_links(edges).distinct(), "links")
    mark = None
    while True:
        # a forest of stars whose centres have no smaller neighbour stays as it is
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == tuple(now):
            break
        mark = tuple(now)
        e = stage(_small(_large(e)), "stars")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
