"""Connected components of a graph given as an edge table, by alternating large and small stars.

Each round hangs the larger neighbours of a node, then the smaller ones, under the least node it
knows; the number of rounds grows with the logarithm of the longest chain.  Each round is written to
the shared folder.  Nothing but two numbers for each round comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: (u, v) long, in any direction, loops and repeats allowed -> (node, root), root the least node.

    Nodes without an edge to another node do not appear.
    """
    cur = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    cur = materialize(cur, "components")
    before = None
    while (now := _state(cur)) != before:
        before = now
        if now[0] == 0:
            break
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        cur = materialize(small.select("u", F.col("m").alias("v")).unionByName(moved).distinct(), "components")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
