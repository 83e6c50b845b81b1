"""Connected components of a table of links, by alternating stars.

Large-star joins every larger neighbour of a node to its least neighbour,
small-star every smaller one, until each node hangs on the least node of its
component. Rows never outnumber twice the links, a hot node's neighbours are
aggregated before the shuffle, and each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Stored


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a long, b long); the component is its least node.

    Self-links, repeated links and both directions are allowed; no links, no rows.
    """
    edges = links.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).filter("lo < hi").distinct()
    now, before = Stored(edges, "stars"), None
    while (state := _state(now.read())) != before:
        old, e = now, now.read()
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(lowest, "hi").filter("lo > m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
        now = Stored(small.unionByName(lowest.select(F.col("m").alias("lo"), "hi")).distinct(), "stars")
        old.drop()
        before = state
    stars = now.read()
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(stars.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("lo", "hi"))).first())
