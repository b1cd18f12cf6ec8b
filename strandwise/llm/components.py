"""Connected components by alternating large-star and small-star rounds.

Each round points the neighbours of a node at the smallest of them, so paths
shorten geometrically. Every step is an aggregation with map-side combine and a
join, on links only; nothing reaches the driver but two counts a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: node, other (node > other). Each node's neighbours go to their smallest."""
    if large:
        around = links.unionByName(links.select(F.col("other").alias("node"), F.col("node").alias("other")))
    else:
        around = links
    # stored first: the join then deals both sides itself, and Spark can split a node that most links name
    least = cut(around.groupBy("node").agg(F.min("other").alias("low")).withColumn("low", F.least("low", "node")), free=False)
    moved = around.join(least, "node")
    if large:
        out = moved.where("other > node").select(F.col("other").alias("node"), F.col("low").alias("other"))
    else:
        out = moved.where("other <> low").select(F.col("other").alias("node"), F.col("low").alias("other"))
        out = out.unionByName(least.select("node", F.col("low").alias("other")))
    return out.where("node > other").distinct()


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """node, component (smallest node reachable) for every node with a link but the smallest.

    links: two long columns ``a`` and ``b``, no nulls. Rounds are logarithmic in
    the longest path; reaching ``rounds`` raises rather than returning part.
    """
    now = cut(links.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other")).distinct())
    seen = None
    for _ in range(rounds):
        now = cut(_star(cut(_star(now, True), free=False), False))
        sign = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node", "other")).alias("x")).first()
        if tuple(sign) == seen or not sign["n"]:
            return now.select("node", F.col("other").alias("component"))
        seen = tuple(sign)
    raise RuntimeError("components: no fixed point")
