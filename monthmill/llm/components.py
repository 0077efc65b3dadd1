"""Connected components of links between integer nodes, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

MAX_ROUNDS = 60


#: Parts that a node's links are dealt to, so that no task gets all links of one.
SALTS = 16


def _with_lowest(links: DataFrame, lowest: DataFrame) -> DataFrame:
    """``links`` (u, v) with the lowest node ``m`` of u."""
    spread = lowest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return links.withColumn("salt", F.pmod(F.hash("v"), F.lit(SALTS))).join(spread, ["u", "salt"]).drop("salt")


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, component): every linked node with the smallest node it reaches.

    Each round hangs a node's larger neighbours on its smallest one, then its smaller
    neighbours; links only ever become fewer or lead to smaller nodes, and a fixed point
    is a star around each component's smallest node.  A node's links are salted and its
    minimum is combined before the exchange, so one with very many links is no hot key.
    Rounds grow with the logarithm of the longest path.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    links = stage(links, "links")
    before = None
    for _ in range(MAX_ROUNDS):
        both = links.union(links.select("v", "u"))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _with_lowest(both.filter("v > u"), lowest).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        large = stage(large, "links", drop=[links])
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_lowest(large, lowest).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = stage(small.union(lowest.select("u", "m")).distinct(), "links", drop=[large])
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = links.select("v").distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("v", "v"))
