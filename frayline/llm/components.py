"""Connected components of a link table, by alternating stars; links never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable, forget


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` for every end of the links ``a, b`` (long); the component is its smallest node.

    Each round hangs the larger neighbours of every node on its smallest one, then the
    smaller ones; rounds grow with the logarithm of the longest path.  A node of very many
    links is only ever counted and joined to one row.
    """
    stars = durable(links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "links")
    before = None
    while True:
        both = stars.unionByName(stars.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        # larger neighbours u of v go to the least node around v
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        # smaller neighbours of v, and v, go to the least of them
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.explode(F.array("u", "v")).alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        spent, stars = stars, durable(small, "links")
        forget(spent)
        state = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "u"))).first()
        if state == before:
            break
        before = state
    ends = stars.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return ends.unionByName(stars.select(F.col("u").alias("node"), F.col("u").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
