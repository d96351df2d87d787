"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected(links: DataFrame, scratch: Scratch, name: str = "components", a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: for every node of a link, the smallest node it reaches.

    Each round joins every node's links to its smallest neighbour, so rows never exceed the
    links; a node with very many links is a skewed join key, which Spark splits. Nothing but a
    count and a checksum comes to the driver. No links give no rows.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    edges = scratch.keep(links.select(high.alias("u"), low.alias("v")).where("u > v").distinct(), f"{name}0")
    seen, step = None, 0
    while True:
        step += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = scratch.keep(small.where("u > v").distinct(), f"{name}{step}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)))).first()
        if step > 1:
            scratch.drop(f"{name}{step - 1}")
        if tuple(now) == seen or not now[0]:
            break
        seen = tuple(now)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
