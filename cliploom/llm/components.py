"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node of ``edges(a, b)``; the root is the smallest node of its component.

    Large-star hangs the larger neighbours of each node on its smallest one, small-star does so
    with the smaller ones; both keep connectivity, and the rounds end when every edge leads to a
    root.  Each round is stored, so nothing but two numbers reaches the driver.
    """
    current = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    before, number = None, 0
    while True:
        mark = tuple(current.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).head())
        if mark == before or mark[0] == 0:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before, number = mark, number + 1
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least_neighbour(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        hung = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        current = stored(hung.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-{number}")
