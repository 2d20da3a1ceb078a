"""Connected components by alternating large and small stars, each round cut by a durable table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footing.llm.common import durable


def _lowest(pairs: DataFrame) -> DataFrame:
    """u, low: the least of u and its neighbours.  Durable, so that a hot u's join can be split."""
    return durable(pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low")), "lowest")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    sides = both if large else both.where("v < u")
    joined = sides.join(_lowest(sides), "u")
    if large:
        out = joined.where("v > u").select(F.col("low").alias("a"), F.col("v").alias("b"))
    else:
        out = joined.select(F.col("low").alias("a"), F.explode(F.array("v", "u")).alias("b"))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label (least node of its component) for all nodes of undirected edges (a, b).

    Loops, repeated and reversed edges do no harm; no edges give no rows.
    """
    pairs = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = durable(pairs, "edges")
    before = None
    while True:
        sums = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if sums == before or not sums[0]:
            break
        before = sums
        pairs = durable(_star(durable(_star(pairs, True), "large"), False), "small")
    leaves = pairs.select(F.col("b").alias("node"), F.col("a").alias("label"))
    return leaves.unionByName(pairs.select(F.col("a").alias("node"), F.col("a").alias("label"))).distinct()
