"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalmill.llm.scratch import discard, written


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root for every node of ``links`` (a, b): root is the smallest node reachable.

    Alternating large-star and small-star steps. Each round is a minimum per node and a join, and is
    written to the shared folder; nothing but a count and a checksum reaches the driver. Self links
    and repeated links are ignored; no links give no rows.
    """
    spark = links.sparkSession
    links, path = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    for _ in range(max_rounds):
        # Large star: neighbours larger than a node go to the smallest of its neighbourhood.
        both = links.union(links.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: neighbours smaller than a node, and the node, go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        links, new = written(small.select("x.u", "x.v").where("u <> v").distinct(), "links")
        discard(spark, path)
        path = new
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select("v", "v").distinct())
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
