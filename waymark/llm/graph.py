"""Connected components of large graphs by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node of ``edges`` (src, dst: bigint).

    Self loops and repeated edges are allowed; no edges give no rows.  The minimum over a node's
    neighbours is pre-aggregated before each exchange, and written out, so that the joins that look it
    up are of plain tables, where adaptive execution deals the rows of a node with very many neighbours
    to several tasks.  The rows exchanged per step never exceed twice the edges.  Each step is written
    out, so a lost executor costs one step.
    """
    named = edges.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"))
    nodes = materialize(named.select(F.col("src").alias("node")).union(named.select("dst")).distinct(), "cc-nodes")
    pairs = materialize(named.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "cc-edges")
    total, state = pairs.count(), None
    while total:
        both = pairs.union(pairs.select("v", "u"))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "cc-least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct(), "cc-large")
        small_least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        small = large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_least.select("u", F.col("m").alias("v")))
        step = materialize(small.where("u <> v").distinct(), "cc-edges")
        discard(pairs, least, large, small_least)
        pairs = step
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        total, state = now[0], now
    # In the fixed point every node points to the least of its component.
    found = pairs.groupBy("u").agg(F.min("v").alias("root"))
    return nodes.join(found.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
