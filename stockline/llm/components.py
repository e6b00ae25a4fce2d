"""Connected components of a distributed edge list, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockline.operators.scale import checkpointed


def few(df: DataFrame, ratio: int = 16) -> DataFrame:
    """df in a fixed part of the session's shuffle partitions: for lists much shorter than the input, which grow with it."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.coalesce(1 + parts // ratio)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each end of an edge (a, b); component is the smallest node of its component.

    Each round links every larger neighbour of a node to the node's smallest neighbour, then every smaller neighbour
    likewise, and is written to the checkpoint folder; rounds grow with the logarithm of the longest path. The two
    sums per round aggregate before their shuffle, so a hub with many edges is no hot group. Every step of a round comes
    back to few partitions, since each shuffle leaves a file per partition that it reads.
    Edges with a null end or of a node to itself link nothing.
    """
    ordered = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    links = checkpointed(few(ordered.filter("u <> v").distinct()))
    seen = _fingerprint(links)
    while seen[0]:
        both = links.union(links.select("v", "u"))
        low = few(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low")))
        large = links.select(F.col("v").alias("u"), F.col("u").alias("v")).join(low, "u")
        large = few(few(large.select(F.col("v").alias("u"), F.col("low").alias("v"))).distinct())
        least = few(large.groupBy("u").agg(F.min("v").alias("low")))
        small = few(large.join(least, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")))
        links = checkpointed(few(small.union(least.select("u", "low")).distinct()))
        now = _fingerprint(links)
        if now == seen:
            break
        seen = now
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def joined_components(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """(node, component) under earlier edges, given by their labels, and further edges (a, b)."""
    if labels is None:
        return components(edges)
    of_a = labels.toDF("a", "_component_a")
    of_b = labels.toDF("b", "_component_b")
    between = few(few(few(edges).join(of_a, "a", "left")).join(of_b, "b", "left"))
    tops = components(between.select(F.coalesce("_component_a", "a").alias("a"), F.coalesce("_component_b", "b").alias("b")))
    tops = few(tops)
    moved = few(labels.join(tops.toDF("component", "_top"), "component", "left"))
    moved = moved.select("node", F.coalesce("_top", "component").alias("component"))
    return moved.union(tops).groupBy("node").agg(F.min("component").alias("component"))


def _fingerprint(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
