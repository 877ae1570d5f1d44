"""Connected components of links by alternating stars; every step is joins and sums over tables on the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.store import stored


def _state(edges: DataFrame) -> tuple:
    """Number and order-free checksum of the edges."""
    words = F.xxhash64("a", "b")
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.shiftrightunsigned(words, 32)).alias("high"),
        F.sum(words.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"),
    ).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links(a, b)``; the component is its smallest node.

    Each round first points every larger neighbour of a node to the least node around it, then does the same among the
    smaller neighbours. It ends when no edge changes; then all nodes point to the least node of their component.
    Self-links and repeated links do no harm. No links give an empty table.
    """
    spark = links.sparkSession
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(spark, "components", edges)
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(spark, "components", large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(spark, "components", moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
