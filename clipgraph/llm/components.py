"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipgraph.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of (src, dst) links: the smallest node it reaches.

    Alternating star contraction: a node hands its larger neighbours to the smallest node it
    knows, then its smaller ones, until every link points at a root. Each round is a few
    aggregations over links, written to the shared checkpoint folder; no round gathers a node's
    neighbours in one place, and neither links nor components reach the driver.
    """
    edges = stored(
        links.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    last = _mark(edges)
    while True:
        # large star: every larger neighbour of a node links to the node's smallest neighbour
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every smaller neighbour of a node, and the node, link to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = stored(small.select("e.u", "e.v").filter("u <> v").distinct())
        mark, edges = _mark(after), after
        if mark == last:
            below = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
            return below.union(edges.select("v", "v").distinct())
        last = mark


def _mark(edges: DataFrame) -> tuple:
    """Count and checksum, to see whether a round changed anything."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
