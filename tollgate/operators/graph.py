"""Distributed union-find on DataFrames: alternating large-star and small-star contraction.

Only DataFrame operations; no adjacency list, label table or edge list reaches the driver. Each
round is two map-side combined ``min`` aggregations, each followed by an equi-join on the node. The
aggregates are written before they are joined, so both sides of the join have exchanges of their own
and a hub node's edges are an ordinary skewed join side that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, gather


def _joined(edges: DataFrame, node: str, least: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges joined on ``node`` with the written ``least`` of (n, m)."""
    held = gather(least, "least")
    return edges.join(held, F.col(node) == F.col("n")), held


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star contraction of ``edges(u, v)``, u < v.

    Large star: every neighbour above a node goes to the least of the node and its neighbours.
    Small star: a node and its neighbours below it go to the least of those neighbours.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    joined, held = _joined(both.where("v > u"), "u", least)
    large = gather(joined.select(F.col("m").alias("u"), "v").where("u < v").distinct(), "large")
    discard(held)
    least = large.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("n"), "m")
    joined, held = _joined(large, "v", least)
    small = joined.select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).where("u < v").distinct()
    small = gather(small, "stars")
    for done in (held, large, edges):
        discard(done)
    return small


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """Connected components of undirected ``links``: rows (node, component), component = least node.

    Only nodes with a link to another node appear. The node columns may be of any orderable type.
    Links holding null and self-links are no links. An empty input gives an empty result.
    Stops when a full round changes nothing, which the star contractions reach in about the
    logarithm of the longest chain. Only the last round's table is left in shared storage.
    """
    edges = links.select(F.least(left, right).alias("u"), F.greatest(left, right).alias("v"), F.col(left).alias("a"), F.col(right).alias("b"))
    edges = gather(edges.where("a is not null and b is not null and u < v").select("u", "v").distinct(), "links")
    mark = None
    while True:
        edges = _round(edges)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
    roots = edges.select(F.col("u").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(roots)
