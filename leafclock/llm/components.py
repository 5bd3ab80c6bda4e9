"""Connected components of a graph given by its links, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafclock.sources.scratch import staged


def _print(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b) but the roots: the smallest node reachable.

    Alternates large-star (a node hands its smallest neighbour to its larger ones) and
    small-star (to its smaller ones) until nothing changes, in O(log n) rounds or so. Only
    minima are taken of a node's neighbours, so a node with very many links is no burden.
    Every round is written and read back, and so are the minima, so that the join with a
    hot node's links can broadcast them or split that node.
    """
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges = staged(links.where("a <> b").select(u, v).distinct(), "links")
    before = _print(edges)
    while before[0]:
        both = edges.union(edges.select("v", "u"))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large, "large-star")
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(small.union(least).distinct(), "small-star")
        after = _print(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
