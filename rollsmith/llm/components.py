"""Connected components of a graph given as a table of links, by alternating stars.

Every round points each node at the smallest node it knows, first from the larger
neighbours, then from the smaller ones, until nothing moves. A round is two
aggregations and two equality joins; each round's links are written to the shared
folder, so lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollsmith.llm.common import materialize, release


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node that a link (columns ``a, b``) touches, where
    ``label`` is the smallest node reachable. Self links and repeated links are allowed."""
    edges = materialize(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _mark(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(low, both["a"] == low["k"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = materialize(large)
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        small = large.join(low, large["a"] == low["k"]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        after = materialize(small.union(low.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct())
        release(large)
        release(edges)
        edges, mark = after, _mark(after)
        if mark == before:
            break
        before = mark
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b"), F.col("b"))).groupBy("node").agg(F.min("label").alias("label"))
