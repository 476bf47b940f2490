"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import discard, settle


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (columns a and b, long): component is the smallest id
    that links reach. Ids of empty, self and null links aren't returned.

    Each step writes its edges to the shared folder, so that plans stay short and a lost executor
    costs one step. A node's smallest neighbour is aggregated before the join, whose sides come
    from tables: the join of a node with very many links can be split at run time."""
    at = settle(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(),
        "edges",
    )
    while True:
        both = at.select(F.col("lo").alias("node"), F.least("hi", "lo").alias("low")).union(at.select(F.col("hi").alias("node"), "lo"))
        lowest = settle(both.groupBy("node").agg(F.min("low").alias("low")), "lowest")
        large = settle(at.join(lowest, F.col("lo") == F.col("node")).select("hi", F.col("low").alias("lo")).distinct(), "large")
        parent = settle(large.groupBy("hi").agg(F.min("lo").alias("low")), "parent")
        linked = large.alias("e").join(parent.alias("p"), F.col("e.hi") == F.col("p.hi")).select(F.col("e.lo").alias("hi"), F.col("p.low").alias("lo")).where("hi <> lo")
        after = settle(linked.union(parent.select("hi", F.col("low").alias("lo"))).distinct(), "edges")
        for old in (at, lowest, large, parent):
            discard(old)
        at = after
        if stars(at):
            break
    roots = at.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct()
    return at.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(roots)


def stars(edges: DataFrame) -> bool:
    """Whether every hi has one lo, and no lo is a hi: then further steps change nothing."""
    counts = edges.agg(F.count("*").alias("n"), F.count_distinct("hi").alias("nodes")).first()
    chained = edges.select(F.col("lo").alias("node")).distinct().join(edges.select(F.col("hi").alias("node")), "node", "left_semi")
    return counts.n == counts.nodes and chained.isEmpty()
