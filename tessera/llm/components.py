"""Connected components of a table of links, by contraction; no links reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import drop, scratch, stash


def components(links: DataFrame) -> DataFrame:
    """node and component, its least node, for each node of links (columns a and b, longs).

    Round by round every node goes to the neighbour that comes first, if that is before
    itself, and links between nodes that went different ways form the next, smaller
    graph. Nodes are ordered by number, which takes stars in one or two rounds, and in
    every third round by a hash, which shortens chains of ascending numbers. A node
    with very many links is a group of a partial minimum, and one side of a join that
    Spark may split.
    """
    spark = links.sparkSession
    with scratch(spark) as kept:
        out, at = stash(_contracted(links))
        kept.append(at)
    return out


def _contracted(links: DataFrame) -> DataFrame:
    spark = links.sparkSession
    edges, edges_at = stash(links.select("a", "b").where("a <> b").distinct())
    whole, whole_at, turn = None, None, 0
    while not edges.isEmpty():
        key = F.xxhash64("v", F.lit(turn)) if turn % 3 == 2 else F.col("v")
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).union(edges.select("a", "a")).union(edges.select("b", "b"))
        step, step_at = stash(both.groupBy("u").agg(F.min(F.struct(key.alias("k"), "v"))["v"].alias("to")))
        moved = edges.join(step.select(F.col("u").alias("a"), F.col("to").alias("a2")), "a").join(step.select(F.col("u").alias("b"), F.col("to").alias("b2")), "b")
        next_edges, next_at = stash(moved.where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
        if whole is None:
            whole, whole_at = step.toDF("node", "root"), step_at
        else:
            later, later_at = stash(whole.join(step.toDF("root", "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
            drop(spark, whole_at, step_at)
            whole, whole_at = later, later_at
        drop(spark, edges_at)
        edges, edges_at, turn = next_edges, next_at, turn + 1
    if whole is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component")).where(F.lit(False))
    least = whole.groupBy("root").agg(F.min("node").alias("component"))
    return whole.join(least, "root").select("node", "component")
