"""Connected components of a distributed edge list, by hooking to the smallest neighbour, pointer doubling and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize

JUMPS = 3


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each end of the edges (a, b) can reach.

    A round hooks every node of the contracted graph to its smallest neighbour if that is smaller, shortens the chains of
    hooks, and contracts the edges; a round at least halves every path. Tables of each round are written to the shared
    folder, so a lost executor costs one stage. Joins on hot labels are plain joins of two tables, which Spark can split.
    """
    live = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    labels = None
    while not live.isEmpty():
        both = live.select(F.col("b").alias("node"), F.col("a").alias("up")).unionAll(live.select(F.col("a").alias("node"), F.col("a").alias("up")))
        hooks = materialize(both.groupBy("node").agg(F.min("up").alias("up")), "hooks")
        for _ in range(JUMPS):
            above = hooks.select(F.col("node").alias("up"), F.col("up").alias("over"))
            jumped = materialize(hooks.join(above, "up").select("node", F.col("over").alias("up")), "hooks")
            drop(hooks)
            hooks = jumped
        if labels is None:
            labels = materialize(hooks.select("node", F.col("up").alias("label")), "labels")
        else:
            to = hooks.select(F.col("node").alias("label"), F.col("up").alias("root"))
            moved = materialize(labels.join(to, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")
            drop(labels)
            labels = moved
        ends = live.join(hooks.select(F.col("node").alias("a"), F.col("up").alias("ra")), "a").join(hooks.select(F.col("node").alias("b"), F.col("up").alias("rb")), "b")
        fewer = materialize(ends.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a <> b").distinct(), "edges")
        drop(live)
        drop(hooks)
        live = fewer
    drop(live)
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("label")).limit(0)
    return labels


def contract(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) after more links (a, b); labels may lack nodes, whose label is their own. Works on the labels' graph, which is smaller."""
    mine = labels.select("node", F.col("label").alias("to"))
    a = links.join(mine.withColumnRenamed("node", "a"), "a", "left").select(F.coalesce("to", "a").alias("a"), "b")
    ends = a.join(mine.withColumnRenamed("node", "b"), "b", "left").select("a", F.coalesce("to", "b").alias("b"))
    moved = components(ends)
    old = labels.join(moved.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    fresh = moved.join(labels.select("node"), "node", "left_anti")
    return materialize(old.unionByName(fresh), "labels")
