"""Connected components, and parents resolved through chains, of graphs of any shape."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Write = Callable[[DataFrame], DataFrame]


def components(edges: DataFrame, write: Write, rounds: int = 64) -> DataFrame:
    """(node, component) over undirected ``edges`` (a, b); a component is named by one of its nodes.

    In a round every node joins the node of least random rank among itself and its neighbours, and what has joined
    becomes one node; a path loses a constant share of its nodes in each round, whatever their order along it. Each
    round is written, so a lost executor costs the round at hand.
    """
    rank = lambda c, k: F.struct(F.xxhash64(F.lit(k), c).alias("rank"), F.col(c).alias("node"))
    open_ = write(edges.where("a <> b").select("a", "b").distinct())
    label = None
    for k in range(rounds):
        if open_.isEmpty():
            break
        ends = open_.union(open_.select("b", "a"))
        joined = ends.groupBy("a").agg(F.min(rank("b", k)).alias("m"))
        joined = write(joined.select(F.col("a").alias("node"), F.least("m", rank("a", k))["node"].alias("to")))
        if label is None:
            label = joined.withColumnRenamed("to", "component")
        else:
            label = label.join(joined.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        label = write(label)
        by_a = open_.join(joined.toDF("a", "ta"), "a").select("ta", "b")
        by_b = by_a.join(joined.toDF("b", "tb"), "b").where("ta <> tb")
        open_ = write(by_b.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
    if not open_.isEmpty():
        raise RuntimeError(f"components are still open after {rounds} rounds")
    return label if label is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component")).where("false")


def chain_ends(links: DataFrame, write: Write, rounds: int = 40) -> DataFrame:
    """(source, target, steps) of ``links`` (source, target), one target a source, followed to the end by doubling; a source that leads into a cycle has no row."""
    now = write(links.select("source", "target", F.lit(1).cast("long").alias("steps")))
    ends = write(links.select("target").join(links.select(F.col("source").alias("target")), "target", "left_anti").distinct())
    for _ in range(rounds):
        open_ = now.join(ends, "target", "left_anti")
        if open_.isEmpty():
            break
        step = now.select(F.col("source").alias("target"), F.col("target").alias("next"), F.col("steps").alias("more"))
        far = write(now.join(step, "target", "left").select("source", F.coalesce("next", "target").alias("target"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")))
        reached = far.join(ends, "target", "left_semi")
        if reached.count() == now.join(ends, "target", "left_semi").count():
            break  # who is not at an end by now is on a cycle or leads into one
        now = far
    return now.join(ends, "target", "left_semi").select("source", "target", "steps")
