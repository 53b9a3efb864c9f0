"""Connected components of links between 64-bit ids, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the ends of ``links`` (a, b); the component is its smallest node.

    In each round every component hooks onto its smallest neighbour and chains are cut
    short by following parents of parents; links inside a component are dropped.  The
    rounds end when no link is left, after a number that grows with the logarithm of the
    longest chain.  No node's links are ever gathered in one place.
    """
    # Hooks only ever point to smaller ids, so they form a forest and jumping ends.
    labels = None
    rest = materialize(links.select("a", "b").where("a <> b").distinct(), "links")
    while not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("to")), "hooks")
        while True:
            up = hooks.select(F.col("a").alias("to"), F.col("to").alias("far"))
            jumped = materialize(hooks.join(up, "to").select("a", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved")), "jumps")
            discard(hooks)
            hooks, moved = jumped.select("a", "to"), not jumped.where("moved").isEmpty()
            hooks.scratch_path = jumped.scratch_path
            if not moved:
                break
        if labels is None:
            grown = hooks.select(F.col("a").alias("node"), F.col("to").alias("component"))
        else:
            known = labels.join(hooks.withColumnRenamed("a", "component"), "component", "left")
            grown = known.select("node", F.coalesce("to", "component").alias("component"))
        grown = materialize(grown, "labels")
        names = hooks.withColumnRenamed("a", "node")
        left = rest.join(names.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(names.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        kept = materialize(left.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
        discard(rest, hooks, *([labels] if labels is not None else []))
        labels, rest = grown, kept
    if labels is None:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
