"""Connected components of a graph given by its edges, as a series of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import remove, stored


def components(edges):
    """(node, component) for every node of edges (a, b), both long: the least node it can reach.

    Each node points to its least neighbour or itself; pointers are doubled until they reach a
    root; then edges are drawn between roots, until none is left. Both loops take a number of
    steps logarithmic in the graph, each a join or an aggregation with a written result; nothing
    but counts reaches the driver.
    """
    a, b = F.col("a"), F.col("b")
    live = stored(edges.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
    named = None
    while not live.isEmpty():
        both = live.select("a", "b").union(live.select(b.alias("a"), a.alias("b")))
        up = stored(both.groupBy(a.alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root")))
        while True:
            over = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
            jumped = stored(up.join(over, "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")))
            moved = not jumped.where("moved").isEmpty()
            remove(up)
            up = jumped
            if not moved:
                break
        roots = lambda c: up.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        further = live.join(roots("a"), "a").join(roots("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).where(a != b)
        live = stored(further.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), cut=[live])
        if named is None:
            named = up.select("node", F.col("root").alias("component"))
        else:
            later = up.select(F.col("node").alias("component"), "root")
            named = named.join(later, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    if named is None:
        return live.select(a.alias("node"), b.alias("component"))
    return named
