"""Connected components by contraction, in joins and partial aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from larkspur.llm._shared import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node and root for each end of an edge (a, b); the root is the least node of the component.

    Each round points every node to the least of its neighbours and itself and keeps the
    edges between what they point to, until no edge is left. The graph shrinks by at least
    half in nodes each round, so the rounds grow with the logarithm of the input.
    """
    left = scratch.write(edges.select("a", "b").where("a <> b").distinct(), "edges")
    maps: list[DataFrame] = []
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        near = scratch.write(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to")), "near")
        maps.append(near)
        a, b = near.select(F.col("node").alias("a"), F.col("to").alias("ta")), near.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        rest = left.join(a, "a").join(b, "b").where("ta <> tb").select(F.col("ta").alias("a"), F.col("tb").alias("b")).distinct()
        # A node may point to one that points on, though no edge is between their targets.
        chains = near.join(near.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").where("to <> next").select(F.col("to").alias("a"), F.col("next").alias("b"))
        rest = scratch.write(rest.union(chains).distinct(), "edges")
        scratch.drop(left)
        left = rest
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[0].select("node", F.col("to").alias("root"))
    for later in maps[1:]:
        out = out.join(later.select(F.col("node").alias("root"), F.col("to").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    found = scratch.write(out, "components")
    scratch.drop(*maps, left)
    return found
