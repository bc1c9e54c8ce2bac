"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge, component being the smallest node of it.

    Each round, nodes point to their smallest neighbour, pointers are followed once more, and edges are
    drawn between what their ends point to; loops and repeats go. A chain shrinks by more than half in
    a round. What nodes pointed to in each round is composed in the end. A hub costs no more than its
    edges: minima are combined before they are dealt out, and skewed joins can be split.
    """
    flat = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    rest = cut(flat.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps: list[DataFrame] = []
    for _ in range(most_rounds):
        if rest.isEmpty():
            break
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("to"))
        again = to.select(F.col("node").alias("to"), F.col("to").alias("then"))
        step = cut(to.join(again, "to").select("node", F.col("then").alias("to")))
        steps.append(step)
        left, right = step.select(F.col("node").alias("a"), F.col("to").alias("x")), step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = rest.join(left, "a").join(right, "b").where("x <> y")
        rest = cut(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    else:
        raise RuntimeError("components did not settle")
    if not steps:
        return flat.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    out = steps[0].select("node", F.col("to").alias("component"))
    for step in steps[1:]:
        out = out.join(step.select(F.col("node").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return out
