"""Connected components by contraction: every round hooks each node to its smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize

#: Pointer jumps in a round; each doubles the distance that a node moves towards its smallest neighbour's.
JUMPS = 2


def connected_components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """(node, root) for all nodes of edges (a, b): root is the smallest node that is reachable.

    Nulls, loops and repeated edges are allowed; loops make no node of their own, edges with a null
    link nothing. An empty input gives an empty result. Each round contracts the graph by
    node -> smallest neighbour (then neighbour's neighbour, JUMPS times), so every node that is not
    yet smallest among its neighbours disappears and the edges at least halve their nodes; a star or
    clique needs one round, a path a logarithmic number. Tables are written in the shared folder, so
    no lineage grows and no links reach the driver. Minima are partial before their shuffle; hubs
    only make a side of a sort-merge join hot, which AQE splits.
    """
    links = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(F.col("a") < F.col("b"))
    links = materialize(links.distinct(), "links")
    labels = None
    for _ in range(most_rounds):
        if links.isEmpty():
            break
        both = links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y")))
        parent = materialize(both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("p")), "parents")
        for _ in range(JUMPS):
            up = parent.select(F.col("x").alias("p"), F.col("p").alias("q"))
            parent = parent.join(up, "p", "left").select("x", F.coalesce("q", "p").alias("p"))
        parent = materialize(parent, "jumped")
        if labels is None:
            labels = parent.select(F.col("x").alias("node"), F.col("p").alias("root"))
        else:
            labels = labels.join(parent.select(F.col("x").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        labels = materialize(labels, "labels")
        pa = parent.select(F.col("x").alias("a"), F.col("p").alias("pa"))
        pb = parent.select(F.col("x").alias("b"), F.col("p").alias("pb"))
        moved = links.join(pa, "a").join(pb, "b").where(F.col("pa") != F.col("pb"))
        links = materialize(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links")
    else:
        raise RuntimeError(f"not contracted after {most_rounds} rounds")
    if labels is None:
        kind = links.schema["a"].dataType
        return links.select(F.col("a").alias("node"), F.col("b").cast(kind).alias("root"))
    return labels
