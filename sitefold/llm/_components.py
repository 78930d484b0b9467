"""Connected components by iterated minimum labels with pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """links: (a, b) longs, in any order, repeated or not. Returns (node, component): for every node of a link the
    smallest node that is reachable. Each round every node takes the smallest label among its neighbours, then the smallest that any
    node of its label took, or the label's own label; so whole groups move at once, long chains in any order too. Rounds end when no
    label changes, however many that takes: then all labels of linked nodes are equal."""
    both = links.where("a is not null and b is not null and a <> b")
    # both directions come from one evaluation of the links: evaluated twice, a step whose rows arrive in another order could give
    # other links of the same group, and edges that lead one way only
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("way")
    edges = materialize(both.select(ways).select("way.a", "way.b").distinct(), "edges")
    labels = materialize(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "node"), "labels")
    changed = True
    while changed:
        near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        least = labels.join(near, labels.node == near.a).select("node", F.col("component").alias("was"), F.least("component", "near").alias("c"))
        moves = least.select("was", "c").union(least.select("node", "c")).groupBy("was").agg(F.min("c").alias("further"))
        jump = least.join(moves, "was").select("node", "was", F.least("c", "further").alias("c"))
        further = labels.select(F.col("node").alias("c"), F.col("component").alias("further"))
        new = materialize(jump.join(further, "c", "left").select("node", F.least("c", "further").alias("component"), "was"), "labels")
        changed = not new.where("component <> was").isEmpty()
        discard(labels)
        labels = new
    discard(edges)
    return labels.select("node", "component")


def linked_groups(similar: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """The smallest row that each of ``n`` rows is linked with, directly or not, from batches of linked pairs of rows."""
    least = np.arange(n)
    for i, j in similar:
        while True:
            while not np.array_equal(least, jumped := least[least]):
                least = jumped
            one, two = least[i], least[j]
            apart = one != two
            if not apart.any():
                break
            i, j, one, two = i[apart], j[apart], one[apart], two[apart]
            np.minimum.at(least, np.maximum(one, two), np.minimum(one, two))
    return least
