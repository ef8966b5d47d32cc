"""Connected components of an undirected graph given as a table of edges.

Alternates minimum-label exchange along edges with pointer jumping, each round cut by a
written table, until no label changes.  All of it is joins and grouped minima; no edge,
label or component reaches the driver but the count of changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every end of an edge; component is the smallest id reachable."""
    links = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    links = written(links.union(links.select("y", "x")).distinct(), "links")
    # Smaller neighbour, or oneself: a forest to start with.
    labels = links.groupBy(F.col("x").alias("id")).agg(F.min("y").alias("low")).select("id", F.least("id", "low").alias("component"))
    labels = written(labels, "labels")
    while True:
        of_y = labels.select(F.col("id").alias("y"), F.col("component").alias("other"))
        offered = links.join(of_y, "y").groupBy(F.col("x").alias("id")).agg(F.min("other").alias("offer"))
        best = labels.join(offered, "id").select("id", F.col("component").alias("old"), F.least("component", "offer").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("root"))
        best = best.join(jump, "component", "left").select("id", "old", F.least("component", F.coalesce("root", "component")).alias("component"))
        best = written(best, "labels")
        discard(labels)
        if best.where("old <> component").isEmpty():
            discard(links)
            return best.select("id", "component")
        labels = best
