"""Graph operators over edge tables: degrees, components, strongly connected components, reachability."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iteration by a reliable checkpoint in the session's folder."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sparkgauge-"))
    return df.checkpoint()


def degrees(edges: DataFrame) -> DataFrame:
    """Distinct in- and out-neighbours of every node of (src, dst)."""
    e = edges.select("src", "dst").distinct()
    out = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("fan_out"))
    into = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("fan_in"))
    return out.join(into, "node", "full_outer").na.fill(0, ["fan_out", "fan_in"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable, edges taken both ways; labels spread and jump until stable."""
    both = _cut(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    labels = _cut(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("low")).select("node", F.least("node", "low").alias("component")))
    while True:
        offer = both.join(labels.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("offer"))
        near = labels.join(offer, "node").select("node", F.col("component").alias("old"), F.least("component", "offer").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("root"))
        near = _cut(near.join(jump, "component", "left").select("node", "old", F.least("component", F.coalesce("root", "component")).alias("component")))
        if near.where("old <> component").isEmpty():
            return near.select("node", "component")
        labels = near.select("node", "component")


def _spread(edges: DataFrame, colour: DataFrame) -> DataFrame:
    """Largest colour that reaches each node along the edges."""
    while True:
        offer = edges.join(colour.withColumnRenamed("node", "src").hint("merge"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("offer"))
        new = _cut(colour.join(offer.hint("merge"), "node", "left").select("node", F.col("colour").alias("old"), F.greatest("colour", F.coalesce("offer", "colour")).alias("colour")))
        if new.where("old <> colour").isEmpty():
            return new.select("node", "colour")
        colour = new.select("node", "colour")


def _peeled(edges: DataFrame) -> DataFrame:
    """Edges without those of nodes that nothing enters or leaves, again and again: what is left lies on or between cycles."""
    size = edges.count()
    while size:
        sources, targets = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        edges = _cut(edges.join(sources.hint("merge"), "src", "left_semi").join(targets.hint("merge"), "dst", "left_semi").select("src", "dst"))
        before, size = size, edges.count()
        if size == before:
            break
    return edges


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) by forward colouring and backward search, round by round.

    Nodes that nothing enters or leaves are components of their own and are peeled off first.  Each round
    colours the rest with the largest node that reaches them; a colour's owner and the nodes of its
    colour that reach back to it are one component and leave the graph.  Joins of a round are merged,
    never broadcast, so no table of nodes passes through the driver.
    """
    e = _cut(edges.select("src", "dst").distinct())
    every = _cut(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct())
    done, e = None, _peeled(e.where("src <> dst"))
    while not e.isEmpty():
        nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
        colour = _spread(e, nodes.select("node", F.col("node").alias("colour")))
        c_src, c_dst = colour.select(F.col("node").alias("src"), F.col("colour").alias("cs")), colour.select(F.col("node").alias("dst"), F.col("colour").alias("cd"))
        inside = _cut(e.join(c_src.hint("merge"), "src").join(c_dst.hint("merge"), "dst").where("cs = cd").select("src", "dst"))
        found = colour.where("node = colour").select("node", F.col("colour").alias("component"))
        size = found.count()
        while True:  # backward from the owners within their colour
            more = inside.join(found.select(F.col("node").alias("dst"), "component").hint("merge"), "dst").select(F.col("src").alias("node"), "component")
            found = _cut(found.union(more).distinct())
            before, size = size, found.count()
            if size == before:
                break
        done = _cut(found if done is None else done.union(found))
        gone = lambda name: found.select(F.col("node").alias(name)).hint("merge")
        e = _peeled(_cut(e.join(gone("src"), "src", "left_anti").join(gone("dst"), "dst", "left_anti").select("src", "dst")))
    alone = every if done is None else every.join(done.select("node").hint("merge"), "node", "left_anti")
    alone = alone.select("node", F.col("node").alias("component"))
    return alone if done is None else alone.union(done)


def cyclic_sizes(edges: DataFrame) -> DataFrame:
    """Sizes of components that hold a cycle: two or more nodes, or a self loop; others have size 0."""
    edges = _cut(edges.select("src", "dst").distinct())  # read twice
    comp = strong_components(edges)
    loops = edges.where("src = dst").select(F.col("src").alias("node")).distinct().withColumn("loop", F.lit(True))
    sizes = comp.groupBy("component").agg(F.count("*").alias("n"))
    cyclic = F.when((F.col("n") > 1) | F.coalesce("loop", F.lit(False)), F.col("n")).otherwise(0)
    return comp.join(sizes, "component").join(loops, "node", "left").select("node", "component", cyclic.alias("cyclic_size"))


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(head, node): all nodes that each start node reaches, itself included; frontier by frontier."""
    e = _cut(edges.select("src", "dst").distinct())
    seen = _cut(start.select(F.col("node").alias("head"), "node").distinct())
    front = seen
    while not front.isEmpty():
        step = front.join(e, front.node == e.src).select("head", F.col("dst").alias("node")).distinct()
        front = _cut(step.join(seen, ["head", "node"], "left_anti"))
        seen = _cut(seen.union(front))
    return seen
