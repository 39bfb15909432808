"""Connected components of edge tables, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import common as C


def components(edges: DataFrame, a: str, b: str, scratch: C.Scratch) -> DataFrame:
    """node, component (the smallest node reachable) of each node that has an edge.

    Each round takes the smallest label among neighbours and then the label's own label, so
    long chains shorten by doubling; every round is written to the shared folder.
    """
    one = edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = scratch.write(one.union(one.select(F.col("other"), F.col("node"))).where("node <> other").distinct(), "edges")
    labels = scratch.write(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("_near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("_old"), F.least("component", "_near").alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("_up"))
        jumped = lower.join(up, "component", "left").select("node", "_old", F.least(F.col("component"), F.coalesce("_up", "component")).alias("component"))
        jumped = scratch.write(jumped, "labels")
        labels = jumped.select("node", "component")
        if jumped.where("_old <> component").isEmpty():
            return labels


def joined(known: DataFrame, edges: DataFrame, a: str, b: str, scratch: C.Scratch) -> DataFrame:
    """Components (node, component) after more edges: only the components that edges join are looked at again."""
    of = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    ends = edges.join(of(a), a, "left").join(of(b), b, "left").select(a, b, F.coalesce(f"_{a}", a).alias("_x"), F.coalesce(f"_{b}", b).alias("_y"))
    ends = scratch.write(ends, "joins")
    merged = components(ends, "_x", "_y", scratch).select(F.col("node").alias("component"), F.col("component").alias("_new"))
    fresh = ends.select(F.col(a).alias("node")).union(ends.select(b)).distinct().join(known, "node", "left_anti").select("node", F.col("node").alias("component"))
    every = known.select("node", "component").union(fresh).join(merged, "component", "left")
    return scratch.write(every.select("node", F.coalesce("_new", "component").alias("component")), "components")
