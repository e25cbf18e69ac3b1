"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, spread_join


def star(edges: DataFrame, large: bool, scratch: Scratch) -> DataFrame:
    """Every node's larger (large star) or smaller (small star) neighbours, and itself, now point to its least neighbour."""
    if large:
        around = edges.union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
    else:
        around = edges.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
    around = scratch.save(around, "around")
    least = scratch.save(around.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("least"), F.count("*").alias("degree")), "least")
    near = spread_join(around, least, ["x"], "degree", "y")
    if large:
        out = near.where(F.col("y") > F.col("x")).select(F.col("y").alias("x"), F.col("least").alias("y"))
    else:
        out = near.select("y", "least").union(least.select("x", "least")).toDF("x", "y")
    out = scratch.save(out.where("x <> y").distinct(), "stars")
    scratch.drop(around, least)
    return out


def settled(edges: DataFrame) -> bool:
    """Whether edges (x, y) with x > y are stars around least nodes: no x has two y, and no y is an x."""
    ends = edges.select(F.col("x").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(edges.select("y", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 or (out > 0 and in > 0)").isEmpty()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): each node of ``edges`` (x, y), the root being the least node of its component.

    Edges are rewritten in tables until they are stars; nothing of them reaches
    the driver but whether they are.
    """
    current = scratch.save(edges.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "edges")
    while not settled(current):
        grown = star(current, True, scratch)
        scratch.drop(current)
        current = star(grown, False, scratch)
        scratch.drop(grown)
    nodes = current.select(F.col("x").alias("node"), F.col("y").alias("root"))
    return nodes.union(current.select(F.col("y").alias("node"), F.col("y").alias("root"))).distinct()
