"""Connected components by alternating large-star and small-star rounds on a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stage(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "star")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = stage(down.groupBy("u").agg(F.min("v").alias("m")), "star")
    moved = down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links(a, b)``: the label is the smallest node that it reaches.

    Each round is written to the shared folder; links whose ends are equal or null are left out. Rounds grow with the
    logarithm of a component's size, and a node's partners are only ever reduced to their minimum.
    """
    edges = stage(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    while True:
        new = stage(_small_star(stage(_large_star(edges), "edges")), "edges")
        # both are sets of rows: equal if as many and none is new
        same = new.count() == edges.count() and new.join(edges, ["u", "v"], "left_anti").isEmpty()
        edges = new
        if same:
            break
    return stage(
        edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        .union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")))
        .groupBy("node").agg(F.min("label").alias("label")),
        "labels",
    )
