"""Distributed union-find over an edge table, by DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that isn't its component's smallest, from edges (a, b) in any direction.

    Each round hooks every node to its smallest neighbour if that is smaller, shortens the trees to stars by pointer
    jumping and contracts the edges to the roots; only the smallest neighbours of larger nodes are left to hook, so few
    rounds do. Tables of each step lie in the shared folder. Loops, repeated edges and nulls don't matter."""
    left = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("a is not null and b is not null and hi <> lo").distinct()
    stars: list[DataFrame] = []
    while True:
        left = keep(left, "edges")
        if left.isEmpty():
            break
        star = keep(left.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root"), F.lit(True).alias("open")), "star")
        while not star.where("open").isEmpty():
            up = star.select(F.col("node").alias("root"), F.col("root").alias("next"))
            star = keep(star.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open")), "star")
        star = star.select("node", "root")
        stars.append(star)
        hi, lo = star.toDF("hi", "hi_root"), star.toDF("lo", "lo_root")
        moved = left.join(hi, "hi").join(lo, "lo", "left").select(F.col("hi_root").alias("a"), F.coalesce("lo_root", "lo").alias("b"))
        left = moved.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    if not stars:
        return left.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    out = stars[0]
    for star in stars[1:]:
        out = out.join(star.toDF("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root")).unionByName(star)
    return out
