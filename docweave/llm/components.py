"""Connected components by alternating large-star and small-star steps, without iteration over a node's edges in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import _common as c


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over (u, v) with u > v. Hubs are aggregated in part before the exchange."""
    if large:
        ends = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = ends.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected ``edges`` (u, v); component is the smallest node.

    Every round is a written table; rounds end when all edges point to a smallest node.
    """
    path = c.fresh_dir(edges.sparkSession, "stars")
    now = c.staged(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), path)
    for _ in range(most):
        path, before = c.fresh_dir(now.sparkSession, "stars"), path
        now = c.staged(_stars(_stars(now, True), False), path)
        c.remove(before)
        # Done when no node is both a child and a root, and no child has two roots.
        roots = now.select(F.col("v").alias("u")).distinct()
        doubles = now.groupBy("u").count().where("count > 1").select("u")
        if now.select("u").join(roots, "u", "left_semi").unionByName(doubles).isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
