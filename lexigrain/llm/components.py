"""Connected components by alternating large-star and small-star, on any comparable node type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.storage import Scratch


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step; edges and result are (u, v) with v < u.

    The minimum of each node's neighbours is a combined aggregate; the join
    back may meet a hub, which adaptive execution splits.
    """
    sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    met = sides.join(least, "u")
    if large:  # larger neighbours go to the minimum of the neighbourhood and the node itself
        return met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    # smaller neighbours and the node itself go to the smallest of them
    return met.select(F.explode(F.array("u", "v")).alias("x"), "m").filter("x != m").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()


def connected(edges: DataFrame, scratch: Scratch, name: str = "stars", most: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with an edge.

    Each round is written to the shared folder; rounds grow with the logarithm
    of the longest shortest path, and end when a round changes nothing.
    """
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()
    now, sign = scratch.table(pairs, f"{name}0"), None
    for k in range(1, most):
        now = scratch.table(_stars(_stars(now, True), False), f"{name}{k}")
        scratch.drop(f"{name}{k - 1}")
        last, sign = sign, _sign(now)
        if sign == last:
            break
    else:
        raise RuntimeError("the components have not settled")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
