"""Connected components by alternating stars.

Large-star hangs every larger neighbour of a node on the least node of its neighbourhood, small-star does
so with the smaller ones; repeated, every component becomes a star around its least node in O(log^2 n)
rounds. Neighbourhood minima are aggregated partially before the shuffle, and edges meet them in a
join, which splits a hub's edges; each round is stored, so a lost executor never costs the earlier rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(directed: DataFrame) -> DataFrame:
    """(v, least neighbour of u or u itself) for the directed edges u -> v."""
    least = directed.groupBy("u").agg(F.least("u", F.min("v")).alias("least"))
    return directed.join(least.hint("shuffle_hash"), "u")


def stars(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge in ``edges`` (u, v: bigint) and isn't its component's
    least node, which is the root."""
    now = stored(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias(
        "v")).distinct())
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("least").alias("v")).where(
            "u != v").distinct()
        small = _star(large)
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("least").alias("v")),
                                               F.struct("u", F.col("least").alias("v")))).alias("e")).select("e.u", "e.v")
        now = stored(small.where("u != v").distinct())
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
