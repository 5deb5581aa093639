"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is two aggregations and joins on a node; the minimum of a node's neighbours is
pre-aggregated before its shuffle and a hot node's edges are left to AQE's skew join.  Every
round is written to the shared folder, so a lost executor re-reads one round only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _mins(e: DataFrame) -> DataFrame:
    return e.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _mins(both).select("u", F.least("u", "m").alias("m"))
    return (both.where("v > u").join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _mins(down)
    linked = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _mark(edges: DataFrame) -> tuple:
    """Row count and hash sums; decimals, as a sum of longs overflows on large tables."""
    wide = "decimal(28,0)"
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast(wide)),
                           F.sum(F.xxhash64("v", "u").cast(wide))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; the component is its smallest node.

    ``edges`` has long columns u and v in either order; repeated edges and loops do no harm,
    null ends are left out, an empty table gives an empty result.
    """
    now = stage(edges.where("u is not null and v is not null and u != v")
                .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges")
    before = _mark(now)
    while before[0]:
        now = stage(_small_star(_large_star(now)), "cc-round")
        after = _mark(now)
        if after == before:
            break
        before = after
    # every node points at its component's smallest member, which points at nothing
    return (now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())
