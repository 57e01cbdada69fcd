"""Connected components of a link table by alternating large and small stars.

Every step is a keyed minimum (combined before the shuffle) and a join on the same key; neighbour lists are
never gathered, so a node with a third of all links is split by the adaptive skew join. Each round is a table in
the shared folder. Nothing but one row of counts per round comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v) with u > v: neighbours point to the smallest neighbour."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v"))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, u: str, v: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has a link; component is the smallest reachable id.

    Nulls and self links are ignored, repeated links count once, an empty table gives an empty one. Raises if the
    rounds (logarithmic in practice) are used up, rather than return unfinished components.
    """
    now = materialize(
        edges.select(F.greatest(u, v).cast("long").alias("u"), F.least(u, v).cast("long").alias("v"))
        .where(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col(u) != F.col(v))).distinct(), "cc")
    mark = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not state.n or (state.n, state.h) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark = (state.n, state.h)
        following = materialize(_star(_star(now, True), False), "cc")
        release(now)
        now = following
    raise RuntimeError("components did not settle")
