"""Connected components of a large edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

HOT_SHARE = 1_000  # a node in more than one of so many rows is joined by broadcast; fewer than that can be


def with_least(both: DataFrame, rows: int) -> DataFrame:
    """Edges (u, v) with m, the smallest of u and its neighbours. A node's edges are never gathered: the minimum is an aggregate
    and goes back by a join, for the centres of great stars by broadcast, so no task gets a star."""
    counted = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    limit = max(1, rows // HOT_SHARE)
    hot, cold = (counted.filter(c).drop("n") for c in (F.col("n") > limit, F.col("n") <= limit))
    return both.join(F.broadcast(hot), "u").unionByName(both.join(F.broadcast(hot.select("u")), "u", "left_anti").join(cold, "u"))


def star(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """One step on edges (u, v). Large: each node gives its greater neighbours its smallest neighbour; small: its smaller ones."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        out = with_least(both, 2 * rows).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("v"))
        out = with_least(both, rows).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least)
    return out.filter("u <> v").distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node and component (the smallest node reachable) of every node of an edge but the smallest of each component. Each
    round's table goes when the next one is written."""
    now = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v"), "edges")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == state or not state["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
        once = written(star(now, True, state["n"]), "edges")
        following = written(star(once, False, state["n"]), "edges")
        for done in (now, once):
            drop_written(done)
        now = following
