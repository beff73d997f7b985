"""Connected components of a graph too large for one machine, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespar.llm.common import cut


def _with_nearest(links: DataFrame, ends: int, hot: int, itself: bool = False) -> DataFrame:
    """``links`` (u, v) with m, the least neighbour of u, or u if that is less and ``itself``.

    Vertices with more than ``hot`` of the ``ends`` links are fewer than ends / hot, at most some ten thousand: they are broadcast, so that
    their links stay where they are. All others meet their least neighbour by a shuffle, ``hot`` rows at most."""
    near = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    near = near.select("u", (F.least("u", "m") if itself else F.col("m")).alias("m"), "n")
    if ends <= hot:  # none can have more
        return links.join(near.drop("n"), "u")
    hot = max(hot, ends // 10_000)
    near = cut(near)
    many = F.broadcast(near.where(F.col("n") > hot).drop("n"))
    return links.join(many, "u").unionByName(links.join(many.select("u"), "u", "left_anti").join(near.where(F.col("n") <= hot).drop("n"), "u"))


def connected_components(edges: DataFrame, hot: int = 1_000_000) -> DataFrame:
    """Of links (a, b) of one orderable type, each linked vertex's component: columns ``vertex`` and ``root``, the least vertex.

    Each round links all larger neighbours of a vertex to its least one, then all smaller ones, until nothing
    changes; the number of rounds grows with the logarithm of the number of vertices. A vertex with many links
    is never gathered: its least neighbour is a partial aggregate, and beyond ``hot`` links it is sent to them (see
    ``_with_nearest``). Links from a vertex to itself and null ends are ignored; repeated links count once; no links give no rows."""
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = (e.count(), None)
    while True:
        n = state[0]
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_nearest(both, 2 * n, hot, itself=True).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_nearest(large, 2 * n, hot)
        e = cut(small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        got = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if got == state:
            break
        state = got
    return e.select(F.col("u").alias("vertex"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct())
