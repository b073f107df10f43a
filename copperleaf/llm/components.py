"""Distributed union-find: connected components by alternating large and small stars over a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def _mirrored(edges: DataFrame) -> DataFrame:
    return edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


#: Nodes with more than 1 / HUBS of all rows, and LEAST_HUB of them, are hubs; there can't be more than HUBS.
HUBS, LEAST_HUB = 1000, 1000


def _star(edges: DataFrame, large: bool, hub: int | None = None) -> DataFrame:
    """Each node's larger (or smaller) neighbours are tied to the least of all (or of the smaller) ones and itself. hub: nodes
    with more neighbours, few by that bound, are broadcast, so that no task gets all neighbours of one."""
    sides = _mirrored(edges) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = sides.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m"))  # summed before the shuffle
    if hub is None:
        tied = sides.join(least, "u")
    else:
        hubs = F.broadcast(least.where(F.col("n") > hub).select("u", "m"))
        others = sides.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("n") <= hub).select("u", "m"), "u")
        tied = sides.join(hubs, "u").unionAll(others.select("u", "v", "m"))
    out = tied.where("v > u") if large else tied
    out = out.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for each node of edges (two columns of one type, whatever names).

    Every round is written to the shared folder, so lineage stays short; rounds grow with the logarithm of the diameter."""
    a, b = edges.columns
    now = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    state = None
    while True:
        before, state = state, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            roots = now.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("root"))
            return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
        hub = max(LEAST_HUB, 2 * state[0] // HUBS)
        most = _mirrored(now).groupBy("u").count().agg(F.max("count")).first()[0] if 2 * state[0] > hub else 0
        last = now
        if most > hub:
            half = cut(_star(last, True, hub))
            now = cut(_star(half, False, hub))
            discard(half)
        else:  # the small star's nodes have no more neighbours
            now = cut(_star(_star(last, True), False))
        discard(last)
