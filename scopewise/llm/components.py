"""Connected components of an undirected graph given as an edge table, by alternating star operations.

Large-star links every larger neighbour of a node to the smallest of its neighbours and itself; small-star links
the node and its smaller neighbours to the smallest of them. Alternating ends in one star for each component,
around its smallest node, after a number of rounds that is logarithmic in practice. Neighbour minima are
aggregates (combined before the shuffle), so a hub is never gathered in one task; what is joined to the edges of
hubs, of which there are SHARE at most, is broadcast. Each round is a table in the shared folder; nothing goes to the driver but
one row of checksums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopewise.llm.common import SHARE, stage, unstage


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(u, v) of longs, in any order and repeated at will -> (node, root) for every node that has an edge."""
    now = stage(_tidy(edges), "links")
    seen = _checksum(now)
    while seen[0]:
        hubs = _hubs(now, seen[0])
        step = stage(_small_star(_large_star(now, hubs)), "links")
        unstage(now)
        unstage(hubs)
        now, before, seen = step, seen, _checksum(step)
        if seen == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def _large_star(edges: DataFrame, hubs: DataFrame) -> DataFrame:
    """Each edge (u, v), u being the larger, becomes (u, m): m is the least of v and v's neighbours.

    A node that has no smaller neighbour is its own m. hubs(v, m) are the nodes that many edges have as v.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "node")
    near = edges.join(F.broadcast(hubs), "v").select("u", F.col("m").alias("v"))
    rest = edges.join(F.broadcast(hubs.select("v")), "v", "left_anti").join(least, F.col("v") == F.col("node"), "left")
    return near.unionByName(rest.select("u", F.coalesce("m", "v").alias("v")))


def _hubs(edges: DataFrame, total: int) -> DataFrame:
    """(v, m) of the nodes that more than 1 / SHARE of the edges lead to: SHARE of them at most."""
    hot = edges.groupBy("v").count().where(F.col("count") * SHARE > total).select("v")
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "v")
    return stage(hot.join(least, "v", "left").select("v", F.coalesce("m", "v").alias("m")), "hubs")


def _small_star(edges: DataFrame) -> DataFrame:
    edges = _tidy(edges)
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _tidy(moved.unionByName(least.select("u", F.col("m").alias("v"))))


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
