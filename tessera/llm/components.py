"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage

#: A node with more than one in so many of the edges is a hub, and nodes with fewer than LEAST_HUB edges aren't.
HUB_SHARE, LEAST_HUB = 4096, 256


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _with_minimum(rows: DataFrame, low: DataFrame, total: int) -> DataFrame:
    """``rows`` with the ``m`` of their ``u`` in ``low`` (``u, m, n``: n rows have that u).  The rows of hubs
    stay where they are: hubs are fewer than ``2 * HUB_SHARE`` and broadcast."""
    bound = max(LEAST_HUB, total // HUB_SHARE)
    hubs = F.broadcast(low.where(F.col("n") > bound).select("u", F.col("m").alias("hub_m")))
    marked = rows.join(hubs, "u", "left")
    cold = marked.where("hub_m is null").drop("hub_m").join(low.select("u", "m"), "u")
    return cold.unionByName(marked.where("hub_m is not null").withColumnRenamed("hub_m", "m"))


def connected_components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``links``; the component is its smallest node.

    Each round is two grouped minima (combined before the shuffle) and two joins, hubs apart; its edges
    are staged as a table, so a lost executor costs one round.  Nulls and self links are
    ignored; no links give an empty result.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    edges = stage(links.where(F.col(a) != F.col(b)).select(u.alias("u"), v.alias("v")).distinct(), "edges")
    mark = _mark(edges)
    for _ in range(rounds):
        total = mark[0]
        if not total:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = _with_minimum(both, low, total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        pairs = _with_minimum(large, low, total).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = stage(pairs.select("e.u", "e.v").where("u != v").distinct(), "edges")
        new_mark = _mark(new)
        unstage(edges.sparkSession, large.staged_path)
        unstage(edges.sparkSession, edges.staged_path)
        edges = new
        if new_mark == mark:
            break
        mark = new_mark
    else:
        raise RuntimeError("components didn't settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
