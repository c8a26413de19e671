"""Neighbourhoods and paths of many starts at once, each held to a number of nodes or paths.

What a start may still add is decided in every round, so rows stay in proportion to starts times quota.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.graph import both_ways, kept
from tessera.operators.rounds import Rounds

#: Room for sums of costs.
ROOM = 1e-9


def _nearest(rounds: Rounds) -> DataFrame:
    return rounds.log("reached").groupBy("start", "node").agg(F.min("dist").alias("dist"))


def neighbourhood(edges: DataFrame, starts: DataFrame, radius: float, max_nodes: int, shrink: float | None = 0.6, soft: float = 0.8, delta: float = 0.5) -> DataFrame:
    """``start, place, node, dist, effective_radius``: nodes in the order in which they settle (nearest first, then least
    address), up to ``max_nodes`` a start, within ``radius`` over undirected edges ``a, b, cost``.

    Once ``floor(soft * max_nodes)`` nodes are settled, at distance ``d``, the radius that is left beyond ``d`` shrinks to
    ``shrink`` of it (not if that is None).  Distances are relaxed in buckets of ``delta``: below a bucket's
    end they are final, and a start with enough of them is expanded no more.
    """
    spark, first = edges.sparkSession, int(soft * max_nodes)
    with Rounds(spark, "neighbourhood") as rounds:
        steps = rounds.keep(both_ways(edges.select("a", "b", "cost").where("a != b")), "steps")
        if steps.where("cost < 0").limit(1).count():
            raise ValueError("costs may not be negative")
        own = starts.select(F.col("entry_va").alias("start"), F.col("entry_va").alias("node"), F.lit(0.0).alias("dist"), F.lit(radius).alias("reach")).distinct()
        waiting, bound = rounds.append(own, "reached"), delta
        while waiting.limit(1).count():
            now = waiting.where(F.col("dist") < bound)
            if now.limit(1).count():
                told = now.join(steps, now["node"] == steps["a"]).select("start", F.col("b").alias("node"), F.round(F.col("dist") + F.col("cost"), 9).alias("dist"), "reach")
                told = told.where(F.col("dist") <= F.col("reach") + ROOM).groupBy("start", "node").agg(F.min("dist").alias("dist"), F.min("reach").alias("reach"))
                old = _nearest(rounds).withColumnRenamed("dist", "old")
                better = rounds.append(told.join(old, ["start", "node"], "left").where(f"old is null or dist < old - {ROOM}").select("start", "node", "dist", "reach"), "reached")
                waiting = rounds.keep(waiting.where(F.col("dist") >= bound).unionByName(better), "waiting")
                continue
            # all below the bound is settled: starts with enough of it leave, others may reach less far
            settled = _nearest(rounds).where(F.col("dist") < bound)
            order = F.row_number().over(W.partitionBy("start").orderBy("dist", "node"))
            counts = settled.withColumn("place", order).groupBy("start").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("place") == max(1, first), F.col("dist"))).alias("at"))
            reach = F.when(F.col("at").isNotNull() & F.lit(shrink is not None and first > 0), F.col("at") + (radius - F.col("at")) * (shrink or 0)).otherwise(radius)
            open_ = counts.where(F.col("n") < max_nodes).select("start", reach.alias("reach"))
            waiting = rounds.keep(waiting.drop("reach").join(open_, "start").where(F.col("dist") <= F.col("reach") + ROOM).select("start", "node", "dist", "reach"), "waiting")
            bound += delta
        placed = _nearest(rounds).withColumn("place", F.row_number().over(W.partitionBy("start").orderBy("dist", "node")))
        at = F.max(F.when(F.col("place") == max(1, first), F.col("dist"))).over(W.partitionBy("start"))
        placed = placed.where(F.col("place") <= max_nodes).withColumn("at", at)
        shrunk = F.col("at").isNotNull() & F.lit(shrink is not None and first > 0)
        placed = placed.withColumn("effective_radius", F.when(shrunk, F.col("at") + (radius - F.col("at")) * (shrink or 0)).otherwise(F.lit(radius)))
        inside = (F.col("place") <= max(1, first)) | (F.col("dist") <= F.col("effective_radius") + ROOM)
        return kept(placed.where(inside).select("start", "place", "node", "dist", "effective_radius"), "neighbourhood")


def neighbourhood_trace(found: DataFrame, radius: float) -> DataFrame:
    """``start, nodes, radius, effective_radius, shrunk, min_dist, max_dist, mean_dist`` of each start's neighbourhood."""
    return found.groupBy("start").agg(
        F.count(F.lit(1)).alias("nodes"), F.lit(radius).alias("radius"), F.max("effective_radius").alias("effective_radius"), (F.max("effective_radius") < radius).alias("shrunk"),
        F.min("dist").alias("min_dist"), F.max("dist").alias("max_dist"), F.round(F.avg("dist"), 6).alias("mean_dist"))


def first_paths(calls: DataFrame, starts: DataFrame, max_depth: int, max_paths: int, ranks: DataFrame | None = None) -> DataFrame:
    """``start, place, path, depth, leaf``: the first ``max_paths`` paths of each start in the order of a depth-first walk.

    A path goes on to each callee that isn't on it, in the order of ``ranks`` (``entry_va, callee_va, rank``; by default
    ascending address), and ends at ``max_depth``, at a function without callees (``no_callee``) or where all callees are
    on it already (``cycle_cut``).  Every prefix ends in one path at least, so after each round a start keeps its first
    ``max_paths`` prefixes and ended paths, in walking order, and no others can be among its first paths.
    """
    spark = calls.sparkSession
    listed = F.collect_list
    if ranks is None:
        # repeated calls share a rank and fall together where callees are listed, so calls are shuffled once
        ranks = calls.select("entry_va", "callee_va", F.dense_rank().over(W.partitionBy("entry_va").orderBy("callee_va")).alias("rank"))
        listed = F.collect_set
    with Rounds(spark, "paths") as rounds:
        # callees beyond the first max_paths + max_depth are never reached: at most max_depth of them are on the path
        step = ranks.where(F.col("rank") <= max_paths + max_depth).select(F.col("entry_va").alias("tail"), F.struct(F.col("rank").cast("int").alias("rank"), "callee_va").alias("to"))
        step = rounds.keep(step.groupBy("tail").agg(F.array_sort(listed("to")).alias("to")), "steps")
        none = F.lit(None).cast("string").alias("leaf")
        now = rounds.keep(starts.select(F.col("entry_va").alias("start"), F.array("entry_va").alias("path"), F.array().cast("array<int>").alias("key"), none).distinct(), "live")
        for _ in range(max_depth):
            live = now.where("leaf is null").withColumn("tail", F.element_at("path", -1))
            # live paths are few: their tails' callees are looked up first, so all others aren't shuffled for them
            live = live.join(step.join(live.select("tail"), "tail", "left_semi"), "tail", "left")
            free = F.filter("to", lambda x: ~F.array_contains("path", x["callee_va"]))
            ends = F.when(F.col("to").isNull(), "no_callee").when(F.size(free) == 0, "cycle_cut")
            live = live.withColumn("free", free).withColumn("leaf", ends)
            stopped = live.where("leaf is not null").select(*now.columns)
            longer = live.where("leaf is null").select("start", "path", "key", F.explode(F.slice("free", 1, max_paths)).alias("x"))
            longer = longer.select("start", F.array_append("path", F.col("x.callee_va")).alias("path"), F.array_append("key", F.col("x.rank")).alias("key"), none)
            all_ = now.where("leaf is not null").unionByName(stopped).unionByName(longer)
            now = rounds.keep(all_.withColumn("n", F.row_number().over(W.partitionBy("start").orderBy("key"))).where(F.col("n") <= max_paths).drop("n"), "live")
            if not now.where("leaf is null").limit(1).count():
                break
        place = F.row_number().over(W.partitionBy("start").orderBy("key"))
        out = now.select("start", place.alias("place"), "path", (F.size("path") - 1).alias("depth"), F.coalesce("leaf", F.lit("max_depth")).alias("leaf"))
        return kept(out, "paths")
