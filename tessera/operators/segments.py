"""Batches under a token budget over groups of any size, equal to a fold over each group in order.

Where a batch that starts at an item ends is known from the few items after it.  Groups are cut into chunks; a chunk
tells for every place at which a batch may enter it where the first batch of the next chunk starts.  Such maps are
put together by pointer doubling, and then every chunk numbers its own items.  So one long group spans many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.graph import kept

#: Items of a chunk.
CHUNK = 1 << 15


def positions(items: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``items`` with ``place``, their number from 0 in each group, without a group in one task."""
    spread = items.repartitionByRange(by, *order).sortWithinPartitions(by, *order).withColumn("at", F.monotonically_increasing_id())
    rows = kept(spread, "ordered")
    part = F.shiftright("at", 33)
    starts = rows.groupBy(by, part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(by).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select(F.col(by).alias("by"), "part", "first", before.alias("before"))
    same = F.col(by).eqNullSafe(F.col("by")) & (part == F.col("part"))
    return rows.join(starts, same).withColumn("place", F.col("before") + F.col("at") - F.col("first")).select(*items.columns, "place")


def _ends(tokens: np.ndarray, budget: int, size: int, least: int) -> np.ndarray:
    """Where the batch that starts at each item ends: the first item after it."""
    upto = np.concatenate(([0], np.cumsum(tokens)))
    start = np.arange(len(tokens))
    over = np.searchsorted(upto, upto[:-1] + budget, side="right") - 1
    return np.minimum(start + size, np.maximum(start + least, over))


def _chunk(rows: pa.Table, chunk: int, size: int) -> tuple[pa.Table, np.ndarray, int]:
    rows = rows.sort_by("place")
    place = rows.column("place").to_numpy() - rows.column("chunk")[0].as_py() * chunk
    return rows, rows.column("tokens").to_numpy(), int((place < chunk).sum())


def batches(items: DataFrame, tokens: str, budget: int, size: int, by: str, order: list[str], least: int = 1, chunk: int = CHUNK) -> DataFrame:
    """``items`` with ``batch`` (from 0): neighbours in ``order``, at most ``size`` and ``budget`` tokens a batch and
    ``least`` items at least (1 or more).  Null or negative numbers of tokens count as 0; ``order`` should tell all items
    of a group apart.  A null group is a group of its own."""
    if not 1 <= least <= size <= chunk:
        raise ValueError("1 <= least <= size <= chunk")
    placed = kept(positions(items, by, order).withColumn("tokens_", F.greatest(F.coalesce(F.col(tokens).cast("long"), F.lit(0)), F.lit(0))), "placed")
    slim = placed.select(F.col(by).alias("by"), "place", F.col("tokens_").alias("tokens")).withColumn("chunk", F.floor(F.col("place") / chunk))
    # a chunk also sees the first items of the next one, into which its last batch may reach
    ahead = slim.where(F.pmod("place", F.lit(chunk)) < size).where("chunk > 0").withColumn("chunk", F.col("chunk") - 1)
    slim = slim.unionByName(ahead)
    kind = dict(slim.dtypes)["by"]

    def leave(rows: pa.Table) -> pa.Table:
        rows, t, own = _chunk(rows, chunk, size)
        ends = _ends(t, budget, size, least)
        go, count = np.zeros(own + size, dtype=np.int64), np.zeros(own + size, dtype=np.int64)
        go[own:] = np.arange(size)
        for i in range(own - 1, -1, -1):
            go[i], count[i] = go[ends[i]], count[ends[i]] + 1
        return pa.table({"by": rows.column("by")[:1], "chunk": rows.column("chunk")[:1], "go": pa.array([go[:size].tolist()], pa.list_(pa.int64())), "count": pa.array([count[:size].tolist()], pa.list_(pa.int64()))})

    maps = kept(slim.groupBy("by", "chunk").applyInArrow(leave, f"by {kind}, chunk long, go array<long>, count array<long>"), "maps")
    # after k rounds: the way through the 2^k chunks up to each
    reach, step = maps, 1
    while maps.where(F.col("chunk") >= step).limit(1).count():
        first = reach.select(F.col("by").alias("by_"), (F.col("chunk") + step).alias("chunk_"), F.col("go").alias("go_"), F.col("count").alias("count_"))
        both = reach.join(first, F.col("by").eqNullSafe(F.col("by_")) & (F.col("chunk") == F.col("chunk_")), "left")
        through = F.transform("go_", lambda o: F.get("go", o))
        counted = F.transform(F.arrays_zip("go_", "count_"), lambda z: z["count_"] + F.get("count", z["go_"]))
        reach = kept(both.select("by", "chunk", F.when(F.col("go_").isNull(), F.col("go")).otherwise(through).alias("go"), F.when(F.col("go_").isNull(), F.col("count")).otherwise(counted).alias("count")), "maps")
        step *= 2
    enter = reach.select(F.col("by").alias("by_"), (F.col("chunk") + 1).alias("chunk_"), F.get("go", F.lit(0)).alias("enter"), F.get("count", F.lit(0)).alias("base"))
    slim = slim.join(enter, F.col("by").eqNullSafe(F.col("by_")) & (F.col("chunk") == F.col("chunk_")), "left").select("by", "chunk", "place", "tokens", F.coalesce("enter", F.lit(0)).alias("enter"), F.coalesce("base", F.lit(0)).alias("base"))

    def number(rows: pa.Table) -> pa.Table:
        rows, t, own = _chunk(rows, chunk, size)
        ends, starts, at = _ends(t, budget, size, least), np.zeros(own, dtype=np.int64), rows.column("enter")[0].as_py()
        while at < own:
            starts[at] = 1
            at = int(ends[at])
        rows = rows.slice(0, own)
        return pa.table({"by": rows.column("by"), "place": rows.column("place"), "batch": rows.column("base").to_numpy() + np.cumsum(starts) - 1})

    numbered = slim.groupBy("by", "chunk").applyInArrow(number, f"by {kind}, place long, batch long").select(F.col("by").alias("by_"), F.col("place").alias("place_"), "batch")
    same = placed[by].eqNullSafe(F.col("by_")) & (F.col("place") == F.col("place_"))
    return placed.join(numbered, same).select(*items.columns, "batch")
