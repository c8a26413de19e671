"""Exact percentiles of groups of any size, without a group's values in one task.

A sketch of bounded size gives two values around each wanted rank.  One pass counts what lies below the lower one
and the distinct values between the two, combined before the shuffle; the ranks are then found among these.
Where a sketch was off, which the counts tell, the bounds widen and that group is counted again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.graph import kept

#: Relative rank error of the sketch is one in so many; bounds start at twice that.
ACCURACY = 10_000
#: Tables of up to so many groups are broadcast.
BROADCAST_GROUPS = 20_000


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else df


def percentiles(df: DataFrame, by: list[str], values: list[str], fractions: list[float], accuracy: int = ACCURACY) -> DataFrame:
    """``<by>, name, fraction, value``: for each of the columns ``values`` its percentiles, linear between neighbours.

    Null values don't count; a group of only nulls has no row.  Nulls in ``by`` are a group of their own.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("v")) for v in values]))
    keys = [f"k{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], pairs.alias("p")).select(*keys, "p.name", "p.v").where("v is not null")
    keys = [*keys, "name"]
    ask = F.explode(F.array(*[F.lit(float(q)) for q in fractions])).alias("fraction")
    room = 2 / accuracy
    around = sorted({min(1.0, max(0.0, q + s * room)) for q in fractions for s in (-1, 1)})
    sketch = F.percentile_approx("v", [float(a) for a in around], accuracy)
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), sketch.alias("s"))
    at = lambda s: F.element_at("s", F.array_position(F.lit(around), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("fraction") + s * room))).cast("int"))
    place = (F.col("n") - 1) * F.col("fraction")
    asked = groups.select("*", ask).select(*keys, "fraction", "n", "least", "most", place.alias("place"), at(-1).alias("low"), at(1).alias("high"))
    # which values a rank may have: all between the sketch's, all of the group at the ends
    asked = asked.withColumns({"low": F.when(F.col("fraction") <= room, F.col("least")).otherwise(F.coalesce("low", "least")), "high": F.when(F.col("fraction") >= 1 - room, F.col("most")).otherwise(F.coalesce("high", "most"))})
    asked, found = kept(asked, "asked"), []
    while True:
        same = [F.col(f"r.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys]
        seen = rows.alias("r").join(_few(asked).alias("a"), same).where("r.v <= a.high").select(*[f"a.{k}" for k in keys], "a.fraction", F.when(F.col("r.v") >= F.col("a.low"), F.col("r.v")).alias("v"))
        counts = kept(seen.groupBy(*keys, "fraction", "v").agg(F.count(F.lit(1)).alias("c")), "counts")
        w = W.partitionBy(*keys, "fraction").orderBy(F.col("v").asc_nulls_first())
        run = counts.withColumn("upto", F.sum("c").over(w.rowsBetween(W.unboundedPreceding, 0)))
        same = [F.col(f"c.{k}").eqNullSafe(F.col(f"a.{k}")) for k in [*keys, "fraction"]]
        run = run.alias("c").join(_few(asked).alias("a"), same).select(*[f"a.{k}" for k in [*keys, "fraction", "place"]], "c.v", "c.c", "c.upto")
        rank = lambda p: F.min(F.when(F.col("upto") > p, F.struct("upto", "v")))["v"]
        below, there = F.max(F.when(F.col("v").isNull(), F.col("upto"))), F.max("upto")
        got = run.groupBy(*keys, "fraction", "place").agg(rank(F.floor("place")).alias("a"), rank(F.ceil("place")).alias("b"), F.coalesce(below, F.lit(0)).alias("below"), there.alias("there"))
        good = (F.col("below") <= F.floor("place")) & (F.ceil("place") < F.col("there"))
        got = kept(got.withColumn("good", good), "ranks")
        found.append(got.where("good"))
        if not got.where("not good").limit(1).count():
            break
        same = [F.col(f"b.{k}").eqNullSafe(F.col(f"a.{k}")) for k in [*keys, "fraction"]]
        asked = kept(asked.alias("a").join(got.where("not good").alias("b"), same, "left_semi").withColumns({"low": F.col("least"), "high": F.col("most")}), "asked")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    share = F.col("place") - F.floor("place")
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=False)], "name", "fraction", (F.col("a") + (F.col("b") - F.col("a")) * share).alias("value"))
