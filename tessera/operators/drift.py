"""Drift of a table down to its rows: a tree of additive sums, descended where two trees differ.

Every row belongs to a leaf by the hash of its key; a leaf has the number of its rows and three sums of parts of their
SHA-256, and a node the sums of its leaves.  Sums add and subtract, so a change brings a tree up to date without
the table.  Two tables are compared from the root down; rows are read only for leaves that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import kept

#: Bits of a leaf's number, and how many of them a step down the tree adds.
BITS, STEP = 16, 4
_SUMS = ["n", "h0", "h1", "h2"]
_PARTS = ["p0_", "p1_", "p2_", "p3_"]


def _leaf(key: list[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(1 << bits))


def _digest(columns: list[str]) -> Column:
    """Digest of a row's ``columns``; null and empty differ."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in columns])), 256)


def _hashed(rows: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """``key`` with the parts of the digest of ``columns``."""
    h = _digest(columns)
    return rows.select(*key, F.lit(1).cast("long").alias("n"), *[F.conv(F.substring(h, k, 15), 16, 10).cast("decimal(38,0)").alias(f"h{i}") for i, k in enumerate((1, 16, 31))])


def _signed_parts(columns: list[str], sign: int) -> list[Column]:
    """A row's counts on either side and 128 bits of its digest in four numbers, negative on the second side.  In a shuffle these are
    less than half of two sides of wide sums, and they hold for 2^31 rows of one key."""
    h = _digest(columns)
    parts = [(F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long") * sign).alias(p) for i, p in enumerate(_PARTS)]
    return [F.lit(int(sign > 0)).cast("long").alias("n1"), F.lit(int(sign < 0)).cast("long").alias("n2"), *parts]


def _added(rows: DataFrame, by: list[str]) -> DataFrame:
    sums = rows.groupBy(*by).agg(*[F.sum(c).cast("long" if c == "n" else "decimal(38,0)").alias(c) for c in _SUMS])
    return sums.where("n != 0 or h0 != 0 or h1 != 0 or h2 != 0")


def leaves(rows: DataFrame, key: list[str], columns: list[str], bits: int = BITS) -> DataFrame:
    """``leaf, n, h0, h1, h2`` of a table as a multiset of rows."""
    return _added(_hashed(rows, key, columns).withColumn("leaf", _leaf(key, bits)), ["leaf"])


def updated(tree: DataFrame, removed: DataFrame, added: DataFrame, key: list[str], columns: list[str], bits: int = BITS) -> DataFrame:
    """Leaves after rows went and others came, from the change alone."""
    minus = leaves(removed, key, columns, bits).select("leaf", *[(-F.col(c)).cast("long" if c == "n" else "decimal(38,0)").alias(c) for c in _SUMS])
    return _added(tree.unionByName(minus).unionByName(leaves(added, key, columns, bits)), ["leaf"])


def differing_leaves(one: DataFrame, two: DataFrame, bits: int = BITS, step: int = STEP) -> DataFrame:
    """``leaf`` of those that differ, found from the root down: a node is opened only if its sums differ."""
    both = kept(one.withColumn("side", F.lit(1)).unionByName(two.withColumn("side", F.lit(2))), "leaves")
    open_ = None
    for down in range(step, bits + step, step):
        shift = max(0, bits - down)
        nodes = both.withColumn("node", F.shiftright("leaf", shift))
        if open_ is not None:
            nodes = nodes.withColumn("above", F.shiftright("leaf", min(bits, shift + step))).join(open_.withColumnRenamed("node", "above"), "above", "left_semi")
        signed = nodes.select("node", *[F.when(F.col("side") == 1, F.col(c)).otherwise(-F.col(c)).alias(c) for c in _SUMS])
        open_ = kept(_added(signed, ["node"]).select("node"), "open")
    return open_.withColumnRenamed("node", "leaf")


def changed_rows(one: DataFrame, two: DataFrame, key: list[str], columns: list[str], trees: tuple[DataFrame, DataFrame] | None = None, bits: int = BITS) -> DataFrame:
    """``<key>, change``: keys whose rows are ``added`` or ``removed`` in the second table, or ``changed``.

    ``trees`` are the leaves of both where they are stored.  Rows of leaves that differ are all that is
    shuffled.  Keys may repeat: the rows of a key are compared as a multiset.  Null keys are compared like others.
    """
    trees = trees or (leaves(one, key, columns, bits), leaves(two, key, columns, bits))
    apart = differing_leaves(*trees, bits)
    small = F.broadcast(apart) if apart.limit(1 << BITS).count() < 1 << BITS else apart
    side = lambda df, s: df.withColumn("leaf_", _leaf(key, bits)).join(small, F.col("leaf_") == F.col("leaf"), "left_semi").select(*key, *_signed_parts(columns, s))
    sums = side(one, 1).unionByName(side(two, -1)).groupBy(*key).agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2"), *[F.sum(p).alias(p) for p in _PARTS])
    change = F.when(F.col("n1") == 0, "added").when(F.col("n2") == 0, "removed").when((F.col("n1") != F.col("n2")) | F.expr(" or ".join(f"{p} != 0" for p in _PARTS)), "changed")
    return sums.select(*key, change.alias("change")).where("change is not null")
