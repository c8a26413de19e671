"""Rewriting of code text: comments, renames, and batches for an outside analyst."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T


#: What ends a line.
LINE_END = r"\r\n|\r|\n"


def numbered_lines(code: DataFrame, key: str = "entry_va", body: str = "body") -> DataFrame:
    """``key, line_no`` (from 1) and ``line`` of each text."""
    return code.select(key, F.posexplode(F.split(body, LINE_END)).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def pruned_comments(comments: DataFrame, key: str = "entry_va", max_total: int = 60, max_same: int = 2) -> DataFrame:
    """Clean comments in order of line: at most ``max_same`` of equal text and ``max_total`` of a text."""
    rows = comments.withColumn("comment", T.clean_comment(F.col("comment"))).where("comment is not null and line_no > 0")
    same = F.row_number().over(W.partitionBy(key, F.lower("comment")).orderBy("line_no"))
    rows = rows.withColumn("same", same).where(F.col("same") <= max_same)
    return rows.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy("line_no", "comment"))).where(F.col("n") <= max_total).drop("same", "n")


def annotate(code: DataFrame, comments: DataFrame, key: str = "entry_va", body: str = "body") -> DataFrame:
    """Texts with each line's comments behind it; lines of a text meet in its own row."""
    merged = comments.groupBy(key, "line_no").agg(F.array_join(F.array_sort(F.collect_set("comment")), " | ").alias("comment"))
    per_text = merged.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("line_no", "comment"))).alias("comments"))
    lines = F.transform(F.split(body, r"\r\n|\r|\n"), lambda x, i: T.with_comment(x, F.try_element_at(F.col("comments"), i + 1)))
    return code.join(per_text, key, "left").withColumn(body, F.when(F.col("comments").isNull(), F.col(body)).otherwise(F.array_join(lines, "\n"))).drop("comments")


def comments_by_address(by_line: DataFrame, addresses: DataFrame, key: str = "entry_va") -> DataFrame:
    """``key, ea, comment`` from comments by line and each line's address, merged in line order."""
    j = by_line.join(addresses, [key, "line_no"])
    texts = F.transform(F.array_sort(F.collect_set(F.struct("line_no", "comment"))), lambda x: x["comment"])
    return j.groupBy(key, "ea").agg(F.array_join(F.array_distinct(texts), " | ").alias("comment"))


def comments_by_line(by_address: DataFrame, addresses: DataFrame, key: str = "entry_va", first_only: bool = True) -> DataFrame:
    """``key, line_no, comment`` from comments by address, at its first line or at all of them."""
    at = addresses.groupBy(key, "ea").agg(F.min("line_no").alias("line_no")) if first_only else addresses
    return by_address.join(at, [key, "ea"]).select(key, "line_no", "comment")


def renamed(code: DataFrame, renames: DataFrame, key: str = "entry_va", body: str = "body") -> DataFrame:
    """Texts with identifiers renamed; ``renames`` has a map ``renames`` for each key."""
    j = code.join(renames.select(key, "renames"), key, "left")
    return j.withColumn(body, F.when(F.col("renames").isNull(), F.col(body)).otherwise(T.rename_identifiers(F.col(body), F.col("renames")))).drop("renames")


def batches(items: DataFrame, tokens: str, budget: int, size: int, by: str, order: list[str], least: int = 1) -> DataFrame:
    """``items`` with ``batch``: neighbours in order, at most ``size`` and ``budget`` tokens a batch
    and ``least`` items at least.  Within each ``by``, which bounds a group, a fold over running
    tokens tells where batches start."""
    seq = F.array_sort(F.collect_list(F.struct(*order, F.col(tokens).cast("long").alias("t"))))
    step = lambda acc, x: F.when(
        (acc["n"] >= size) | ((acc["t"] + x["t"] > budget) & (acc["n"] >= least)),
        F.struct((acc["b"] + 1).alias("b"), F.lit(1).alias("n"), x["t"].alias("t"), F.array_append(acc["out"], acc["b"] + 1).alias("out")),
    ).otherwise(F.struct(acc["b"].alias("b"), (acc["n"] + 1).alias("n"), (acc["t"] + x["t"]).alias("t"), F.array_append(acc["out"], acc["b"]).alias("out")))
    start = F.struct(F.lit(0).alias("b"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("t"), F.array().cast("array<int>").alias("out"))
    made = items.groupBy(by).agg(seq.alias("seq")).select(by, F.arrays_zip("seq", F.aggregate("seq", start, step)["out"].alias("batch")).alias("z")).select(by, F.explode("z").alias("z"))
    return made.select(by, "z.seq.*", "z.batch")


def analysed(items: DataFrame, analyst: Callable[[list[dict]], list[dict]], schema: str, attempts: int = 2) -> DataFrame:
    """Results of an outside analyst called on batches of rows, with bounded retries.

    ``analyst`` takes rows and returns as many results of ``schema``; a batch that keeps failing is
    left out, its rows stay eligible."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = pdf.to_dict("records")
            for _ in range(attempts):
                try:
                    out = analyst(rows)
                except (RuntimeError, ValueError, OSError):
                    continue
                if len(out) == len(rows):
                    yield pd.DataFrame(out)
                    break

    return items.mapInPandas(run, schema)
