"""Tables as immutable Parquet versions with a pointer, and keyed changes as joins.

Every change writes a new version and then moves the pointer, so a reader sees a whole version
and a failed job leaves the old one in place.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.schema import TABLES, conform


class Store:
    """A folder of tables; each holds versions and a small pointer table naming the current one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self, table: str) -> list[str]:
        """Pointers in the order in which they were set."""
        fs, p = self._fs(f"{self.root}/{table}/_pointers")
        return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []

    def exists(self, table: str) -> bool:
        return bool(self.versions(table))

    def read(self, table: str, version: int = -1) -> DataFrame:
        """The table at a version; an empty one if it was never written but is known."""
        names = self.versions(table)
        if not names:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.parquet(f"{self.root}/{table}/{names[version].split('-', 1)[1]}")

    def replace(self, table: str, df: DataFrame) -> None:
        """Write a version, then point to it: readers move over at once or not at all."""
        name = f"v{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{table}/{name}")
        fs, p = self._fs(f"{self.root}/{table}/_pointers/{len(self.versions(table)):08d}-{name}")
        fs.create(p, False).close()

    def tables(self) -> list[str]:
        fs, p = self._fs(self.root)
        return sorted(f.getPath().getName() for f in fs.listStatus(p) if f.isDirectory()) if fs.exists(p) else []

    def clone(self, other: Store) -> None:
        """Copy the current versions into another store."""
        for t in self.tables():
            other.replace(t, self.read(t))

    def counts(self) -> dict[str, int]:
        """Rows of each known table, -1 where it is missing."""
        return {t: self.read(t).count() if self.exists(t) else -1 for t in TABLES}


def _same(keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return cond


def insert_missing(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` plus the rows whose keys it lacks, once each."""
    new = rows.dropDuplicates(keys).alias("a").join(table.select(*keys).alias("b"), _same(keys), "left_anti")
    return table.unionByName(new, allowMissingColumns=True)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` in place of the table's rows of equal keys, or added; ``rows`` has a key once."""
    kept = table.alias("a").join(rows.select(*keys).alias("b"), _same(keys), "left_anti")
    return kept.unionByName(rows, allowMissingColumns=True)


def update(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Non-null columns of ``changes`` set in the table's rows of equal keys."""
    set_ = [c for c in changes.columns if c not in keys]
    joined = table.alias("a").join(changes.alias("b"), _same(keys), "left")
    return joined.select([(F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")) if c in set_ else F.col(f"a.{c}")).alias(c) for c in table.columns])


def update_all(table: DataFrame, ids: DataFrame, key: str, **values: object) -> DataFrame:
    """The same values set in every row whose key is in ``ids``."""
    changes = ids.select(key).distinct()
    for c, v in values.items():
        changes = changes.withColumn(c, F.lit(v).cast(table.schema[c].dataType))
    return update(table, changes, [key])


def delete(table: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    return table.alias("a").join(ids.select(*keys).alias("b"), _same(keys), "left_anti")


def ensure_status(status: DataFrame, functions: DataFrame) -> DataFrame:
    """A pending status row for every function that has none."""
    new = functions.select(F.col("id").alias("function_id"), F.lit("PENDING").alias("analysis_state"), F.lit(0).alias("confidence_score"))
    return insert_missing(status, conform(new, "analysis_status"), ["function_id"])


def sync_names(functions: DataFrame, live: DataFrame, status: DataFrame, unlock: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Names from ``live`` (``entry_va, name``) taken over; with ``unlock`` renamed functions lose a
    locked state.  Returns functions, status and counters ``checked, updated, missing, unlocked``."""
    j = functions.alias("f").join(live.alias("l"), F.col("f.entry_va") == F.col("l.entry_va"), "full_outer")
    changed = F.col("f.id").isNotNull() & F.col("l.name").isNotNull() & (F.coalesce("f.name", F.lit("")) != F.col("l.name"))
    renamed = j.where(changed).select(F.col("f.id").alias("id"), F.col("l.name").alias("name"))
    out = update(functions, renamed, ["id"])
    hit = renamed.select(F.col("id").alias("function_id"))
    locked = status.join(hit, "function_id", "left_semi").where("analysis_state = 'LOCKED'")
    new_status = update_all(status, locked, "function_id", analysis_state="ANALYZED") if unlock else status
    counters = j.agg(F.count("f.id").alias("checked"), F.count_if(changed).alias("updated"), F.count_if(F.col("f.id").isNull()).alias("missing")).crossJoin(locked.agg((F.count(F.lit(1)) * int(unlock)).alias("unlocked")))
    return out, new_status, counters


def compare_names(stored: DataFrame, live: DataFrame) -> DataFrame:
    """``entry_va, verdict``: missing on one side, or a different name."""
    j = stored.alias("s").join(live.alias("l"), F.col("s.entry_va") == F.col("l.entry_va"), "full_outer")
    verdict = F.when(F.col("s.entry_va").isNull(), "only_live").when(F.col("l.entry_va").isNull(), "only_stored").when(F.coalesce("s.name", F.lit("")) != F.coalesce("l.name", F.lit("")), "name_differs")
    return j.select(F.coalesce("s.entry_va", "l.entry_va").alias("entry_va"), verdict.alias("verdict")).where("verdict is not null")


def export_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated text with a header, nulls empty."""
    flat = df.select([F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])
    flat.write.option("sep", "\t").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def append_events(df: DataFrame, path: str) -> None:
    """Append to a JSON-lines event log."""
    df.write.mode("append").json(path)


def generations_index(index: DataFrame, entries: DataFrame) -> DataFrame:
    """Index with ``entries`` in place of rows of the same goal and generation, in order."""
    return upsert(index, entries, ["goal_index", "generation"]).orderBy("goal_index", "generation")
