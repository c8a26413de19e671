"""Tables of the rounds of an iterative operator, which go when the operator is done."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.operators.graph import kept, shared_folder


class Rounds:
    """Tables in a folder of their own on the cluster's shared folder.

    Logs are only appended to, a round at a time, and read as one table; so a round writes what it changed.
    ``with Rounds(spark, name) as r:`` deletes the folder at the end, after results have been written by
    ``graph.kept``.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.schemas: dict[str, object] = {}
        self.grew = False
        self.total = 0

    def __enter__(self) -> Rounds:
        return self

    def __exit__(self, *_: object) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a table of this round."""
        return kept(df, name, self.folder)

    def append(self, df: DataFrame, log: str, counts: str = "true", of: str = "0") -> DataFrame:
        """``df`` added to a log; what was added, as a table.  ``grew`` says whether that was any row that ``counts``, and ``total`` what
        ``of`` sums to over all rows."""
        self.schemas[log] = df.schema
        rows = Observation()
        added = kept(df.observe(rows, F.count_if(F.expr(counts)).alias("n"), F.sum(F.expr(of)).alias("total")), "part", f"{self.folder}/{log}")
        self.grew, self.total = bool(rows.get["n"]), rows.get["total"] or 0
        return added

    def log(self, log: str) -> DataFrame:
        """All that was added to a log."""
        return self.spark.read.schema(self.schemas[log]).parquet(f"{self.folder}/{log}/part-*")
