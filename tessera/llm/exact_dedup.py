"""Exact deduplication over a log-structured merge index of digests.

Only DataFrame functions run here.

1. A flush turns a table into several level-0 runs, each the memtable of a share of the tasks: its digests,
   sorted, with the identifier that stays and the number of rows.
2. Each run has a filter of one bit a digest.  When runs are merged, rows whose digest no other run can hold
   pass by without a shuffle; only the rest are grouped.  Runs of a level are compacted into one of the next as
   soon as there are ``FANOUT`` of them, and what is left is merged when the index is read.
3. Rows whose digest was met more than once (hits) are then compared byte by byte with the row that stays, so
   a digest collision can't merge different texts; rows of a very common digest are dealt out over several
   tasks for that.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filter_bits, key_filter, marked, shared_dir, stage, unstage

#: Level-0 runs of a flush, and runs of a level that are compacted into one.
FLUSH_RUNS, FANOUT = 4, 4
#: A digest with more than one in so many rows, and more than so many, is dealt out over several tasks.
HOT_SHARE, LEAST_HOT = 4096, 64
_RUN = "digest binary, keep_id long, n long"
_BLOOM = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.max.bytes": "262144"}


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row_id, digest``: SHA-256 of the text's UTF-8 bytes, null as empty."""
    return df.select(F.col(id_col).cast("long").alias("row_id"), _digest(F.col(text_col)).alias("digest"))


def _digest(text):
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


class DigestIndex:
    """Runs of ``digest, keep_id, n`` by level, under one folder that all executors share.

    ``flush`` adds level-0 runs for a table, ``compact`` merges the runs of full levels, ``entries`` reads the
    index as it stands.  ``keep`` is ``"min"`` or ``"max"``: which identifier of equal texts stays.
    """

    def __init__(self, spark: SparkSession, path: str, keep: str = "min", fanout: int = FANOUT):
        if keep not in ("min", "max"):
            raise ValueError("keep is 'min' or 'max'")
        self.spark, self.path, self.keep, self.fanout = spark, path, keep, fanout
        self.levels: list[list[tuple[str, int]]] = []  # runs of each level: path and digests

    def _pick(self, col: str):
        return (F.min if self.keep == "min" else F.max)(col)

    def _folder(self, level: int) -> str:
        return f"{self.path}/level-{level}-{uuid.uuid4().hex[:8]}"

    def _add(self, level: int, path: str, rows: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((path, rows))

    def flush(self, batch: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = FLUSH_RUNS) -> None:
        """One scan of ``batch``, its tasks dealt out over ``runs`` memtables; each is written as a sorted run."""
        rows = digests(batch, id_col, text_col).withColumn("run", F.pmod(F.spark_partition_id(), F.lit(runs)))
        tables = rows.groupBy("run", "digest").agg(self._pick("row_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        path = self._folder(0)
        tables.sortWithinPartitions("run", "digest").write.partitionBy("run").options(**_BLOOM).parquet(path)
        written = self.spark.read.schema(f"{_RUN}, run int").parquet(path)
        for r in sorted(written.groupBy("run").count().collect()):
            self._add(0, f"{path}/run={r['run']}", r["count"])

    def _read(self, runs: list[tuple[str, int]]) -> DataFrame:
        out = None
        for k, (path, _) in enumerate(runs):
            one = self.spark.read.schema(_RUN).parquet(path).withColumn("run", F.lit(k))
            out = one if out is None else out.unionByName(one)
        return self.spark.createDataFrame([], f"{_RUN}, run int") if out is None else out

    def merged(self, runs: list[tuple[str, int]]) -> tuple[DataFrame, DataFrame]:
        """Entries of several runs: those that pass by, as no other run can hold their digest, and those grouped."""
        rows = self._read(runs)
        if len(runs) < 2:
            return rows.drop("run"), rows.drop("run").limit(0)
        bits = filter_bits(max(n for _, n in runs))
        own = stage(key_filter(rows, "digest", bits, "run"), "filters")  # 4 MiB a run at most
        others = own.select(F.col("run").alias("other"), "bucket", "bitmap")
        others = F.broadcast(own.select("run", "bucket")).join(others, "bucket").where("run != other").groupBy("run", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
        found = marked(rows, "digest", others, bits, "run")
        grouped = found.where("hit").groupBy("digest").agg(self._pick("keep_id").alias("keep_id"), F.sum("n").alias("n"))
        return found.where("not hit").select("digest", "keep_id", "n"), grouped

    def entries(self) -> DataFrame:
        """One row per digest: the identifier that stays and the number of rows met."""
        alone, grouped = self.merged([r for level in self.levels for r in level])
        return alone.unionByName(grouped)

    def compact(self) -> None:
        """Merges the runs of every level that holds ``fanout`` of them into one run of the next."""
        level = 0
        while level < len(self.levels):
            while len(self.levels[level]) >= self.fanout:
                runs, self.levels[level] = self.levels[level][: self.fanout], self.levels[level][self.fanout :]
                alone, grouped = self.merged(runs)
                path = self._folder(level + 1)
                alone.unionByName(grouped).sortWithinPartitions("digest").write.options(**_BLOOM).parquet(path)
                self._add(level + 1, path, self.spark.read.schema(_RUN).parquet(path).count())
                for old, _ in runs:
                    unstage(self.spark, old)
            level += 1

    def lookup(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Rows of ``df`` whose digest the index holds: ``row_id, digest, keep_id, n``."""
        return digests(df, id_col, text_col).join(self.entries(), "digest")


def hot_digests(hits: DataFrame, rows: int, share: int = HOT_SHARE, least: int = LEAST_HOT) -> DataFrame:
    """``digest, parts`` of digests with over ``rows / share`` rows (fewer than ``share`` digests, so
    they may be broadcast) and over ``least``: in how many parts their rows are dealt out."""
    bound = max(least, rows // share)
    return hits.where(F.col("n") > bound).select("digest", F.ceil(F.col("n") / bound).cast("int").alias("parts"))


def dealt(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """``rows`` with a ``part``: 0, or one of the parts of a hot digest."""
    part = F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("parts")), F.lit(0)).cast("int")
    return rows.join(F.broadcast(hot), "digest", "left").withColumn("part", part).drop("parts")


def in_all_parts(entries: DataFrame, hot: DataFrame) -> DataFrame:
    """``entries`` (about one row a digest) once for each part of its digest."""
    part = F.explode(F.expr("sequence(0, coalesce(parts, 1) - 1)"))
    return entries.join(F.broadcast(hot), "digest", "left").withColumn("part", part).drop("parts")


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per input row: ``<id_col>, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their bytes are; null equals the empty text.  Of equal texts the row
    with the largest (or smallest) identifier stays.  A null identifier stays only if the whole
    group has none, and then ``kept`` is true for all of it, as it is for rows repeated with the
    identifier that stays.  Other columns, whatever their names, are ignored.  An empty table
    gives an empty result.
    """
    spark = df.sparkSession
    df = df.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("body"))
    index = DigestIndex(spark, f"{shared_dir(spark)}/tessera/digests-{uuid.uuid4().hex}", keep)
    index.flush(df, "row_id", "body")
    index.compact()
    entries = stage(index.entries(), "entries")
    unstage(spark, index.path)
    single = entries.where("n = 1").select(
        F.col("keep_id").alias("row_id"), "keep_id", F.col("n").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))

    hits = entries.where("n > 1").select("digest", "keep_id", "n")
    hot = hot_digests(hits, int(entries.agg(F.sum("n")).first()[0] or 0))
    body = F.coalesce(F.col("body"), F.lit(""))
    bits = filter_bits(hits.count())
    rows = df.select("row_id", body.alias("body"), _digest(F.col("body")).alias("digest"))
    passed = marked(rows, "digest", key_filter(hits, "digest", bits), bits).where("hit").drop("hit")
    members = stage(dealt(passed, hot).join(in_all_parts(hits.drop("n"), hot), ["digest", "part"]), "members")
    keepers = members.where(F.col("row_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("body").alias("keep_body"))
    # null where the bytes agree, which without a collision is everywhere
    apart = F.when(F.col("body") == F.col("keep_body"), F.lit(None).cast("string")).otherwise(F.col("body"))
    verified = stage(members.join(in_all_parts(keepers, hot), ["digest", "part"]).select("row_id", "digest", "part", apart.alias("apart")), "verified")
    unstage(spark, members.staged_path)
    pick = F.min if keep == "min" else F.max
    groups = in_all_parts(verified.groupBy("digest", "apart").agg(pick("row_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), hot)
    v, g = verified.alias("v"), groups.alias("g")
    same = (F.col("v.digest") == F.col("g.digest")) & (F.col("v.part") == F.col("g.part")) & F.col("v.apart").eqNullSafe(F.col("g.apart"))
    several = v.join(g, same).select(
        F.col("v.row_id").alias("row_id"), F.col("g.keep_id").alias("keep_id"), F.col("g.group_size").alias("group_size"),
        F.col("v.row_id").eqNullSafe(F.col("g.keep_id")).alias("kept"), F.lower(F.hex("v.digest")).alias("text_sha256"))
    return single.unionByName(several).withColumnRenamed("row_id", id_col)
