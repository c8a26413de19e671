"""Shared helpers: staged tables on the cluster's shared folder and Arrow plumbing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for staged tables: ``spark.checkpoint.dir``.  Where that is unset, one machine (tests) gets a
    temporary folder, made once for this process; on a cluster it is an error, as executors would not share one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "dir" not in _LOCAL:
            _LOCAL["dir"] = tempfile.mkdtemp(prefix="spark-")
        where = _LOCAL["dir"]
    return where.rstrip("/")


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back: lineage ends
    there, and the copy survives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def unstage(spark: SparkSession, path: str) -> None:
    """Delete the files of a table that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Bits of a filter: about BITS_A_KEY for each key, in these bounds (4 MiB at most, which may be broadcast).
BITS_A_KEY, LEAST_BITS, MOST_BITS = 16, 1 << 18, 1 << 25
#: Up to so many keys (8 MB) are broadcast.
BROADCAST_KEYS = 1_000_000


def filter_bits(keys: int) -> int:
    """A power of two of bits for the filter of so many keys."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_KEY * max(1, keys) - 1).bit_length()))


def key_filter(rows: DataFrame, column: str, bits: int, *by: str) -> DataFrame:
    """A Bloom filter with one probe as at most ``bits / 32768`` bitmap rows for each ``by``.  Full of ones it lets
    all rows pass, so its bounded size limits what it saves, never what is found."""
    at = F.pmod(F.xxhash64(column), F.lit(bits))
    rows = rows.select(*by, F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit"))
    return rows.groupBy(*by, "bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def marked(rows: DataFrame, column: str, bitmaps: DataFrame, bits: int, *by: str) -> DataFrame:
    """``rows`` with ``hit``: whether the filter lets the key pass."""
    at = F.pmod(F.xxhash64(column), F.lit(bits))
    rows = rows.withColumn("bucket", F.bitmap_bucket_number(at)).withColumn("bit", F.bitmap_bit_position(at).cast("int"))
    rows = rows.join(F.broadcast(bitmaps), [*by, "bucket"], "left")
    byte = F.conv(F.hex(F.expr("substring(bitmap, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return rows.withColumn("byte", byte).withColumn("hit", F.expr("coalesce((byte & shiftleft(1, bit % 8)) != 0, false)")).drop("bucket", "bit", "byte", "bitmap")


def among(rows: DataFrame, column: str, keys: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """``rows`` whose ``column`` is among ``keys`` (a staged table with that column).  Few keys are broadcast; of more a
    filter is, so that hardly any other rows are shuffled."""
    keys = keys.select(column).distinct()
    n = keys.count()
    if n <= most:
        return rows.join(F.broadcast(keys), column, "left_semi")
    bits = filter_bits(n)
    return marked(rows, column, key_filter(keys, column, bits), bits).where("hit").drop("hit").join(keys, column, "left_semi")


#: Rows that a Python worker holds at once, so that long texts fit.
BATCH_ROWS = 1000


def limit_batches(df: DataFrame) -> DataFrame:
    """``df``, with its session's Arrow batches held to BATCH_ROWS rows or what is set lower."""
    conf = df.sparkSession.conf
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key, "10000")) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def regrouped(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Batches of numbers put together to about ``rows`` rows, which arrays work best on."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The strings of a column, null as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df
