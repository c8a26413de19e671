"""Product codes of vectors in exact integers, assigned by partial-distance search.

Components become integers, vectors are cut into equal parts, and every part position has a codebook that starts
as the parts of the first vectors and is moved to the floored means of what is assigned to it, for a fixed number
of rounds.  A task keeps sums and counts for each entry, so a round leaves at most ``parts * entries`` rows a task
and the same number, summed, on the driver.

Assignment takes dimensions in descending variance of the codebook.  After the first, the nearest entry so far is
measured completely; a mask drops every pair of row and entry whose partial distance strictly exceeds that, and later
dimensions are added for the pairs that are left.  Whatever is dropped is farther than a complete distance, so the
result is that of measuring all entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import regrouped, stage

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integers that squared distances of 64 bits have room for.
_LIMIT = 1 << 28
#: Rows that are compared at once.
_CHUNK = 4096
#: Up to so many labels' sums are broadcast.
BROADCAST_LABELS = 100_000


def usable(vector: Column) -> Column:
    """Whether a vector isn't null and holds neither nulls nor components that aren't finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def integers(column: pa.Array, width: int, scale: int = SCALE) -> np.ndarray:
    """Rows of ``floor(scale * x)``."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    out = np.floor(scale * values)
    if len(out) and np.abs(out).max() > _LIMIT:
        raise ValueError(f"components over {_LIMIT // scale} have no exact 64-bit distances")
    return out.astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest row of ``book`` for every row of ``x`` (ties: the lower), and its squared distance."""
    index, distance = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
    if not x.shape[1]:
        return index, distance
    dims = np.argsort(-book.astype(np.float64).var(axis=0), kind="stable")
    for at in range(0, len(x), _CHUNK):
        part = x[at : at + _CHUNK]
        partial = (part[:, dims[0], None] - book[None, :, dims[0]]) ** 2
        best = ((part - book[partial.argmin(axis=1)]) ** 2).sum(axis=1)
        row, entry = np.nonzero(partial <= best[:, None])
        far = partial[row, entry]
        for d in dims[1:]:
            far = far + (part[row, d] - book[entry, d]) ** 2
            left = far <= best[row]
            row, entry, far = row[left], entry[left], far[left]
        # rows and entries are in ascending order, and every row has its measured entry at least
        starts = np.searchsorted(row, np.arange(len(part)))
        least = np.minimum.reduceat(far, starts)
        won = np.where(far == least[row], entry, len(book))
        index[at : at + len(part)], distance[at : at + len(part)] = np.minimum.reduceat(won, starts), least
    return index, distance


def _moved(rows: DataFrame, books: np.ndarray, width: int) -> np.ndarray:
    """Codebooks after one round: every entry at the floored mean of its parts; unused entries stay."""
    parts, entries, size = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), dtype=np.int64), np.zeros(books.shape, dtype=np.int64)
        for batch in regrouped(batches, 1 << 14):
            x = integers(batch.column("vector"), width)
            for p in range(parts):
                own = x[:, p * size : (p + 1) * size]
                index, _ = nearest(own, books[p])
                count[p] += np.bincount(index, minlength=entries)
                np.add.at(total[p], index, own)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_pydict({"part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "n": pa.array(count[p, e], pa.int64()), "sums": pa.array(total[p, e].tolist(), pa.list_(pa.int64()))})

    tall = rows.select("vector").mapInArrow(sums, "part int, entry int, n long, sums array<long>")
    added = tall.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(size)])
    out = books.copy()
    for r in added.collect():
        out[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(size)]
    return out


def checksum(books: np.ndarray) -> str:
    """SHA-256 of all entries' components in order, in decimal, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def fit(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks ``[part, entry, component]`` of usable rows (``vec_id, vector``)."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).toArrow()
    books = np.ascontiguousarray(integers(first.column("vector").combine_chunks(), width).reshape(-1, parts, width // parts).swapaxes(0, 1))
    for _ in range(rounds):
        books = _moved(rows, books, width)
    return books


def encode(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every usable vector, under the given names of columns.

    Vectors that are null, empty, hold null or non-finite components, or whose length isn't that of the usable vector with the
    smallest identifier (a multiple of ``parts``) are left out.  Codebooks start from the ``entries`` smallest identifiers
    (all, if fewer; rows without identifier come last, ties by vector).  Rows that repeat an identifier are coded each for itself.
    Null labels are summed together.  Other columns are ignored; an empty table gives an empty result.  Components
    of over a million in size are an error, as distances must fit 64 bits.
    """
    names = [F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label")]
    rows = df.where(usable(F.col(vector_col))).select(*names).where((F.size("vector") > 0) & (F.size("vector") % parts == 0))
    head = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select(F.size("vector").alias("n")).first()
    width = head["n"] if head else parts
    rows = rows.where(F.size("vector") == width)
    books = fit(rows, width, parts, entries, rounds) if head else np.zeros((parts, 0, 1), dtype=np.int64)
    size = width // parts

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in regrouped(batches, 1 << 14):
            x = integers(batch.column("vector"), width)
            code, error = np.zeros((len(x), parts), dtype=np.uint8), np.zeros(len(x), dtype=np.int64)
            for p in range(parts):
                code[:, p], far = nearest(x[:, p * size : (p + 1) * size], books[p])
                error += far
            text = code.tobytes().hex()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    kind = dict(df.dtypes)[label_col]
    coded = stage(rows.mapInArrow(codes, f"vec_id long, label {kind}, code string, error long"), "codes")
    sums = coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    if sums.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("of_label")))
    return out.select(F.col("vec_id").alias(id_col), "code", "error", "label_error", F.lit(checksum(books)).alias("codebooks_sha256"))
