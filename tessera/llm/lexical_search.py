"""Ranked lexical search: a document-at-a-time merge of compressed postings, shard by shard.

1. The query items' terms are the vocabulary, taken in blocks of bounded size.
2. Each task inverts its own documents, a shard of bounded size at a time: sorted by identifier, every
   term's postings (gaps between documents, frequencies) packed into bytes of seven bits.
3. Documents, lengths and frequencies of terms are summed over all shards and give the weights.
4. Every shard is searched by itself.  A heap holds the next document of each of an item's lists; the lists
   that together can't lift a document over the worst of the best so far leave that heap and are only looked
   into.  A bounded heap keeps the shard's best, by score and then identifier.
5. The shards' best are merged, cut down in each task before they are shuffled.

All numbers but the logarithm are 64-bit integers, so every order of adding gives the same scores.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import limit_batches, stage

#: A shard ends at so many documents or bytes of text.
SHARD_DOCS, SHARD_BYTES = 8192, 1 << 26
#: Pairs of item and term that a block of items has at most on average, as they are sent to all tasks.
BLOCK_PAIRS = 500_000
#: Letters and digits of ASCII (capitals as small letters) and all other characters from 0x80 are terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Stands for a shard's list of documents where a term stands for the others.
_DOCS = -1


def terms(text: str | None) -> list[bytes]:
    """Terms of a text in order, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers, seven bits a byte, the lowest first."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), dtype=np.int64)
    for k in range(1, 10):
        size += v >= np.uint64(1 << 7 * k)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), dtype=np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[at[has] + k] = (v[has] >> np.uint64(7 * k)) & np.uint64(127) | (size[has] > k + 1).astype(np.uint64) << np.uint64(7)
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    """The integers that ``pack`` was given."""
    b = np.frombuffer(data, dtype=np.uint8)
    if not len(b):
        return np.zeros(0, dtype=np.uint64)
    ends = np.flatnonzero(b < 128)
    at = np.concatenate(([0], ends[:-1] + 1))
    shift = np.arange(len(b)) - np.repeat(at, ends - at + 1)
    return np.add.reduceat((b & 127).astype(np.uint64) << (7 * shift).astype(np.uint64), at)


class _Shard:
    """Documents of one shard as they come, and their index rows."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.tf: list[list[tuple[int, int]]] = []
        self.held = 0

    def add(self, doc_id: int | None, text: str | None, vocabulary: dict[bytes, int]) -> None:
        words = terms(text)
        if words:
            self.ids.append(doc_id)
            self.sizes.append(len(words))
            self.tf.append([(vocabulary[t], n) for t, n in Counter(words).items() if t in vocabulary])
        self.held += len(text or "")

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or self.held >= SHARD_BYTES

    def rows(self, shard: int) -> pa.RecordBatch:
        """A row of documents and a row for every term; those without identifier only count."""
        named = sorted((i for i, x in enumerate(self.ids) if x is not None), key=lambda i: self.ids[i])
        ids = np.array([self.ids[i] for i in named], dtype=np.int64).view(np.uint64)
        lengths = np.array([self.sizes[i] for i in named], dtype=np.uint64)
        data = [pack(np.concatenate((np.diff(ids, prepend=np.uint64(0)), lengths)))]
        df = Counter(t for doc in self.tf for t, _ in doc)
        place, term, tf = (np.array(x, dtype=np.int64) for x in zip(*((at, t, n) for at, i in enumerate(named) for t, n in self.tf[i]), strict=True)) if any(self.tf[i] for i in named) else (np.zeros(0, dtype=np.int64),) * 3
        order = np.argsort(term, kind="stable")
        known = sorted(df)
        bounds = np.searchsorted(term[order], [*known, 1 << 62])
        for a, b in zip(bounds, bounds[1:], strict=False):
            own = order[a:b]
            data.append(pack(np.concatenate((np.diff(place[own], prepend=0), tf[own]))))
        n = len(data)
        return pa.RecordBatch.from_pydict({"shard": pa.array([shard] * n, pa.int64()), "term": pa.array([_DOCS, *known], pa.int32()), "docs": pa.array([len(self.ids), *(df[t] for t in known)], pa.int64()), "total": pa.array([sum(self.sizes), *[0] * len(known)], pa.int64()), "data": pa.array(data, pa.binary())})


def build_index(docs: DataFrame, vocabulary: Broadcast, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Index rows ``shard, term, docs, total, data`` of all documents for the terms of ``vocabulary`` (term to
    number).  Term -1 has a shard's documents with terms, the total of their terms and the packed list."""

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number, shard = vocabulary.value, TaskContext.get().partitionId() << 32, _Shard()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard.add(doc_id, text.as_py(), known)
                if shard.full():
                    yield shard.rows(number)
                    number, shard = number + 1, _Shard()
        if shard.ids:
            yield shard.rows(number)

    return limit_batches(docs).select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(invert, "shard long, term int, docs long, total long, data binary")


def merge(lists: list[tuple[int, list[int], list[int]]], k: int) -> list[tuple[int, int]]:
    """``(score, document)`` of the ``k`` best with a score above 0; equal scores keep the smaller document.

    A list is its largest score, its documents in ascending order and their scores.
    """
    lists = sorted(lists, key=lambda x: x[0])
    reach = np.cumsum([x[0] for x in lists], dtype=np.int64).tolist()
    at = [0] * len(lists)
    heap = [(x[1][0], i) for i, x in enumerate(lists)]
    heapify(heap)
    best: list[tuple[int, int]] = []
    floor = first = 0
    while first < len(lists) and reach[first] <= floor:
        first += 1
    while heap and first < len(lists):
        doc, score = heap[0][0], 0
        while heap and heap[0][0] == doc:
            i = heap[0][1]
            if i < first:
                heappop(heap)
                continue
            _, where, scores = lists[i]
            score += scores[at[i]]
            at[i] += 1
            if at[i] < len(where):
                heapreplace(heap, (where[at[i]], i))
            else:
                heappop(heap)
        for i in range(first - 1, -1, -1):
            if score + reach[i] <= floor:
                break
            _, where, scores = lists[i]
            at[i] = bisect_left(where, doc, at[i])
            if at[i] < len(where) and where[at[i]] == doc:
                score += scores[at[i]]
        if score <= floor:
            continue
        if len(best) < k:
            heappush(best, (score, -doc))
        else:
            heapreplace(best, (score, -doc))
        if len(best) == k:
            floor = best[0][0]
            while first < len(lists) and reach[first] <= floor:
                first += 1
    return [(score, -doc) for score, doc in sorted(best, reverse=True)]


def search_shard(rows: pa.Table, items: dict[int, list[int]], weights: dict[int, int], docs: int, total: int, k: int) -> pa.Table:
    """The best documents of one shard for every item."""
    packed = dict(zip(rows.column("term").to_pylist(), rows.column("data").to_pylist(), strict=True))
    ids, lengths = np.split(unpack(packed.pop(_DOCS)), 2)
    ids = np.cumsum(ids, dtype=np.uint64).view(np.int64)
    norm = 50 + 50 * lengths.astype(np.int64) * docs // total
    lists = {}
    for term, data in packed.items():
        gaps, tf = np.split(unpack(data).astype(np.int64), 2)
        if len(tf):
            where = np.cumsum(gaps)
            scores = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * norm[where]))
            lists[term] = int(scores.max()), where.tolist(), scores.tolist()
    found = [(item, int(ids[doc]), score) for item, known in items.items() for score, doc in merge([lists[t] for t in known if t in lists], k)]
    item, doc, score = zip(*found, strict=True) if found else ((), (), ())
    return pa.table({"item_id": pa.array(item, pa.int64()), "doc_id": pa.array(doc, pa.int64()), "score": pa.array(score, pa.int64())})


def _weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def _search_block(docs: DataFrame, pairs: list, k: int, id_col: str, text_col: str) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    vocabulary = {t: i for i, t in enumerate(sorted({bytes(r["term"]) for r in pairs}))}
    items: dict[int, list[int]] = {}
    for r in pairs:
        items.setdefault(r["item_id"], []).append(vocabulary[bytes(r["term"])])
    known = sc.broadcast(vocabulary)
    index = stage(build_index(docs, known, id_col, text_col), "postings")
    known.destroy()
    counts = {r["term"]: r for r in index.groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("total").alias("total")).collect()}
    n, total = (counts[_DOCS]["docs"], counts[_DOCS]["total"]) if counts else (0, 0)
    sent = sc.broadcast((items, {t: _weight(n, r["docs"]) for t, r in counts.items() if t != _DOCS}))
    return index.groupBy("shard").applyInArrow(lambda rows: search_shard(rows, *sent.value, n, total, k), "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """``item_id, rank, doc_id, score``: for each item (``item_id, text``) the ``k`` documents of highest score above 0.

    Terms are the longest runs of letters, digits and characters outside ASCII; only A-Z is lower-cased.  A null
    text has no terms.  Of equal scores the smaller identifier comes first.  Rows without identifier count
    in the statistics and aren't returned; rows that repeat an identifier are documents of their own.  Items without
    identifier are none, and rows that repeat an item's identifier are one item with the terms of all.  Other
    columns are ignored; without documents or items the result is empty.  The items are the query set: their
    terms go to all tasks, in blocks of about ``block_pairs``.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(i, t) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t in set(terms(text))]
            yield pa.RecordBatch.from_pydict({"item_id": pa.array([i for i, _ in pairs], pa.int64()), "term": pa.array([t for _, t in pairs], pa.binary())})

    asked = items.where("item_id is not null").select(F.col("item_id").cast("long"), "text").mapInArrow(split, "item_id long, term binary").distinct()
    asked = stage(asked, "item-terms")
    blocks = -(-asked.count() // block_pairs)
    block = F.pmod(F.xxhash64("item_id"), F.lit(max(1, blocks)))
    found = [_search_block(docs, asked.where(block == b).collect(), k, id_col, text_col) for b in range(max(1, blocks))]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
