"""Packing documents into training windows by order-preserving dynamic programming.

Each task lays its documents' tokens end to end, in their order, and chooses where to cut them
into windows of at most ``window`` tokens.  A cut at a document's end is free, one at a sentence's
end costs little, any other costs more; a window's padding costs its tokens.  As padding is
``window - (j - i)``, the best cut before j is a sliding minimum of ``cost(i) + i``, kept in a
monotone queue.  Windows of exactly a power of two tokens need no padding and are transitions of
their own.  Tokens stream through in blocks; what lies after a block's last cut goes on to the next.
No shuffle: a task packs what it reads, at most one open window short.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import limit_batches, texts

#: Costs in tokens of padding: a cut at a sentence's end, one elsewhere, and each window.
SENTENCE_COST, HARD_COST, WINDOW_COST = 2, 24, 8
#: Elsewhere than at boundaries, cuts are tried every GRID tokens.
GRID = 64
#: Tokens that a task holds before it decides on their cuts.
BLOCK_TOKENS = 1 << 20
_SCHEMA = "row_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def padded(length: int, window: int) -> int:
    """Tokens that a sequence of ``length`` takes: itself at a power of two, else a window."""
    return length if length & (length - 1) == 0 else window


def powers(n: int) -> list[int]:
    """``n`` as a sum of powers of two, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def choose_cuts(at: np.ndarray, penalty: np.ndarray, end: int, window: int, last: bool) -> list[int]:
    """Positions of cuts, ascending, for tokens 0..end.

    ``at`` are possible cuts (ascending, within 1..end) and ``penalty`` their costs.  With ``last``
    the final cut is at ``end``; without it the remainder, under a window, is left open.
    """
    if end == 0:
        return []
    pos = [0, *at.tolist()]
    pen = [0, *penalty.tolist()]
    jump: dict[int, list[int]] = {}
    every = np.array(pos)
    size = window // 2
    while size >= max(window // 4, 1):  # free windows of half and a quarter of the size
        i = np.searchsorted(every, every - size)
        hit = np.flatnonzero((every >= size) & (every[np.minimum(i, len(every) - 1)] == every - size))
        for j, k in zip(hit.tolist(), i[hit].tolist(), strict=True):
            jump.setdefault(j, []).append(k)
        size //= 2
    n = len(pos)
    cost, came = [0.0] * n, [0] * n
    queue, value, head = [0], [0.0], 0  # indices and cost(i) + i, both ascending from head
    for j in range(1, n):
        here = pos[j]
        floor = here - window
        while pos[queue[head]] < floor:
            head += 1
        best, via = value[head] + window - here, queue[head]
        if here - pos[via] == window:
            best = cost[via]
        if j in jump:
            for k in jump[j]:
                if cost[k] < best:
                    best, via = cost[k], k
        best += pen[j] + WINDOW_COST
        cost[j], came[j] = best, via
        best += here
        while len(value) > head and value[-1] >= best:
            value.pop()
            queue.pop()
        value.append(best)
        queue.append(j)
    first = bisect_left(pos, end - window + (0 if last else 1)) if end > window else 0
    if last:
        def close(i: int) -> float:
            rest = end - pos[i]
            parts = powers(rest)
            whole = WINDOW_COST + padded(rest, window) - rest if rest else 0
            return cost[i] + min(whole, len(parts) * (WINDOW_COST + HARD_COST))

        stop = min(range(first, n), key=close)
        rest = end - pos[stop]
        tail = powers(rest)
        if rest and WINDOW_COST + padded(rest, window) - rest <= len(tail) * (WINDOW_COST + HARD_COST):
            tail = [rest]
    else:
        stop, tail = min(range(first, n), key=lambda i: cost[i] + pos[i]), []
    cuts = []
    i = stop
    while i:
        cuts.append(pos[i])
        i = came[i]
    cuts.reverse()
    at_now = pos[stop]
    for part in tail:
        at_now += part
        cuts.append(at_now)
    return cuts


class Packer:
    """Packs a stream of documents (``add``), giving pieces as they are decided."""

    def __init__(self, window: int, sentence_ends: np.ndarray, first_sequence: int = 0, block: int = BLOCK_TOKENS):
        self.window, self.block = window, max(block, 4 * window)
        self.ends = sentence_ends  # by id: whether a sentence ends there
        self.sequence = first_sequence
        self.docs: list[tuple[int | None, int, int, np.ndarray]] = []  # id, tokens before, tokens in all, rest
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        at, n = 0, len(ids)
        while at < n:  # a very long document is decided on part by part
            take = min(n - at, self.block - self.held)
            self.docs.append((doc_id, at, n, ids[at : at + take]))
            self.held += take
            at += take
            if self.held >= self.block:
                yield from self._cut(False)

    def close(self) -> Iterator[tuple]:
        yield from self._cut(True)

    def _cut(self, last: bool) -> Iterator[tuple]:
        if not self.held:
            return
        ids = np.concatenate([d[3] for d in self.docs])
        lengths = np.array([len(d[3]) for d in self.docs])
        stops = np.cumsum(lengths)
        whole = np.array([d[1] + len(d[3]) == d[2] for d in self.docs])
        penalty = np.full(len(ids) + 1, -1, dtype=np.int32)
        penalty[GRID::GRID] = HARD_COST
        penalty[np.flatnonzero(self.ends[ids]) + 1] = SENTENCE_COST
        penalty[stops[whole]] = 0
        penalty[0] = -1
        at = np.flatnonzero(penalty >= 0)
        cuts = choose_cuts(at, penalty[at], len(ids), self.window, last)
        bounds = np.array([0, *cuts])
        decided = int(bounds[-1])
        edges = np.union1d(bounds, stops[stops < decided])
        doc_at = np.searchsorted(stops, edges[:-1], side="right").tolist()
        seq_at = (np.searchsorted(bounds, edges[:-1], side="right") - 1).tolist()
        begin = (stops - lengths).tolist()
        data = np.ascontiguousarray(ids, dtype="<u4")
        for a, b, d, s in zip(edges[:-1].tolist(), edges[1:].tolist(), doc_at, seq_at, strict=True):
            doc_id, before, tokens, _ = self.docs[d]
            yield doc_id, before + a - begin[d], b - a, zlib.crc32(data[a:b]), tokens, self.sequence + s, a - int(bounds[s])
        self.sequence += len(cuts)
        rest = []
        for (doc_id, before, tokens, part), lo, hi in zip(self.docs, begin, stops.tolist(), strict=True):
            if hi > decided:
                skip = max(0, decided - lo)
                rest.append((doc_id, before + skip, tokens, part[skip:]))
        self.docs, self.held = rest, len(ids) - decided


def pack(df: DataFrame, encoder: Callable[[], "object"], end_id: int, id_col: str = "doc_id", text_col: str = "text", window: int = 4096, block: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece: ``<id_col>, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``encoder`` is called in each task and returns an object with ``ids(text) -> bytes``,
    ``sentence_ends`` and ``trim()``.  A task decides on the cuts of ``block`` tokens at a time, the best
    ones within the block; what is left open (under a window) is decided with the next block.  Every
    document's ids, then ``end_id``, lie in exactly one piece each; a
    null or empty text is ``end_id`` alone.  Sequences hold at most ``window`` tokens and are
    numbered within their task, from ``task << 32``; the order of a task's rows is kept.  Repeated
    rows and null identifiers are packed like any other; other columns are ignored; an empty table
    gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder()
        ends = np.zeros(1 << 20, dtype=bool)
        ends[list(enc.sentence_ends)] = True
        packer = Packer(window, ends, TaskContext.get().partitionId() << 32, block)
        tail = np.array([end_id], dtype="<u4").tobytes()
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(cols, names=["row_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            ids = batch.column("row_id").to_pylist()
            for doc_id, text in zip(ids, texts(batch, "body"), strict=True):
                for piece in packer.add(doc_id, np.frombuffer(enc.ids(text) + tail, dtype="<u4")):
                    rows.append(piece)
                if len(rows) >= 20_000:
                    yield out()
        rows += packer.close()
        enc.trim()
        if rows:
            yield out()

    return limit_batches(df).select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("body")).mapInArrow(run, _SCHEMA).withColumnRenamed("row_id", id_col)


def word_encoder(path: str) -> Callable[[], "object"]:
    """An encoder for ``pack`` from a word-level BPE vocabulary file."""

    def make():
        from .word_tokens import opened

        return opened(path)

    return make
