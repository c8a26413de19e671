"""Chroma fingerprints of recordings and their alignment.

A recording is a sequence of pitch-class frames (12 energies each).  Filters compare areas of a
16-frame window through an integral image; 16 filters at two bits each pack into one 32-bit integer
a frame.  Two recordings are aligned by the histogram of offsets at which their integers are equal;
at every offset with enough votes the stretches that hold equal integers are judged by their bit errors.

Search holds a stated set of query recordings, in blocks of bounded size, against all recordings.
Queries of equal fingerprints are one class.  Of more than one block, none passes through the driver: recordings are dealt out
over parts, and each part's task holds its recordings while the blocks pass through it one after the other.  There a
recording's integers are looked up among the block's, so a very common passage costs its matches in the task that reads
it.  ``linked`` reduces what a recording matches in a block to one row before anything leaves the task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import limit_batches, stage
from .exact_dedup import dealt, hot_digests, in_all_parts

#: Frames that a filter looks at, and pitch classes.
WINDOW, CLASSES = 16, 12
#: Filters: (kind, first pitch class, classes, frames), generated in turn over kinds and sizes.
FILTERS = [(k % 6, (5 * k) % (CLASSES - h + 1), h, w) for k, (h, w) in enumerate([(12, 16), (6, 16), (4, 12), (3, 8), (8, 16), (6, 12), (4, 16), (2, 8), (12, 8), (6, 8), (3, 16), (9, 12), (4, 8), (8, 12), (6, 4), (3, 12)])]
#: A filter's response, the logarithm of a ratio of areas, is cut at these into two bits.
CUTS = (-0.12, 0.0, 0.12)
_GRAY = np.array([0, 1, 3, 2], dtype=np.uint32)
#: A stretch needs so many equal integers at one offset and so many integers in all (fewer where a recording
#: has fewer), at most this share of bits wrong, and ends where no more integers follow that are equal within GAP.
MIN_VOTES, MIN_OVERLAP, MAX_ERROR, GAP = 6, 16, 0.25, 32
#: Integers of queries that each task holds at once.
BLOCK_INTEGERS = 1 << 21
#: Found rows that leave a task at a time.
PART_ROWS = 4096
#: Integers of rows (64 MB) that a task holds while blocks of queries pass through it.
PART_INTEGERS = 1 << 24
_CHUNK = 1 << 18
#: Windows that are filtered, integers that are looked up and matches of theirs that are counted at a time, so that they stay
#: in a core's cache.
_WINDOWS, _LOOKED_UP, _MATCHES = 1 << 14, 1 << 16, 1 << 17


def text_frames(text: str) -> np.ndarray:
    """A text as a recording: each word sounds for a frame, each of its characters in the pitch
    class of its code point.  Equal passages sound equal."""
    words = text.split()
    if not words:
        return np.zeros((0, CLASSES))
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
    return np.bincount(owner * CLASSES + codes % CLASSES, minlength=len(words) * CLASSES).reshape(-1, CLASSES).astype(np.float64)


def pcm_frames(samples: np.ndarray, sample_rate: int = 11025, size: int = 4096, hop: int = 1365, low: float = 28.0, high: float = 3520.0) -> np.ndarray:
    """Pitch-class energies of mono samples: spectra of Hann windows folded by octave (A is class 0),
    each frame divided by its length."""
    n = max(0, (len(samples) - size) // hop + 1)
    freq = np.fft.rfftfreq(size, 1 / sample_rate)
    use = np.flatnonzero((freq >= low) & (freq <= high))
    note = np.round(12 * np.log2(freq[use] / 440.0)).astype(np.int64) % CLASSES
    fold = np.zeros((len(use), CLASSES))
    fold[np.arange(len(use)), note] = 1
    out = np.zeros((n, CLASSES))
    shape = np.hanning(size)
    for k in range(n):
        power = np.abs(np.fft.rfft(samples[k * hop : k * hop + size] * shape))[use] ** 2
        out[k] = power @ fold
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def fingerprint(frames: np.ndarray) -> np.ndarray:
    """One packed integer for each frame that starts a whole window.  A recording shorter than a window is played
    again and again until it fills as many windows as a stretch needs, so it is found by its equals and nearly equals."""
    if 0 < len(frames) < WINDOW:
        frames = frames[np.arange(WINDOW + MIN_OVERLAP - 1) % len(frames)]
    n = len(frames) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint32)
    out = np.empty(n, dtype=np.uint32)
    for at in range(0, n, _CHUNK):
        to = min(n, at + _CHUNK)
        image = np.zeros((CLASSES + 1, to - at + WINDOW))
        np.cumsum(np.cumsum(frames[at : to + WINDOW - 1].T, axis=1), axis=0, out=image[1:, 1:])
        for first in range(0, to - at, _WINDOWS):
            many = min(_WINDOWS, to - at - first)
            out[at + first : at + first + many] = _pack(image[:, first : first + many + WINDOW], many)
    return out


def fingerprint_all(recordings: list[np.ndarray]) -> list[np.ndarray]:
    """``fingerprint`` of each.  Recordings of whole energies, whose sums are exact, are joined to one and cut again."""
    long = [r[np.arange(WINDOW + MIN_OVERLAP - 1) % len(r)] if 0 < len(r) < WINDOW else r for r in recordings]
    out = [np.zeros(0, dtype=np.uint32)] * len(long)
    joined: list[int] = []
    held = 0

    def cut() -> None:
        ends = np.cumsum([len(long[k]) for k in joined]).tolist()
        found = fingerprint(np.concatenate([long[k] for k in joined]))
        for k, end in zip(joined, ends, strict=True):
            out[k] = found[end - len(long[k]) : end - WINDOW + 1]

    for k, frames in enumerate(long):
        if len(frames) < WINDOW:
            continue
        # the sum of all that is joined stays exact
        if len(frames) < _CHUNK and frames.max() < 2**31 and (frames == np.floor(frames)).all():
            joined.append(k)
            held += len(frames)
            if held >= _CHUNK // 4:
                cut()
                joined, held = [], 0
        else:
            out[k] = fingerprint(frames)
    if joined:
        cut()
    return out


def _least_ratio(cut: float) -> float:
    """The least ratio whose logarithm reaches ``cut``."""
    x = np.exp(cut)
    while np.log(x) >= cut:
        x = np.nextafter(x, 0.0)
    while np.log(x) < cut:
        x = np.nextafter(x, 9.0)
    return float(x)


_RATIOS = [_least_ratio(c) for c in CUTS]


def _pack(image: np.ndarray, n: int) -> np.ndarray:
    def area(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        return image[c1, t1 : t1 + n] - image[c1, t0 : t0 + n] - image[c0, t1 : t1 + n] + image[c0, t0 : t0 + n]

    packed = np.zeros(n, dtype=np.uint32)
    for kind, y, h, w in FILTERS:
        whole = area(0, w, y, y + h)
        if kind == 0:  # against the mean of the whole window
            a, b = whole, area(0, WINDOW, 0, CLASSES) * (h * w / (WINDOW * CLASSES))
            if h == CLASSES and w == WINDOW:  # which that filter would be itself: its first half
                a, b = area(0, w // 2, y, y + h), whole / 2
        elif kind == 1:  # upper and lower classes
            a = area(0, w, y, y + h // 2)
            b = whole - a
        elif kind == 2:  # earlier and later frames
            a = area(0, w // 2, y, y + h)
            b = whole - a
        elif kind == 3:  # diagonal quarters
            a = area(0, w // 2, y, y + h // 2) + area(w // 2, w, y + h // 2, y + h)
            b = whole - a
        elif kind == 4:  # middle classes and the others
            a = area(0, w, y + h // 3, y + h - h // 3)
            b = (whole - a) * ((h - 2 * (h // 3)) / max(1, 2 * (h // 3)))
        else:  # middle frames and the others
            a = area(w // 4, w - w // 4, y, y + h)
            b = whole - a
        ratio = (1 + np.maximum(a, 0)) / (1 + np.maximum(b, 0))
        level = (ratio >= _RATIOS[0]).view(np.uint8) + (ratio >= _RATIOS[1]).view(np.uint8) + (ratio >= _RATIOS[2]).view(np.uint8)
        packed = (packed << np.uint32(2)) | _GRAY[level]
    return packed


Stretch = tuple[int, int, int, int, float]  # query, offset, votes, overlap, share of bits wrong


def stretches(a: np.ndarray, b: np.ndarray, offset: int, gap: int = GAP, votes: int = 1, overlap: int = 1) -> Iterator[tuple[int, int, float]]:
    """``(votes, integers, share of bits wrong)`` of each stretch where ``b[i]`` lies on ``a[i + offset]``,
    from one equal integer to another with no more than ``gap`` places between neighbours; those with fewer
    votes or integers are left out."""
    lo, hi = max(0, -offset), min(len(b), len(a) - offset)
    if hi <= lo:
        return
    over, under = a[lo + offset : hi + offset], b[lo:hi]
    equal = np.flatnonzero(over == under)
    if len(equal) < max(1, votes):
        return
    at = 0
    for end in [*(np.flatnonzero(equal[1:] - equal[:-1] > gap) + 1).tolist(), len(equal)]:
        first, last = int(equal[at]), int(equal[end - 1])
        n = last - first + 1
        if end - at >= votes and n >= overlap:
            yield end - at, n, int(np.bitwise_count(over[first : last + 1] ^ under[first : last + 1]).sum(dtype=np.int64)) / (32 * n)
        at = end


def _starts(values: np.ndarray) -> np.ndarray:
    """Places where a run of one integer begins: a held tone votes once."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, dtype=np.int64)


_MIX, _ROW_MIX, _KEY_MIX = np.uint32(0x9E3779B1), np.int64(0x165667B19E3779F9), np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.int64(1 << 31)


class QueryBlock:
    """Query fingerprints, their integers in one table: sorted by a one-to-one hash, whose first bits say where to look."""

    def __init__(self, prints: list[np.ndarray]):
        self.prints = prints
        places = [_starts(p) for p in prints]
        self.runs = np.array([len(p) for p in places], dtype=np.int64)
        hashed = np.concatenate([*(p[x] for p, x in zip(prints, places, strict=True)), np.zeros(0, dtype=np.uint32)]) * _MIX
        owner = np.repeat(np.arange(len(prints)), self.runs)
        place = np.concatenate([*places, np.zeros(0, dtype=np.int64)])
        order = np.argsort(hashed, kind="stable")
        self.hashed, self.keys = hashed[order], (owner[order].astype(np.int64) << np.int64(32)) + place[order]
        bits = min(24, len(hashed).bit_length() + 1)
        self.drop = np.uint32(32 - bits)
        self.first = np.append(0, np.cumsum(np.bincount(hashed >> self.drop, minlength=1 << bits))).astype(np.int32)

    def search(self, own: np.ndarray, votes: int = MIN_VOTES, overlap: int = MIN_OVERLAP, error: float = MAX_ERROR) -> Iterator[Stretch]:
        """The best stretch of each query that aligns with ``own``: fewest bits wrong, then longest,
        then smallest offset."""
        for _, found in self.search_all([own], votes, overlap, error):
            yield from found

    def search_all(self, rows: list[np.ndarray], votes: int = MIN_VOTES, overlap: int = MIN_OVERLAP, error: float = MAX_ERROR) -> Iterator[tuple[int, list[Stretch]]]:
        """The number of each row that aligns with any query, and what ``search`` finds for it."""
        if not len(self.hashed):
            return
        ends = np.cumsum([len(r) for r in rows])
        start = 0
        while start < len(rows):  # a bounded number of integers at a time
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + _LOOKED_UP, side="right")))
            for k, keys, totals, runs in self._votes(rows[start:stop], votes):
                found = list(self._judged(rows[start + k], keys, totals, runs, votes, overlap, error))
                if found:
                    yield start + k, found
            start = stop

    def _votes(self, rows: list[np.ndarray], votes: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """Of each row that has any: its number, its keys (query and offset) that may have enough equal integers, how many
        each has, and the row's runs."""
        own, sizes = np.concatenate(rows), np.array([len(r) for r in rows], dtype=np.int64)
        if not len(own):
            return
        first = np.cumsum(sizes) - sizes
        starts = np.append(True, own[1:] != own[:-1])
        starts[first[sizes > 0]] = True
        at = np.flatnonzero(starts)
        row = np.repeat(np.arange(len(rows)), sizes)[at]
        place, hashed, runs = at - first[row], own[at] * _MIX, np.bincount(row, minlength=len(rows))
        cell = (hashed >> self.drop).astype(np.int64)
        low = self.first[cell]
        many = self.first[cell + 1] - low
        hit = np.flatnonzero(many)
        row, place, hashed, low, many = row[hit], place[hit], hashed[hit], low[hit], many[hit]
        cum = np.append(0, np.cumsum(many))
        edge = np.searchsorted(row, np.arange(len(rows) + 1))
        reached = cum[edge]
        asks, gives = np.minimum(votes, self.runs), np.minimum(votes, runs)
        short, shorter = bool((asks < votes).any()), bool((gives < votes).any())
        apart = row * _ROW_MIX - place

        def entries(at: int, to: int) -> np.ndarray:
            w = many[at:to]
            return np.repeat(low[at:to] - cum[at:to] + cum[at], w) + np.arange(int(cum[to] - cum[at]))

        def matches(m: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            same = self.hashed[m] == hashed[by]
            by = by[same]
            return self.keys[m[same]] - place[by] + _SHIFT, row[by]

        k = 0
        while k < len(rows):
            at = int(edge[k])
            # as many rows as have a bounded number of matches
            last = max(k + 1, int(np.searchsorted(reached, cum[at] + _MATCHES, side="right")) - 1)
            to = int(edge[last])
            if cum[to] - cum[at] > _CHUNK:  # one row with more: a bounded number of its matches at a time
                keys, counts = [], []
                while at < to:
                    end = min(to, max(at + 1, int(np.searchsorted(cum, cum[at] + _CHUNK, side="right")) - 1))
                    key, count = np.unique(matches(entries(at, end), np.repeat(np.arange(at, end), many[at:end]))[0], return_counts=True)
                    keys.append(key)
                    counts.append(count)
                    at = end
                key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
                yield k, key, np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64), int(runs[k])
            elif to > at:
                m, w = entries(at, to), many[at:to]
                key = self.keys[m]
                # a slot holds all matches of its keys, so one with too few has no key with enough; other integers
                # of a cell, which only add to that, are left out of what stays
                bits = np.uint64(64 - max(10, len(m).bit_length()))
                slot = (((key + np.repeat(apart[at:to], w)).view(np.uint64) * _KEY_MIX) >> bits).view(np.int64)
                count = np.bincount(slot)[slot]
                stay = count >= votes
                if short:
                    stay |= count >= asks[key >> np.int64(32)]
                if shorter:
                    stay |= count >= np.repeat(gives[row[at:to]], w)
                left = np.flatnonzero(stay)
                key, of = matches(m[left], np.searchsorted(cum, left + cum[at], side="right") - 1)
                parts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, dtype=np.int64)
                for a, b in zip(parts.tolist(), [*parts[1:].tolist(), len(of)], strict=False):
                    yield (int(of[a]), *np.unique(key[a:b], return_counts=True), int(runs[of[a]]))
            k = last

    def _judged(self, own: np.ndarray, key: np.ndarray, total: np.ndarray, runs: int, votes: int, overlap: int, error: float) -> Iterator[Stretch]:
        query = key >> np.int64(32)
        # a stretch's equal integers all lie at its offset, so too few there are too few in any stretch
        enough = total >= np.minimum(votes, np.minimum(self.runs[query], runs))
        best: dict[int, tuple[float, int, int, int]] = {}
        for q, o in zip(query[enough].tolist(), ((key[enough] & np.int64(0xFFFFFFFF)) - _SHIFT).tolist(), strict=True):
            a = self.prints[q]
            least = min(len(a), len(own))
            for v, n, wrong in stretches(a, own, o, votes=min(votes, least), overlap=min(overlap, least)):
                if wrong <= error:
                    found = (wrong, -n, o, v)
                    if q not in best or found < best[q]:
                        best[q] = found
        for q, (wrong, n, o, v) in best.items():
            yield q, o, v, -n, wrong


def _some(recordings: Iterable[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Recordings by the dozen or more, so that no more than the frames of a few long ones are held."""
    held: list[np.ndarray] = []
    n = 0
    for frames in recordings:
        held.append(frames)
        n += len(frames)
        if n >= _LOOKED_UP:
            yield held
            held, n = [], 0
    if held:
        yield held


_PRINTS = "uid long, row_id long, n long, digest binary, print binary"


def fingerprints(df: DataFrame, id_col: str = "doc_id", source_col: str = "text", frames: Callable[[object], np.ndarray] = text_frames) -> DataFrame:
    """``uid, row_id, n, digest, print`` of every row as a staged table: a number of the row, the
    number of its integers, their 128-bit digest and the integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            made: list[np.ndarray] = []
            for some in _some(frames(x) if x is not None else np.zeros((0, CLASSES)) for x in batch.column("source").to_pylist()):
                made += fingerprint_all(some)
            data = [p.tobytes() for p in made]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(uid, uid + len(made)), pa.int64()), batch.column("row_id"), pa.array([len(p) for p in made], pa.int64()), pa.array([xxhash.xxh3_128_digest(d) for d in data], pa.binary()), pa.array(data, pa.binary())],
                names=["uid", "row_id", "n", "digest", "print"])
            uid += len(made)

    rows = limit_batches(df).select(F.col(id_col).cast("long").alias("row_id"), F.col(source_col).alias("source"))
    return stage(rows.mapInArrow(run, _PRINTS), "fingerprints")


def _query_classes(prints: DataFrame, is_query: Callable[[Column], Column]) -> DataFrame:
    """``digest, low, high, ids, n, print``: queries of one fingerprint with their smallest and largest
    identifier and the number of identifiers."""
    rows = prints.where(is_query(F.col("row_id")) & (F.col("n") > 0))
    return stage(rows.groupBy("digest").agg(F.min("row_id").alias("low"), F.max("row_id").alias("high"), F.countDistinct("row_id").alias("ids"), F.first("n").alias("n"), F.first("print").alias("print")), "queries")


_SENT = ("part", "block", "uid", "row_id", "asked", "digest", "low", "high", "ids", "print")


def _sent(searched: DataFrame, queries: DataFrame, parts: int) -> DataFrame:
    """Rows dealt out over ``parts``, and all blocks of queries for each of them, side by side in one partition: a part's
    rows (block -1) first, then one block after the other."""
    none = F.lit(None).cast("long")
    rows = searched.select(F.pmod(F.xxhash64("uid"), F.lit(parts)).cast("int").alias("part"), F.lit(-1).cast("long").alias("block"), "uid", "row_id", "asked", "digest", none.alias("low"), none.alias("high"), none.alias("ids"), "print")
    held = queries.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "block", none.alias("uid"), none.alias("row_id"), F.lit(False).alias("asked"), "digest", "low", "high", "ids", "print")
    return rows.unionByName(held).repartition("part").sortWithinPartitions("part", "block")


def _search(prints: DataFrame, queries: DataFrame, give: Callable, schema: str, block_integers: int) -> tuple[DataFrame, int]:
    """Rows that ``give`` makes of each row's number, identifier, digest and matches, for each block of
    queries, and the number of blocks.  Queries that fit one block, whose size is checked, are broadcast and nothing
    is shuffled.  Of more queries none passes through the driver: rows are shuffled once, and queries once for each part of the
    rows, of which there are no more than it takes for both to be as much, if a task can hold such a part."""
    spark = prints.sparkSession
    asked = int(queries.agg(F.sum("n")).first()[0] or 0)
    blocks = -(-asked // block_integers)
    if not blocks:
        return spark.createDataFrame([], schema), 0
    searched = prints.where("n > 0").select("uid", "row_id", "asked", "digest", "n", "print")
    names = [f.split()[0] for f in schema.split(", ")]

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if k == len(found[0]) - 1 else pa.int64()) for k, c in enumerate(zip(*found, strict=True))], names=names)

    def searched_in(index: QueryBlock, classes: list[tuple], rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for k, hits in index.search_all([np.frombuffer(r[-1], dtype=np.uint32) for r in rows]):
            found += give(*rows[k][:-1], [(*classes[q], o, v, n, e) for q, o, v, n, e in hits])
            if len(found) >= PART_ROWS:
                yield batch_of(found)
                found = []
        if found:
            yield batch_of(found)

    if blocks == 1:
        got = queries.orderBy("digest").collect()
        held = [(bytes(r["digest"]), r["low"], r["high"], r["ids"]) for r in got]
        block = spark.sparkContext.broadcast((held, QueryBlock([np.frombuffer(bytes(r["print"]), dtype=np.uint32) for r in got])))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            classes, index = block.value
            for batch in batches:
                yield from searched_in(index, classes, list(zip(*(batch.column(c).to_pylist() for c in ("uid", "row_id", "asked", "digest", "print")), strict=True)))

        return searched.mapInArrow(run, schema), 1

    def run_sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[int | None, int] = (None, -1)
        rows: list[tuple] = []
        classes: list[tuple] = []
        held: list[np.ndarray] = []
        for batch in batches:
            for part, block, uid, row_id, asked, digest, low, high, ids, data in zip(*(batch.column(c).to_pylist() for c in _SENT), strict=True):
                if (part, block) != at:
                    if held:
                        yield from searched_in(QueryBlock(held), classes, rows)
                    classes, held = [], []
                    if part != at[0]:
                        rows = []
                    at = (part, block)
                if block < 0:
                    rows.append((uid, row_id, asked, digest, data))
                else:
                    classes.append((digest, low, high, ids))
                    held.append(np.frombuffer(data, dtype=np.uint32))
        if held:
            yield from searched_in(QueryBlock(held), classes, rows)

    own = int(searched.agg(F.sum("n")).first()[0])
    parts = max(-(-own // PART_INTEGERS), own // asked, spark.sparkContext.defaultParallelism)
    queries = queries.withColumn("block", F.pmod(F.xxhash64("digest"), F.lit(blocks)).cast("long"))
    return _sent(searched, queries, parts).mapInArrow(run_sent, schema), blocks


def align(df: DataFrame, id_col: str = "doc_id", source_col: str = "text", frames: Callable[[object], np.ndarray] = text_frames, is_query: Callable[[Column], Column] = lambda c: c % 100 == 0, block_integers: int = BLOCK_INTEGERS) -> DataFrame:
    """``query_id, match_id, offset, votes, overlap, bit_error`` of the stated queries against every
    row of ``df``, itself aside.  Queries of one fingerprint appear as the smallest identifier among them.

    ``frames`` turns a source value into pitch-class frames.  Null sources are silent and, like those
    without a frame, match nothing; recordings under a window are searched as loops.  Null identifiers are no query and match
    nothing.  Repeated rows each match.  Other columns are ignored.  No query gives an empty result.
    """

    def give(uid: int, row_id: int | None, asked: bool, digest: bytes, hits: list[tuple]) -> Iterator[tuple]:
        for own, low, _, _, o, v, n, e in hits:
            if row_id is not None and not (own == digest and low == row_id):
                yield low, row_id, o, v, n, e

    prints = fingerprints(df, id_col, source_col, frames)
    return _search(prints.withColumn("asked", F.lit(False)), _query_classes(prints, is_query), give, "query_id long, match_id long, offset long, votes long, overlap long, bit_error double", block_integers)[0]


def linked(df: DataFrame, id_col: str = "doc_id", source_col: str = "text", frames: Callable[[object], np.ndarray] = text_frames, is_query: Callable[[Column], Column] = lambda c: c % 100 == 0, block_integers: int = BLOCK_INTEGERS) -> DataFrame:
    """One row per row of ``df``: ``<id_col>, class_id, n_links, best_id, best_offset, best_votes,
    best_overlap, best_error``.

    ``class_id`` is the smallest identifier of equal fingerprints, its own for a row without
    integers.  ``n_links`` counts the stated queries, itself aside, that align with the row; the best of
    them has the fewest bits wrong, then the longest stretch, then the smallest identifier; queries of
    equal fingerprints appear as the smallest among them, to that one itself as the largest.  Null sources and those without a frame are silent: no links.  Rows under a window are
    searched as loops.  Rows
    that repeat an identifier have a row each; a null identifier is no query but is searched.  Ties
    and repeated rows change nothing; other columns are ignored; an empty table gives an empty result.
    Fingerprints are held equal by a 128-bit digest.
    """
    prints = fingerprints(df, id_col, source_col, frames)
    asked = F.coalesce(is_query(F.col("row_id")), F.lit(False))

    def give(uid: int, row_id: int | None, asked: bool, digest: bytes, hits: list[tuple]) -> Iterator[tuple]:
        links, best = 0, None
        for own, low, high, ids, o, v, n, e in hits:
            itself = asked and own == digest
            if ids > itself:
                links += ids - itself
                found = (e, -n, high if itself and low == row_id else low, o, v)
                best = found if best is None or found < best else best
        if best is not None:
            wrong, n, best_id, o, v = best
            yield uid, links, best_id, o, v, -n, wrong

    found, blocks = _search(prints.withColumn("asked", asked), _query_classes(prints, is_query), give, "uid long, n_links long, best_id long, best_offset long, best_votes long, best_overlap long, best_error double", block_integers)
    if blocks > 1:
        best = F.min(F.struct("best_error", (-F.col("best_overlap")).alias("o"), "best_id", "best_offset", "best_votes")).alias("b")
        found = found.groupBy("uid").agg(F.sum("n_links").alias("n_links"), best).select(
            "uid", "n_links", "b.best_id", "b.best_offset", "b.best_votes", (-F.col("b.o")).alias("best_overlap"), "b.best_error")
    own = prints.select("uid", "row_id", "n", "digest")
    classes = own.where("n > 0 and row_id is not null").groupBy("digest").agg(F.min("row_id").alias("class_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    classes = stage(classes, "classes")
    hot = hot_digests(classes, int(classes.agg(F.sum("n")).first()[0] or 0))
    rows = dealt(own.drop("n"), hot).join(in_all_parts(classes.drop("n"), hot), ["digest", "part"], "left").join(found, "uid", "left")
    return rows.select(
        F.col("row_id").alias(id_col), F.coalesce("class_id", "row_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        "best_id", "best_offset", "best_votes", "best_overlap", "best_error")
