"""Removal of repeated passages by seed and extend over winnowed anchors.

Every window of ``length`` words picks its anchor: the least-hashed run of ``seed`` words in it.
The choice depends on the window's words alone, so equal windows meet at equal anchors, whatever
surrounds them.  Occurrences of an anchor are extended both ways over the windows that picked it.

1. Tasks emit one row per anchor occurrence with a hash of its whole extension.  Occurrences of one
   extension that a task meets again are settled there (map-side combining) and neighbouring ones
   merged into maximal stretches, so a passage met thousands of times costs a row per Arrow batch of texts.
2. Rows meet by anchor in one shuffle and stream past in order: all but the first occurrence of an
   extension are repeats.  Where one anchor has several extensions, the first of each is pending.
3. Pending extensions are compared window by window, in a second exchange of the same kind.
4. Overlapping windows join into maximal repeats, and each document drops the words they cover.

No step pairs occurrences with each other, so hot passages never square.  Windows are held equal by
128 bits (64 of the anchor or window and 64 of an independent hash); their words aren't compared again.
Rows of one anchor, already combined by task, meet in one task; so do the spots of all rows without an
identifier, which count as one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, filter_bits, key_filter, limit_batches, marked, regrouped, stage, texts

#: Words of an anchor; a window of 20 holds 15, of which it picks one.
SEED = 6
#: Words that a task looks at together.
BATCH_WORDS = 1 << 20
_NO_ID = -(1 << 63)
_B = np.uint64(0x9E3779B97F4A7C15)
_B_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_OCCURRENCE = "k1 long, k2 long, doc long, s int, n int, settled boolean"


def split_words(text: str) -> list[bytes]:
    """Words between ASCII white space, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Two independent 64-bit hashes of each word."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(w) for w in words]), dtype="<u8").reshape(-1, 2)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Ranges:
    """Hashes of any stretch of a sequence, from one running sum modulo 2**64."""

    def __init__(self, h: np.ndarray):
        n = len(h)
        powers = np.full(n + 1, _B)
        inverse = np.full(n + 1, _B_INVERSE)
        powers[0] = inverse[0] = 1
        self.inverse = np.multiply.accumulate(inverse)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(h * np.multiply.accumulate(powers)[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start])


def anchors(seeds: np.ndarray, width: int) -> np.ndarray:
    """For each stretch of ``width`` seeds the position of its least hash, the leftmost of equals."""
    value, at, span = seeds, np.arange(len(seeds)), 1
    while span < width:
        step = min(span, width - span)
        left, right = value[: len(value) - step], value[step:]
        take = right < left
        at = np.where(take, at[step:], at[: len(at) - step])
        value = np.minimum(left, right)
        span += step
    return at


def occurrences(h: np.ndarray, owner: np.ndarray, length: int, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """``k1, k2, first window, windows`` of each anchor occurrence; ``owner`` tells the document of
    each word of ``h``.  Windows lie within one document."""
    empty = np.zeros(0, dtype=np.uint64)
    none = np.zeros(0, dtype=np.int64)
    if len(h) < length:
        return empty, empty, none, none
    first, second = Ranges(h[:, 0]), Ranges(h[:, 1])
    start = np.arange(len(h) - seed + 1)
    seeds = first.of(start, start + seed)
    pick = anchors(seeds, length - seed + 1)
    window = np.flatnonzero(owner[: len(h) - length + 1] == owner[length - 1 :])
    if not len(window):
        return empty, empty, none, none
    p = pick[window]
    new = np.ones(len(window), dtype=bool)
    new[1:] = (p[1:] != p[:-1]) | (window[1:] != window[:-1] + 1) | (owner[window[1:]] != owner[window[:-1]])
    at = np.flatnonzero(new)
    s, n = window[at], np.diff(np.append(at, len(window)))
    lead = (p[at] - s).astype(np.uint64)  # where the anchor lies in the extension, and how long that is
    k2 = mixed(second.of(s, s + n - 1 + length) + (lead * np.uint64(1024) + n.astype(np.uint64)) * _B)
    return seeds[p[at]], k2, s, n


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[list[bytes]]]]:
    """Documents and their words, so many that they hold about BATCH_WORDS."""
    ids: list[int] = []
    words: list[list[bytes]] = []
    held = 0
    for doc, text in zip(batch.column("doc").to_pylist(), batch.column("body").to_pylist(), strict=True):
        w = split_words(text or "")
        ids.append(doc)
        words.append(w)
        held += len(w)
        if held >= BATCH_WORDS:
            yield ids, words
            ids, words, held = [], [], 0
    if ids:
        yield ids, words


def _flat(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, the document of each, and where each document begins."""
    sizes = np.array([len(w) for w in words])
    h = word_hashes([x for w in words for x in w])
    return h, np.repeat(np.arange(len(words)), sizes), np.cumsum(sizes) - sizes


def _rows(*cols: np.ndarray, names: str = _OCCURRENCE) -> pa.RecordBatch:
    kinds = [c.split() for c in names.split(", ")]
    arrow = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c, arrow[k]) for c, (_, k) in zip(cols, kinds, strict=True)], names=[n for n, _ in kinds])


def seed_rows(docs: DataFrame, length: int, seed: int = SEED) -> DataFrame:
    """Anchor occurrences of ``docs`` (``doc, body``).  Repeats within a task's batch come out
    settled and merged; of each extension the batch's first occurrence comes out unsettled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, words in _batches(batch):
                h, owner, begin = _flat(words)
                k1, k2, s, n = occurrences(h, owner, length, seed)
                if not len(s):
                    continue
                of = owner[s]
                doc, local = np.array(ids)[of], s - begin[of]
                order = np.lexsort((local, doc, k2, k1))
                a, b, d, x = k1[order], k2[order], doc[order], local[order]
                new = np.ones(len(a), dtype=bool)
                new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                lead = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
                again = (d != d[lead]) | (x != x[lead])
                settled = np.zeros(len(s), dtype=bool)
                settled[order] = again
                open_ = np.zeros(len(s), dtype=bool)
                open_[order] = new
                yield _rows(k1[open_], k2[open_], doc[open_], local[open_], n[open_], np.zeros(int(open_.sum()), dtype=bool))
                t = np.flatnonzero(settled)
                if len(t):  # occurrences are in page order: merge those that adjoin
                    first = np.ones(len(t), dtype=bool)
                    first[1:] = (of[t[1:]] != of[t[:-1]]) | (s[t[1:]] != s[t[:-1]] + n[t[:-1]])
                    f = np.flatnonzero(first)
                    total = np.add.reduceat(n[t], f)
                    spread = mixed(k1[t[f]] ^ doc[t[f]].astype(np.uint64))
                    yield _rows(spread, np.zeros(len(f), dtype=np.int64), doc[t[f]], local[t[f]], total, np.ones(len(f), dtype=bool))

    return docs.mapInArrow(run, _OCCURRENCE)


_VERDICT = "doc long, s int, n int, pending boolean"


def judge(rows: DataFrame, pend: bool) -> DataFrame:
    """``doc, s, n, pending`` of repeats: every row of a ``(k1, k2)`` after the first place in
    order of document and start.  With ``pend`` also, pending, the first of each ``k2`` where a
    ``k1`` has several.  Rows stream past; a task keeps two of them from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # first row of the k1 under way and of its present k2, and whether the former was given
        carry: list[tuple] = []
        given = False
        for batch in regrouped(batches):
            settled = batch.column("settled").to_numpy(zero_copy_only=False)
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2", "doc", "s", "n")]
            if settled.any():
                yield _rows(*(c[settled] for c in cols[2:]), np.zeros(int(settled.sum()), dtype=bool), names=_VERDICT)
                cols = [c[~settled] for c in cols]
            if not len(cols[0]):
                continue
            old = len(carry)
            if old:
                cols = [np.concatenate([np.array(c, dtype=x.dtype), x]) for c, x in zip(zip(*carry, strict=True), cols, strict=True)]
            k1, k2, doc, s, n = cols
            size = len(k1)
            run_new = np.ones(size, dtype=bool)
            run_new[1:] = k1[1:] != k1[:-1]
            new = run_new.copy()
            new[1:] |= k2[1:] != k2[:-1]
            lead = np.maximum.accumulate(np.where(new, np.arange(size), 0))
            again = (doc != doc[lead]) | (s != s[lead])
            again[:old] = False
            yield _rows(doc[again], s[again], n[again], np.zeros(int(again.sum()), dtype=bool), names=_VERDICT)
            runs = np.flatnonzero(run_new)
            several = np.add.reduceat(new.astype(np.int64), runs) > 1
            if pend:
                wait = new & np.repeat(several, np.diff(np.append(runs, size)))
                if old:
                    wait[0] &= not given
                    wait[1:old] = False
                yield _rows(doc[wait], s[wait], n[wait], np.ones(int(wait.sum()), dtype=bool), names=_VERDICT)
            top, low = int(runs[-1]), int(lead[-1])
            given = bool(several[-1])
            carry = [tuple(int(c[i]) for c in cols) for i in dict.fromkeys((top, low))]

    ordered = rows.repartition("k1").sortWithinPartitions("k1", "k2", "doc", "s")
    return ordered.select("k1", "k2", "doc", "s", "n", "settled").mapInArrow(run, _VERDICT)


def window_rows(docs: DataFrame, length: int) -> DataFrame:
    """One row per window of the pending extensions ``spots`` of ``docs`` (``doc, body, spots``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, spots in zip(batch.column("doc").to_pylist(), batch.column("body").to_pylist(), batch.column("spots").to_pylist(), strict=True):
                h = word_hashes(split_words(text or ""))
                at = np.array([(x["s"], x["n"]) for x in spots], dtype=np.int64).reshape(-1, 2)
                s = np.repeat(at[:, 0] - np.cumsum(at[:, 1]) + at[:, 1], at[:, 1]) + np.arange(at[:, 1].sum())
                s = s[s + length <= len(h)]
                k1, k2 = Ranges(h[:, 0]).of(s, s + length), Ranges(h[:, 1]).of(s, s + length)
                yield _rows(k1, k2, np.full(len(s), doc), s, np.ones(len(s), dtype=np.int64), np.zeros(len(s), dtype=bool))

    return docs.select("doc", "body", "spots").mapInArrow(run, _OCCURRENCE)


def covered(n_words: int, spots: list[tuple[int, int]], length: int) -> np.ndarray:
    """Which words the windows ``[s, s + n)`` of ``length`` words cover: the maximal repeats."""
    edge = np.zeros(n_words + 1, dtype=np.int64)
    for s, n in spots:
        if s < n_words:
            edge[s] += 1
            edge[min(n_words, s + n - 1 + length)] -= 1
    return np.cumsum(edge[:-1]) > 0


def repeats(docs: DataFrame, length: int = 20, seed: int = SEED) -> DataFrame:
    """``doc, s, n``: stretches of window starts whose windows also start earlier."""
    first = stage(judge(seed_rows(docs, length, seed), True), "repeats")
    spots = stage(first.where("pending").groupBy("doc").agg(F.collect_list(F.struct("s", "n")).alias("spots")), "pending")
    second = judge(window_rows(among(docs, "doc", spots).join(spots, "doc"), length), False)
    return first.where("not pending").select("doc", "s", "n").unionByName(second.select("doc", "s", "n"))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 20, seed: int = SEED, with_text: bool = False) -> DataFrame:
    """``<id_col>, n_words, n_removed, kept_sha256`` (and ``kept_text``) for every row of ``df``.

    A word is removed if a window of ``length`` words that covers it also starts earlier: in a row
    with a smaller identifier, or before it in the same one.  Windows are judged on the input.  A
    null text has no words; a text without kept words gives the hash of the empty string.  Rows
    without an identifier count as one document before all others, and rows that repeat an
    identifier as one document: their equal starts aren't earlier than each other, and what is
    removed at a place is removed there in each.  Other columns are ignored; an empty table gives
    an empty result.
    """
    docs = limit_batches(df).select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc"), F.col(text_col).alias("body"))
    spots = stage(repeats(docs, length, seed).groupBy("doc").agg(F.collect_list(F.struct("s", "n")).alias("spots")), "spots")
    schema = "doc long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in schema.split(", ")[1:]]
            for text, spots in zip(texts(batch, "body"), batch.column("spots").to_pylist(), strict=True):
                words = split_words(text)
                gone = 0
                if spots:
                    drop = covered(len(words), [(x["s"], x["n"]) for x in spots], length)
                    gone = int(drop.sum())
                    words = [w for w, d in zip(words, drop.tolist(), strict=True) if not d]
                kept = b" ".join(words)
                row = (len(words) + gone, gone, hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "surrogatepass")] * with_text))
                for col, x in zip(cols, row, strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=False))], names=[x.split()[0] for x in schema.split(", ")])

    # texts without repeats pass by; only the others are shuffled
    bits = filter_bits(spots.count())
    found = marked(docs, "doc", key_filter(spots, "doc", bits), bits)
    some = found.where("hit").select("doc", "body").join(spots, "doc", "left").select("doc", "body", "spots")
    none = found.where("not hit").select("doc", "body", F.lit(None).cast(spots.schema["spots"].dataType).alias("spots"))
    out = some.unionByName(none).mapInArrow(run, schema)
    return out.withColumn("doc", F.when(F.col("doc") != _NO_ID, F.col("doc"))).withColumnRenamed("doc", id_col)
