"""Near-duplicates by SimHash fingerprints under a generalised pigeonhole search.

1. Each task fingerprints its own texts; only ``(id, fingerprint)`` leaves it.
2. Rows of one fingerprint are one class, represented by its smallest identifier.
3. Bit counts and co-occurrences of all classes, summed in Spark, give the correlation of bits;
   correlated bits share a partition, so that the other partitions stay selective.
4. A dynamic program shares the radius out over the partitions, unequally, at the least estimated
   work.  Whatever it chooses, thresholds sum to ``radius - partitions + 1``, so each pair within
   the radius meets in some partition (general pigeonhole).
5. Every class is filed under its value in each partition and probes the values within that
   partition's threshold.  Tasks verify whole buckets and return spanning-forest links, not pairs.
   Buckets over a bound are dealt out as pairs of blocks.
6. Connected components of the links give the groups.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import limit_batches, regrouped, stage, texts
from .components import connected_components

#: A bucket with more rows than this is dealt out as pairs of blocks.
BUCKET_ROWS = 8192
#: Classes whose pairs the work of a search is estimated on.
SAMPLE_CLASSES = 1500
#: Relative work of writing a signature and of comparing two fingerprints, for the dynamic program.
SIGNATURE_COST, COMPARE_COST = 2e-6, 1e-8
_CHUNK = 1 << 20


def fingerprint(text: str, shingle: int = 3) -> int:
    """64-bit SimHash of a text: lower-cased ASCII letters, words between ASCII white space, hashed
    word shingles with repeats (a shorter text is one shingle; one without words gives 0)."""
    data = text.encode("utf-8", "surrogatepass").lower()
    words = data.split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        starts = [0, *ends[: len(words) - shingle].tolist()]
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    counts = np.zeros(64, dtype=np.int64)
    h = np.array(hashes, dtype="<u8")
    for at in range(0, len(h), _CHUNK):
        part = h[at : at + _CHUNK]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``row_id, fp`` (the fingerprint's bits as a signed long) for each row; null text as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in texts(batch, "body")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(fps)], names=["row_id", "fp"])

    return limit_batches(df).select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("body")).mapInArrow(run, "row_id long, fp long")


def bit_statistics(classes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of classes and the 64 x 64 counts of bits set together, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64), dtype=np.int64)
        n = 0
        for batch in regrouped(batches):
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(fp, axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
            n += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097)), pa.array(np.append(total.ravel(), n))], names=["cell", "n"])

    cells = np.zeros(4097, dtype=np.int64)
    for row in classes.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        cells[row["cell"]] = row["n"]
    return int(cells[4096]), cells[:4096].reshape(64, 64)


def group_bits(n: int, together: np.ndarray, partitions: int) -> list[list[int]]:
    """Bits dealt into ``partitions`` groups of nearly equal width, correlated bits together."""
    p = np.diag(together) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, groups = np.ones(len(p), dtype=bool), []
    for k in range(partitions):
        width = int(free.sum()) // (partitions - k)
        closest = np.where(free, np.where(free[None, :], corr, 0).max(axis=1), -1)
        group = [int(np.argmax(closest))]
        free[group[0]] = False
        score = corr[group[0]].copy()
        while len(group) < width:
            best = int(np.argmax(np.where(free, score, -1)))
            group.append(best)
            free[best] = False
            score += corr[best]
        groups.append(sorted(group))
    return groups


def sampled(classes: DataFrame, columns: list[str], most: int = SAMPLE_CLASSES) -> np.ndarray:
    """Fingerprint words of at most about ``most`` classes, taken by a hash: what the work of a search is
    estimated on.  It has no effect on what the search finds."""
    total = classes.count()
    step = max(1, -(-total // most))
    rows = classes.where(F.pmod(F.xxhash64(*columns), F.lit(step)) == 0).select(*columns).toArrow()
    return np.stack([rows.column(c).to_numpy() for c in columns], axis=1).view(np.uint64).reshape(-1, len(columns))


def bits_of(words: np.ndarray) -> np.ndarray:
    """Fingerprints (rows of 64-bit words) as rows of bits, bit 0 first."""
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(len(words), 8 * words.shape[1]), axis=1, bitorder="little")


def candidate_rates(n: int, together: np.ndarray, bits: list[int], most: int, sample: np.ndarray | None = None) -> list[float]:
    """Estimated share of pairs that differ in at most t of ``bits``, t = 0..most: what pairs of a sample
    (rows of all bits) show, which sees that bits go together, and at least what independent bits with each
    bit's own rate give, which sees shares too small for a sample."""
    p = np.diag(together)[bits] / max(n, 1)
    dist = np.array([1.0])
    for q in 2 * p * (1 - p):
        dist = np.convolve(dist, [1 - q, q])
    rates = np.minimum(np.cumsum(dist), 1)
    if sample is not None and len(sample) > 1:
        own = sample[:, bits].astype(np.float32)
        apart = own @ (1 - own.T)
        seen = np.bincount(np.rint(apart + apart.T).astype(np.int64)[np.triu_indices(len(own), 1)], minlength=len(bits) + 1)
        rates = np.maximum(rates, np.cumsum(seen) / seen.sum())
    return rates.tolist()[: most + 1] + [1.0] * max(0, most + 1 - len(rates))


def _ball(width: int, radius: int) -> int:
    total, term = 0, 1
    for k in range(radius + 1):
        total += term
        term = term * (width - k) // (k + 1)
    return total


def allocate(n: int, together: np.ndarray, radius: int, counts: range = range(2, 9), sample: np.ndarray | None = None) -> tuple[float, list[list[int]], list[int]]:
    """Least estimated work, bit groups and thresholds (-1: the group isn't probed)."""
    best: tuple[float, list[list[int]], list[int]] | None = None
    for m in counts:
        groups = group_bits(n, together, m)
        spare = radius - m + 1
        if spare < -m:
            continue
        costs = []
        for bits in groups:
            most = min(radius, len(bits))
            rates = candidate_rates(n, together, bits, most, sample)
            costs.append([0.0] + [n * _ball(len(bits), t) * SIGNATURE_COST + 0.5 * n * n * rates[t] * COMPARE_COST for t in range(most + 1)])
        # state: thresholds handed out so far, each counted from -1
        state: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for cost in costs:
            after: dict[int, tuple[float, list[int]]] = {}
            for used, (total, ts) in state.items():
                for t in range(-1, len(cost) - 1):
                    key, value = used + t + 1, total + cost[t + 1]
                    if key <= spare + m and (key not in after or value < after[key][0]):
                        after[key] = (value, [*ts, t])
            state = after
        if spare + m in state and (best is None or state[spare + m][0] < best[0]):
            best = (state[spare + m][0], groups, state[spare + m][1])
    assert best is not None
    return best


def signatures(classes: DataFrame, groups: list[list[int]], thresholds: list[int]) -> DataFrame:
    """``key, base, fp, rep``: each class under its own value in every probed partition (``base``)
    and under the other values within the partition's threshold."""
    plan = []
    for i, (bits, t) in enumerate(zip(groups, thresholds, strict=True)):
        if t >= 0:
            masks = [sum(1 << b for b in c) for k in range(t + 1) for c in itertools.combinations(range(len(bits)), k)]
            plan.append((i, bits, np.array(masks, dtype=np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in regrouped(batches, 4096):
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                fp = part.column("fp").to_numpy(zero_copy_only=False)
                rep = part.column("rep").to_numpy(zero_copy_only=False)
                u = fp.view(np.uint64)
                for i, bits, masks in plan:
                    value = np.zeros(len(u), dtype=np.int64)
                    for k, b in enumerate(bits):
                        value |= (((u >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)).view(np.int64)
                    keys = (value[:, None] ^ masks[None, :]) | (np.int64(i) << np.int64(56))
                    base = np.zeros(keys.shape, dtype=bool)
                    base[:, 0] = True
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.ravel()), pa.array(base.ravel()), pa.array(np.repeat(fp, len(masks))), pa.array(np.repeat(rep, len(masks)))],
                        names=["key", "base", "fp", "rep"])

    return classes.select("fp", "rep").mapInArrow(run, "key long, base boolean, fp long, rep long")


class Trees:
    """Connected rows of an array: each one's ``root`` is the smallest row it is tied to."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def tie(self, x: np.ndarray, y: np.ndarray) -> None:
        """Ties rows ``x[k]`` and ``y[k]``, all at once."""
        root = self.root
        while len(x):
            a, b = root[x], root[y]
            apart = a != b
            if not apart.any():
                return
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up


def _verify(key: np.ndarray, base: np.ndarray, fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between the base rows of each bucket and all its later rows; base rows come first."""
    n = len(key)
    ends = np.append(np.flatnonzero(np.diff(key)) + 1, n)
    end = ends[np.searchsorted(ends, np.arange(n), side="right")]
    left = np.flatnonzero(base)
    width = end[left] - left - 1
    u = fp.view(np.uint64)
    at = 0
    cum = np.cumsum(width)
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(cum, (cum[at - 1] if at else 0) + _CHUNK, side="right")))
        w = width[at:to]
        total = int(w.sum())
        if total:
            x = np.repeat(left[at:to], w)
            y = x + 1 + np.arange(total) - np.repeat(np.cumsum(w) - w, w)
            near = np.bitwise_count(u[x] ^ u[y]) <= radius
            yield x[near], y[near]
        at = to


def link_buckets(sigs: DataFrame, radius: int) -> DataFrame:
    """``a, b`` links (each tied row of a run of buckets with the first it is tied to) of rows that share a
    key and lie within ``radius`` bits, at least one of the two filed there under its own value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, base, fp, rep in runs(batches, ("key", "base", "fp", "rep")):
            trees = Trees(len(key))
            for x, y in _verify(key, base, fp, radius):
                trees.tie(x, y)
            a, b = rep[trees.root], rep
            links = np.unique(np.stack([a, b], axis=1)[a != b], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

    # keys ascend in a task, which the search for a bucket's end relies on
    ordered = sigs.repartition("key").sortWithinPartitions("key", F.desc("base"))
    return ordered.select("key", "base", "fp", "rep").mapInArrow(run, "a long, b long")


def runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by their first one, cut between its values only."""
    held: list[np.ndarray] | None = None
    for batch in regrouped(batches):
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        at = int(np.searchsorted(cols[0], cols[0][-1]))  # the last bucket may go on in the next batch
        if at:
            yield [c[:at] for c in cols]
        held = [c[at:] for c in cols]
    if held is not None:
        yield held


def split_hot(sigs: DataFrame, bucket_rows: int, by: str = "fp") -> DataFrame:
    """Buckets over ``bucket_rows`` rows dealt out: rows go by a hash of ``by`` into blocks of about half
    that size, and each pair of blocks is a bucket of its own, so every pair still meets."""
    sizes = sigs.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows)
    sizes = stage(sizes, "hot-buckets")
    if not sizes.limit(1).count():
        return sigs
    blocks = F.ceil(F.col("n") / (bucket_rows / 2)).cast("int")
    hot = sigs.join(sizes.select("key", blocks.alias("blocks")), "key", "left")
    block = F.pmod(F.xxhash64(by), F.col("blocks")).cast("int")
    other = F.explode(F.expr("sequence(0, blocks - 1)"))
    cold = hot.where("blocks is null").select(*sigs.columns)
    dealt = hot.where("blocks is not null").withColumn("block", block).withColumn("other", other)
    key = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    return cold.unionByName(dealt.select(*[key.alias(c) if c == "key" else c for c in sigs.columns]))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``<id_col>, fingerprint, component_id`` for every row of ``df``.

    Fingerprints at ``radius`` or fewer differing bits are linked; the component is the smallest
    identifier reachable, itself included.  Null texts count as empty; texts without words have
    fingerprint 0 and are linked like any other.  Rows that repeat an identifier are one document
    (their fingerprints are linked).  A null identifier takes part through its fingerprint only,
    and where no row of its class has an identifier its component is null.  Other columns are
    ignored; an empty table gives an empty result.
    """
    fps = stage(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    classes = stage(fps.groupBy("fp").agg(F.min("row_id").alias("rep")).where("rep is not null"), "classes")
    n, together = bit_statistics(classes)
    _, groups, thresholds = allocate(n, together, radius, sample=bits_of(sampled(classes, ["fp"])))
    sigs = split_hot(signatures(classes, groups, thresholds), bucket_rows)
    links = link_buckets(sigs, radius)
    # an identifier met with several fingerprints ties their classes together
    multi = fps.where("row_id is not null").groupBy("row_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low != high").select("row_id")
    tied = fps.join(multi, "row_id", "left_semi").join(classes, "fp").select(F.col("row_id").alias("a"), F.col("rep").alias("b"))
    comps = connected_components(links.unionByName(tied))
    by_fp = classes.join(comps, classes["rep"] == comps["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(by_fp, "fp", "left").select(
        F.col("row_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
