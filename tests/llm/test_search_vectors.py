"""Ranked search, product codes and the range join of vectors against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import lexical_search, vector_codes, vector_join

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k):
    bags = [(i, Counter(words(t))) for i, t in docs if words(t)]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(words(t))
    out = []
    for i, terms in asked.items():
        found = []
        for doc, bag in bags:
            m = 50 + (50 * sum(bag.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * bag[t] // (1000 * bag[t] + 20 * m)) for t in terms if t in bag)
            if score > 0 and doc is not None:
                found.append((-score, doc))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


EDGE_DOCS = [(None, None), (None, "alpha beta"), (1, None), (2, ""), (3, " \t"), (-4, "Alpha ÄBC äbc x9"), (5, "alpha alpha beta"), (5, "alpha alpha beta"), (6, "alpha alpha beta"), (7, "gamma " * 20_000 + "delta"), (2**62, "gamma"), (-(2**62), "gamma delta")]
EDGE_ITEMS = [(1, "ALPHA, alpha; beta!"), (2, None), (3, ""), (4, "nowhere"), (None, "alpha"), (5, "gamma"), (5, "delta x9"), (6, "äbc")]


@pytest.mark.parametrize("block_pairs", [3, 100_000])
def test_search_of_edge_cases(spark, monkeypatch, block_pairs):
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", 3)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in EDGE_DOCS], "doc_id long, text string, score int, term string").repartition(2)
    items = spark.createDataFrame([(i, t, 3) for i, t in EDGE_ITEMS], "item_id long, text string, shard int")
    got = sorted(tuple(r) for r in lexical_search.search(docs, items, k=4, block_pairs=block_pairs).collect())
    assert got == ranked(EDGE_DOCS, EDGE_ITEMS, 4)


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(EDGE_ITEMS, "item_id long, text string")
    assert lexical_search.search(docs, items).count() == 0
    assert lexical_search.search(spark.createDataFrame(EDGE_DOCS, "doc_id long, text string"), items.limit(0)).count() == 0


def test_search_matches_brute_force(spark, data):
    docs, items = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    want = ranked([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], 50)
    assert sorted(tuple(r) for r in lexical_search.search(docs, items).collect()) == want


def test_merge_of_lists_with_ties_and_packed_numbers():
    rng = random.Random(3)
    for _ in range(300):
        lists = []
        for _ in range(rng.randint(1, 8)):
            where = sorted(rng.sample(range(60), rng.randint(1, 40)))
            scores = [rng.randint(0, 4) for _ in where]
            lists.append((max(scores), where, scores))
        total = Counter()
        for _, where, scores in lists:
            total.update(dict(zip(where, scores, strict=True)))
        k = rng.randint(1, 12)
        assert sorted(lexical_search.merge(lists, k), key=lambda x: (-x[0], x[1])) == [(s, d) for s, d in sorted(((s, d) for d, s in total.items() if s), key=lambda x: (-x[0], x[1]))[:k]]
    numbers = np.array([0, 1, 127, 128, 2**32, 2**63, 2**64 - 1], dtype=np.uint64)
    assert lexical_search.unpack(lexical_search.pack(numbers)).tolist() == numbers.tolist()


def coded(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    size = len(kept[0][1]) // parts
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda k: kept[k][0])[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for c in cut:
                groups[near(c[p], books[p])[1]].append(c[p])
            for k, own in groups.items():
                books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = Counter()
    for (_, _, label), f in zip(kept, found, strict=True):
        errors[label] += sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted((i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), errors[label], digest) for (i, _, label), f in zip(kept, found, strict=True))


def test_codes_match_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, rng.uniform(-1, 1)]) for _ in range(32)], rng.choice([None, 1, 2])) for i in rng.sample(range(-500, 500), 150)]
    rows += [(1001, None, 1), (1002, [None] * 32, 1), (1003, [float("nan")] * 32, None), (1004, [float("inf"), *[0.0] * 31], 2), (1005, [], 1), (1006, [1.0] * 16, 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, code string, error int").repartition(3)
    got = sorted(tuple(r) for r in vector_codes.encode(df).collect())
    assert got == coded([(i, [np.float64(np.float32(x)) for x in v] if v else v, label) for i, v, label in rows if i < 1002])


def test_codes_of_few_repeated_and_no_rows(spark):
    schema = "vec_id long, embedding array<double>, label string"
    rows = [(3, [0.1] * 16, "a"), (3, [0.1] * 16, "a"), (1, [0.5] * 16, None)]
    assert sorted(tuple(r) for r in vector_codes.encode(spark.createDataFrame(rows, schema)).collect()) == coded(rows)
    assert vector_codes.encode(spark.createDataFrame([], schema)).count() == 0
    nameless = vector_codes.encode(spark.createDataFrame([(None, [0.1] * 16, "a"), *rows], schema)).collect()
    assert len(nameless) == 4 and sum(r["vec_id"] is None for r in nameless) == 1


def test_partial_distances_give_the_nearest_entry():
    rng = np.random.default_rng(2)
    for _ in range(50):
        x, book = rng.integers(-4, 5, (300, 4)), rng.integers(-4, 5, (rng.integers(1, 20), 4))
        far = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        index, distance = vector_codes.nearest(x, book)
        assert (index == far.argmin(axis=1)).all() and (distance == far.min(axis=1)).all()


def grouped(rows, least):
    ok = [k for k, (_, v, label) in enumerate(rows) if v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]) and vector_join.cosine(np.array(rows[a][1]), np.array(rows[b][1])) >= least:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    low = {}
    for k, (i, _, _) in enumerate(rows):
        r = find(k)
        low[r] = i if low.get(r) is None else low[r] if i is None else min(i, low[r])
    key = lambda r: tuple((x is None, x or 0) for x in r)
    return sorted(((i, links[k], low[find(k)], low[find(k)] is None or i == low[find(k)]) for k, (i, _, _) in enumerate(rows)), key=key), key


@pytest.mark.parametrize(("least", "size", "block"), [(0.98, 8, 5), (0.9, 16, 4096), (0.8, 8, 4), (0.98, 4096, 4096)])
def test_range_join_matches_all_pairs(spark, least, size, block):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(420):
        base = np.random.default_rng(k % 40).normal(size=6)
        noise = [0.0, 0.02, 0.1, 1.0][k % 4] if k % 3 else 0.05
        vector = (base if k % 3 else np.ones(6)) + noise * rng.normal(size=6)
        rows.append((int(1000 - k), [float(x) for x in vector * rng.choice([1.0, 3.0])], int(k % 40 == 7)))
    rows += [(2000, rows[0][1], rows[0][2]), (2001, rows[0][1], rows[0][2]), (None, rows[3][1], rows[3][2])]
    want, key = grouped(rows, least)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, node int, cell string").repartition(3)
    got = vector_join.near_vectors(df, cosine_at_least=least, cell_rows=size, block_rows=block).collect()
    assert sorted((tuple(r) for r in got), key=key) == want


def test_range_join_of_edge_cases(spark):
    schema = "vec_id long, embedding array<float>, label string"
    rows = [(1, None, "a"), (2, [], "a"), (3, [0.0, 0.0], "a"), (4, [None, 1.0], "a"), (5, [float("nan"), 1.0], "a"), (6, [1.0, 0.0], None), (7, [1.0, 0.0], "a/b"), (8, [2.0, 0.0], "a/b"), (9, [1.0, 0.0], "a"), (9, [1.0, 0.0], "a"), (10, [1.0, 0.0, 0.0], "a"), (None, [0.0, 1.0], "a"), (None, [0.0, 1.0], "a"), (11, [-0.0, 0.0], "a")]
    want, key = grouped(rows, 0.98)
    assert sorted((tuple(r) for r in vector_join.near_vectors(spark.createDataFrame(rows, schema)).collect()), key=key) == want
    assert vector_join.near_vectors(spark.createDataFrame([], schema)).count() == 0


def test_a_dense_group_is_counted_without_its_pairs(spark, monkeypatch):
    """Rows within half the radius of a pivot: a core, whose own blocks never meet."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in np.ones(8) + 0.005 * rng.normal(size=8)], 1) for i in range(300)] + [(1000 + i, [float(x) for x in rng.normal(size=8)], 1) for i in range(60)]
    want, key = grouped(rows, 0.98)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = vector_join.near_vectors(df, cell_rows=32, block_rows=16)
    assert sorted((tuple(r) for r in got.collect()), key=key) == want
