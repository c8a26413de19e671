"""Exact, near and substring duplicates against brute force."""

import hashlib
import itertools
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, simhash_dedup, substring_dedup
from tessera.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text, shingle):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(text)
    if not words:
        return 0
    grams = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, linked):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(ids), 2):
        if linked(a, b):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize(("shingle", "radius", "bucket"), [(3, 3, 8192), (5, 9, 8192), (3, 3, 4)])
def test_near_duplicates_match_all_pairs(documents, shingle, radius, bucket):
    rows = {r["doc_id"]: r["text"] for r in documents.collect()}
    fps = {i: fingerprint(t, shingle) for i, t in rows.items()}
    want = components(rows, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= radius)
    got = simhash_dedup.near_duplicates(documents, shingle=shingle, radius=radius, bucket_rows=bucket).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in rows}


def test_near_duplicates_of_planted_distances(spark, make, monkeypatch):
    """Fingerprints at every distance from 0 to 8, so that no threshold vector loses a link."""
    rng = random.Random(5)
    fps = []
    for _ in range(40):
        base = rng.getrandbits(64)
        for d in range(9):
            fps.append(base ^ sum(1 << b for b in rng.sample(range(64), d)))
    rows = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "row_id long, fp long")
    monkeypatch.setattr(simhash_dedup, "fingerprints", lambda *a: rows)
    got = simhash_dedup.near_duplicates(make([]), radius=3)
    want = components(range(len(fps)), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want


def test_allocation_keeps_the_pigeonhole_bound():
    import numpy as np

    together = np.full((64, 64), 250) + np.diag(np.full(64, 250))
    for radius in range(0, 12):
        _, groups, thresholds = simhash_dedup.allocate(1000, together, radius)
        assert sorted(b for g in groups for b in g) == list(range(64))
        assert sum(thresholds) == radius - len(groups) + 1


def test_near_duplicates_edge_cases(make, edge):
    rows = simhash_dedup.near_duplicates(make(edge)).collect()
    assert len(rows) == len(edge)
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] == by[3]["fingerprint"] == "0" * 16
    assert by[3]["component_id"] == 1 and by[7]["component_id"] == 6 and by[10]["component_id"] == 9
    assert simhash_dedup.near_duplicates(make([])).collect() == []


def test_components_of_a_long_path(spark):
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(7, 7), (None, 3), (900, 901)], "a long, b long"))
    got = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 900: 900, 901: 900}


def exact(rows, keep=max):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        stay = keep((x for x in ids if x is not None), default=None)
        out.append((i, stay, len(ids), i == stay, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_duplicates(make, edge, documents, keep):
    whole = [(r["doc_id"], r["text"]) for r in documents.collect()]
    for df, rows in ((documents, whole), (make(edge), edge)):
        got = exact_dedup.exact_duplicates(df, keep=keep)
        assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == exact(rows, max if keep == "max" else min)
    assert exact_dedup.exact_duplicates(make([])).collect() == []


def test_a_hot_group_is_dealt_out(spark, make):
    rows = [(i % 700, "copy") for i in range(900)] + [(1000 + i, f"t{i % 60}") for i in range(100)] + [(None, "copy")] * 3
    assert sorted((tuple(r) for r in exact_dedup.exact_duplicates(make(rows)).collect()), key=str) == exact(rows)
    hits = spark.createDataFrame([(b"a", 900), (b"b", 64), (b"c", 65)], "digest binary, n long")
    assert {bytes(r["digest"]): r["parts"] for r in exact_dedup.hot_digests(hits, 1000).collect()} == {b"a": 15, b"c": 2}


def test_equal_digests_of_different_texts_stay_apart(make, edge, monkeypatch):
    monkeypatch.setattr(exact_dedup, "_digest", lambda text: F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 1) == "0").isNull().cast("string").cast("binary"))
    got = exact_dedup.exact_duplicates(make(edge)).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == sorted((x[:4] for x in exact(edge)), key=str)


def test_digest_index_grows_and_compacts(spark, make, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"))
    index.flush(make([(1, "a"), (2, "b"), (3, "a")]), runs=1)
    index.flush(make([(4, "b"), (5, "c")]), runs=1)
    assert [len(level) for level in index.levels] == [2]
    before = {bytes(r["digest"]): (r["keep_id"], r["n"]) for r in index.entries().collect()}
    index.compact()  # the level isn't full
    assert [len(level) for level in index.levels] == [2]
    index.flush(make([(7, "d")]), runs=1)
    index.flush(make([(6, "a")]), runs=1)
    index.compact()
    assert [len(level) for level in index.levels] == [0, 1]
    after = {bytes(r["digest"]): (r["keep_id"], r["n"]) for r in index.entries().collect()}
    digest = lambda t: hashlib.sha256(t.encode()).digest()
    assert before == {digest(t): v for t, v in {"a": (1, 2), "b": (2, 2), "c": (5, 1)}.items()}
    assert after == {digest(t): v for t, v in {"a": (1, 3), "b": (2, 2), "c": (5, 1), "d": (7, 1)}.items()}
    assert sorted((r["row_id"], r["keep_id"]) for r in index.lookup(make([(9, "a"), (8, "z")])).collect()) == [(9, 1)]


def test_filters_let_unshared_rows_pass_by(spark, make, tmp_path):
    """Of four runs only the rows whose digests several of them hold are grouped, a few others apart."""
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"))
    for k in range(3):
        index.flush(make([(1000 * k + i, f"text {k if i >= 20 else 'shared'} {i}") for i in range(500)]), runs=1)
    alone, grouped = index.merged(index.levels[0])
    assert 20 <= grouped.count() <= 40 and alone.count() + grouped.count() == 3 * 480 + 20
    assert {r["n"] for r in alone.collect()} == {1}
    index.flush(make([(9000 + i, f"text {i % 3} {480 + i % 20}") for i in range(100)]), runs=1)
    index.compact()
    assert [len(level) for level in index.levels] == [0, 1] and index.entries().agg(F.sum("n"), F.count("n")).first()[:] == (1600, 1460)


def substring(rows, length):
    rows = sorted(rows, key=lambda r: r[0])
    seen, out = {}, []
    for i, text in rows:
        words = WORD.findall(text or "")
        gone = set()
        for s in range(len(words) - length + 1):
            window = tuple(words[s : s + length])
            if seen.setdefault(window, (i, s)) != (i, s):
                gone.update(range(s, s + length))
        kept = " ".join(w for p, w in enumerate(words) if p not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_repeats_match_brute_force(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = substring_dedup.remove_repeats(documents, length=20)
    assert sorted(map(tuple, got.collect())) == substring(rows, 20)


def test_repeats_in_few_letters(make):
    """Texts over two or three words repeat themselves in every way, one anchor in many extensions."""
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice("abc"[: 2 + k % 2]) for _ in range(rng.randint(0, 150)))) for k in range(60)]
    for length, seed in ((20, 6), (8, 6), (8, 3)):
        got = substring_dedup.remove_repeats(make(rows), length=length, seed=seed).collect()
        assert sorted(map(tuple, got)) == substring(rows, length)


def test_repeats_edge_cases(make, edge):
    once = {i: t for i, t in edge if i is not None}
    got = {r["doc_id"]: tuple(r) for r in substring_dedup.remove_repeats(make(edge), with_text=True).collect()}
    assert {k: v[:4] for k, v in got.items() if k is not None} == {r[0]: r for r in substring(list(once.items()), 20)}
    assert got[10][4] == "" and got[9][4] == "word"
    assert substring_dedup.remove_repeats(make([])).collect() == []
