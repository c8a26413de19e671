"""Cycles, quotas, selection, segments, drift, JSON values, usage trees and redaction against brute force."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import lenient_json
from tessera.operators import cycles, drift, quota, segments, selection, usage_trees
from tessera.operators.graph import call_sites as graph_sites


def planted(rng, nodes, edges):
    """Random calls, cycles of several lengths and chains between them."""
    out = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(edges)]
    for k in range(6):
        ring = rng.sample(range(nodes), k + 2)
        out += list(zip(ring, ring[1:] + ring[:1], strict=True))
    chain = list(range(nodes, nodes + 12))
    return out + list(zip(chain, chain[1:], strict=False)) + [(rng.randrange(nodes), chain[0]), (chain[-1], rng.randrange(nodes))]


def depths(edges):
    nodes = {x for e in edges for x in e}
    out = {n: set() for n in nodes}
    for a, b in edges:
        if a != b:
            out[a].add(b)
    reach = {}
    for n in nodes:
        seen, todo = {n}, [n]
        while todo:
            for m in out[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        reach[n] = seen
    comp = {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}
    memo = {}

    def depth(c):
        if c not in memo:
            memo[c] = max((1 + depth(comp[m]) for n in nodes if comp[n] == c for m in out[n] if comp[m] != c), default=0)
        return memo[c]

    return {n: (comp[n], depth(comp[n])) for n in nodes}


@pytest.mark.parametrize(("seed", "nodes", "edges"), [(1, 30, 20), (2, 60, 55)])
def test_depth_of_planted_cycles(spark, seed, nodes, edges):
    calls = planted(random.Random(seed), nodes, edges)
    df = spark.createDataFrame([*calls, (None, 3), (3, None), calls[0], (5, 5)], "entry_va long, callee_va long")
    got = {r["entry_va"]: (r["component"], r["depth"]) for r in cycles.condensed_depth(df).collect()}
    assert got == depths([*calls, (3, 3), (5, 5)])


@pytest.mark.parametrize(("steps", "most"), [(4, 200_000), (40, 200_000), (40, 10)])
def test_depth_of_pieces_within_cells(spark, monkeypatch, steps, most):
    monkeypatch.setattr(cycles, "CELL_STEPS", steps)
    monkeypatch.setattr(cycles, "MOST_STEPS", most)
    rng = random.Random(steps)
    calls = [(a, b) for k in range(40) for a, b in planted_piece(rng, 10 * k)] + [(11, 205), (205, 390), (390, 12), (57, 58), (58, 57)]
    df = spark.createDataFrame([*calls, calls[0]], "entry_va long, callee_va long")
    got = {r["entry_va"]: (r["component"], r["depth"]) for r in cycles.condensed_depth(df).collect()}
    assert got == depths(calls)


def planted_piece(rng, base):
    return [(base + rng.randrange(6), base + rng.randrange(6)) for _ in range(6)]


def test_close_pieces_need_no_rounds(spark, monkeypatch):
    def no_rounds(*_):
        raise AssertionError("nothing was left for the rounds")

    monkeypatch.setattr(cycles, "_spread", no_rounds)
    calls = [(10 * k + i, 10 * k + i + 1) for k in range(50) for i in range(5)]
    got = {r["entry_va"]: r["depth"] for r in cycles.condensed_depth(spark.createDataFrame(calls, "entry_va long, callee_va long")).collect()}
    assert got == {10 * k + i: 5 - i for k in range(50) for i in range(6)}


@pytest.mark.parametrize("most", [0, 6, 25, 60])
def test_depth_of_pieces_of_every_size(spark, monkeypatch, most):
    # a long tail below rings, rings that call each other, and separate pieces, at addresses that are never close
    monkeypatch.setattr(cycles, "PIECE_STEPS", most)
    monkeypatch.setattr(cycles, "CELL_STEPS", 1)
    rng = random.Random(most)
    calls = planted(rng, 30, 25) + [(100 + i, 101 + i) for i in range(9)] + [(3, 100), (109, 110), (110, 111), (111, 110), (111, 112)]
    calls += [(200 + 10 * k + i, 200 + 10 * k + (i + 1) % 4) for k in range(4) for i in range(4)] + [(201, 220), (222, 234), (300, 302), (302, 301), (301, 302), (302, 303)]
    calls = sorted({(a * 7919 % 100_003, b * 7919 % 100_003) for a, b in calls if a != b})
    df = spark.createDataFrame(calls, "entry_va long, callee_va long")
    got = {r["entry_va"]: (r["component"], r["depth"]) for r in cycles.condensed_depth(df).collect()}
    assert got == depths(calls)


def test_few_calls_left_take_no_further_rounds(spark, monkeypatch):
    monkeypatch.setattr(cycles, "CELL_STEPS", 1)
    rounds, append = [], cycles.Rounds.append
    monkeypatch.setattr(cycles.Rounds, "append", lambda self, df, log, *a: rounds.append(log) or append(self, df, log, *a))
    # a ring with a tail of forty calls
    calls = [(i, i + 1) for i in range(48)] + [(7, 0)]
    df = spark.createDataFrame([(a * 7919 % 100_003, b * 7919 % 100_003) for a, b in calls], "entry_va long, callee_va long")
    got = {r["entry_va"]: r["depth"] for r in cycles.condensed_depth(df).collect()}
    assert got == {i * 7919 % 100_003: 48 - max(i, 7) for i in range(49)} and len(rounds) < 5


def test_separate_rings_take_no_colours(spark, monkeypatch):
    def no_colours(*_):
        raise AssertionError("every piece fits a task")

    monkeypatch.setattr(cycles, "_colours", no_colours)
    monkeypatch.setattr(cycles, "PIECE_STEPS", 8, raising=False)
    monkeypatch.setattr(cycles, "CELL_STEPS", 2)
    # sixty rings of five, each with a way in and a way out, their functions far apart
    ring = lambda k: [(60 * i + k, 60 * ((i + 1) % 5) + k) for i in range(5)] + [(600 + k, k), (k, 900 + k)]
    calls = [c for k in range(60) for c in ring(k)]
    df = spark.createDataFrame([(a * 7919 % 100_003, b * 7919 % 100_003) for a, b in calls], "entry_va long, callee_va long")
    got = {r["entry_va"]: r["depth"] for r in cycles.condensed_depth(df).collect()}
    assert got == {n * 7919 % 100_003: 1 if n < 300 else 2 if n < 900 else 0 for c in calls for n in c}


def giants(rng):
    """Two components of random calls, the first of which leads to the second, each with ways in and out, rings and chains about."""
    calls = [(rng.randrange(40), rng.randrange(40)) for _ in range(400)] + [(100 + rng.randrange(20), 100 + rng.randrange(20)) for _ in range(80)]
    calls += [(i, i + 1) for i in [*range(200, 212), *range(300, 309)]] + [(302, 301), (309, 300), (207, 205), (3, 200), (212, 105), (306, 7), (110, 400), (400, 401), (401, 400), (500, 501), (501, 500)]
    return sorted({(a * 7919 % 100_003, b * 7919 % 100_003) for a, b in calls if a != b})


def test_a_component_with_most_calls_takes_no_colours(spark, monkeypatch):
    def no_colours(*_):
        raise AssertionError("what is left beside the large components fits a task")

    monkeypatch.setattr(cycles, "_colours", no_colours)
    monkeypatch.setattr(cycles, "_pieces", no_colours)
    monkeypatch.setattr(cycles, "PIECE_STEPS", 70)
    monkeypatch.setattr(cycles, "CELL_STEPS", 1)
    calls = giants(random.Random(27))
    df = spark.createDataFrame(calls, "entry_va long, callee_va long")
    got = {r["entry_va"]: (r["component"], r["depth"]) for r in cycles.condensed_depth(df).collect()}
    assert got == depths(calls)


@pytest.mark.parametrize(("most", "rounds"), [(200, 2), (25, 20)])
def test_depth_where_parts_of_large_components_are_found(spark, monkeypatch, most, rounds):
    monkeypatch.setattr(cycles, "PIECE_STEPS", most)
    monkeypatch.setattr(cycles, "GIANT_ROUNDS", rounds)
    monkeypatch.setattr(cycles, "CELL_STEPS", 1)
    calls = giants(random.Random(most + rounds))
    df = spark.createDataFrame(calls, "entry_va long, callee_va long")
    got = {r["entry_va"]: (r["component"], r["depth"]) for r in cycles.condensed_depth(df).collect()}
    assert got == depths(calls)


def test_depth_without_calls_or_cycles(spark):
    schema = "entry_va long, callee_va long"
    assert cycles.condensed_depth(spark.createDataFrame([], schema)).count() == 0
    line = cycles.condensed_depth(spark.createDataFrame([(i, i + 1) for i in range(9)], schema))
    assert {r["entry_va"]: r["depth"] for r in line.collect()} == {i: 9 - i for i in range(10)}
    assert cycles.deepest(line).first()[0] == 9 and cycles.deepest(line, spark.createDataFrame([(4,)], "entry_va long")).first()[0] == 5


def test_neighbourhood_matches_settling_in_order(spark):
    rng = random.Random(3)
    edges = {}
    for _ in range(160):
        a, b = sorted(rng.sample(range(50), 2))
        edges[a, b] = rng.choice([0.1, 0.4, 0.5, 1.0])
    near = {}
    for (a, b), c in edges.items():
        near.setdefault(a, []).append((b, c))
        near.setdefault(b, []).append((a, c))
    df = spark.createDataFrame([(a, b, c) for (a, b), c in edges.items()], "a long, b long, cost double")
    starts = [0, 7, 99]
    for most, shrink in ((15, 0.6), (200, 0.6), (10, None)):
        got = quota.neighbourhood(df, spark.createDataFrame([(s,) for s in starts], "entry_va long"), 1.6, most, shrink)
        for s in starts:
            dist, done = {s: 0.0}, []
            while set(dist) - set(done):
                n = min(set(dist) - set(done), key=lambda x: (dist[x], x))
                done.append(n)
                for m, c in near.get(n, []):
                    d = round(dist[n] + c, 9)
                    if d <= 1.6 + 1e-9 and d < dist.get(m, math.inf):
                        dist[m] = d
            soft = int(0.8 * most)
            reach = 1.6
            if shrink and len(done) >= soft:
                reach = dist[done[soft - 1]] + (1.6 - dist[done[soft - 1]]) * shrink
            want = [(k, n, dist[n]) for k, n in enumerate(done[:most], 1) if k <= soft or dist[n] <= reach + 1e-9]
            assert sorted((r["place"], r["node"], r["dist"]) for r in got.where(F.col("start") == s).collect()) == want
    trace = {r["start"]: r for r in quota.neighbourhood_trace(got, 1.6).collect()}
    assert trace[99]["nodes"] == 1 and not trace[99]["shrunk"]


def test_first_paths_shuffle_the_calls_once(spark):
    calls = spark.range(40_000).selectExpr("id div 4 entry_va", "id div 4 + id % 4 + 1 callee_va")
    starts = spark.createDataFrame([(0,), (500,)], "entry_va long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 20_000)
    try:
        _, once = _shuffled(spark, lambda: calls.repartition("entry_va").write.format("noop").mode("overwrite").save())
        got, wrote = _shuffled(spark, lambda: quota.first_paths(calls.union(calls.limit(50)), starts, 12, 5).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {tuple(r["path"]) for r in got if r["start"] == 0} == {(*range(12), 11 + k) for k in range(1, 5)} | {(*range(11), 12, 13)} and len(got) == 10
    assert wrote < 2.5 * once


def test_first_paths_match_a_depth_first_walk(spark):
    rng = random.Random(4)
    calls = sorted({(rng.randrange(18), rng.randrange(18)) for _ in range(70)})
    out = {}
    for a, b in calls:
        out.setdefault(a, []).append(b)
    df = spark.createDataFrame(calls, "entry_va long, callee_va long")
    for depth, most in ((12, 7), (4, 1000), (3, 1)):
        want = []
        for s in (0, 1, 50):
            found, stack = [], [[s]]
            while stack and len(found) < most:
                path = stack.pop()
                free = [c for c in out.get(path[-1], []) if c not in path]
                if len(path) - 1 >= depth:
                    found.append((path, "max_depth"))
                elif path[-1] not in out:
                    found.append((path, "no_callee"))
                elif not free:
                    found.append((path, "cycle_cut"))
                else:
                    stack += [[*path, c] for c in reversed(free)]
            want += [(s, k, p, len(p) - 1, leaf) for k, (p, leaf) in enumerate(found, 1)]
        got = quota.first_paths(df, spark.createDataFrame([(0,), (1,), (50,)], "entry_va long"), depth, most)
        assert sorted((r["start"], r["place"], r["path"], r["depth"], r["leaf"]) for r in got.collect()) == want


def test_percentiles_are_exact(spark):
    rng = np.random.default_rng(5)
    groups = {"hot": np.concatenate((rng.lognormal(0, 3, 4000), np.full(2000, 1.5))), "one": np.array([7.0]), "two": np.array([1.0, 2.0]), None: np.arange(100.0), "same": np.full(50, -3.0)}
    rows = [(g, float(v), None) for g, vs in groups.items() for v in vs] + [("hot", None, None), ("none", None, None)]
    df = spark.createDataFrame(rows, "name string, v double, u double").repartition(4)
    fractions = [0.0, 0.05, 0.5, 0.9, 0.999, 1.0]
    for accuracy in (10_000, 20):
        got = {(r[0], r["fraction"]): r["value"] for r in selection.percentiles(df.withColumnRenamed("name", "g"), ["g"], ["v", "u"], fractions, accuracy).select("g", "fraction", "value", "name").collect()}
        want = {(g, q): float(np.percentile(vs, 100 * q)) for g, vs in groups.items() for q in fractions}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in want)


@pytest.mark.parametrize(("size", "least", "chunk"), [(5, 1, 7), (6, 3, 6), (12, 2, 1 << 15)])
def test_batches_match_a_fold(spark, size, least, chunk):
    rng = random.Random(6)
    rows = [("a", i, rng.choice([0, 1, 5, 40, 200])) for i in range(150)] + [("b", 1, None), ("b", 2, 500), (None, 1, 3), (None, 2, -3)] + [("c", i, 0) for i in range(20)]
    want = {}
    for group in ("a", "b", None, "c"):
        batch = n = total = 0
        for _, i, t in sorted(r for r in rows if r[0] == group):
            t = max(0, t or 0)
            if n >= size or (total + t > 100 and n >= least):
                batch, n, total = batch + 1, 0, 0
            n, total = n + 1, total + t
            want[group, i] = batch
    df = spark.createDataFrame([(*r, "x") for r in rows], "g string, i long, t long, place string").withColumnRenamed("place", "other").repartition(3)
    got = segments.batches(df, "t", 100, size, "g", ["i"], least, chunk)
    assert {(r["g"], r["i"]): r["batch"] for r in got.collect()} == want and got.count() == len(rows)
    assert segments.batches(df.limit(0), "t", 100, size, "g", ["i"], least, chunk).count() == 0


def _shuffled(spark, work):
    """What ``work`` gives, and the bytes that it wrote to shuffles."""
    def total():
        found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    before = total()
    return work(), total() - before


def test_edge_conditions_cut_code_once_for_guards_and_signals(spark):
    from tessera.operators import graph

    code = spark.createDataFrame([(1, "if (a)\nif  (a)\n" + "x > 3\n" * 3 + "argv rdtsc\nfoo(1)\nrdtsc\nif (b)\nfoo(2)")], "entry_va long, body string")
    calls = spark.createDataFrame([(1, 2, "foo")], "caller_va long, callee_va long, callee_name string")
    found = graph.edge_conditions(code, calls, window=5, most_guards=2)
    assert [tuple(r) for r in found.collect()] == [(1, 2, "ok", 2, 4, ["command_line", "timing"], 6)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("posexplode") == 1


@pytest.fixture(scope="module")
def wide_calls(spark, tmp_path_factory):
    """Tables in which customer 1 orders the parts 2 to 5 and 14, customer 2 the parts 3 and 4 and again 1 and 6."""
    at = tmp_path_factory.mktemp("wide")
    pairs = [(1, 2), (1, 3), (1, 4), (1, 5), (1, 14), (2, 3), (2, 4), (2, 1), (2, 6)]
    spark.createDataFrame([(k, c) for k, (c, _) in enumerate(pairs)], "o_orderkey long, o_custkey long").write.parquet(str(at / "orders.parquet"))
    spark.createDataFrame([(k, p, 1) for k, (_, p) in enumerate(pairs)], "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(str(at / "lineitem.parquet"))
    return str(at)


_FROM_1 = {"1>2": "cycle_cut", "1>2>3": "no_callee", "1>2>4": "no_callee", "1>2>6": "no_callee", "1>3": "no_callee", "1>4": "no_callee", "1>5": "no_callee", "1>14": "no_callee"}
_FROM_2 = {"2>1": "cycle_cut", "2>1>3": "no_callee", "2>1>4": "no_callee", "2>1>5": "no_callee", "2>1>14": "no_callee", "2>3": "no_callee", "2>4": "no_callee", "2>6": "no_callee"}


def test_simple_paths_follow_every_callee(spark, wide_calls):
    from tessera.plans import queries

    got = queries.simple_paths(spark, wide_calls).collect()
    assert {r["path"]: r["leaf"] for r in got} == _FROM_1 | _FROM_2 and len(got) == 16


def test_paths_within_nodes_follow_every_callee(spark, wide_calls):
    from tessera.plans import queries

    got = sorted(r["path"] for r in queries.paths_within_nodes(spark, wide_calls).collect())
    assert got == sorted(p for p in _FROM_1 | _FROM_2 if not {"4", "14"} & set(p.split(">")))


def test_edge_conditions_count_every_site_and_guard(spark):
    from tessera.operators import graph

    # ten guards before eight sites, then a site far down whose window holds one guard, over the edge of a stretch
    lines = [f"if (a{k})" for k in range(10)] + ["foo(1)"] * 8 + ["y = 1;"] * 40 + ["if (z)", "rdtsc"] + ["y = 2;"] * 16 + ["foo(2)"]
    code = spark.createDataFrame([(1, "\n".join(lines))], "entry_va long, body string")
    calls = spark.createDataFrame([(1, 2, "foo")], "caller_va long, callee_va long, callee_name string")
    assert [tuple(r) for r in graph.edge_conditions(code, calls).collect()] == [(1, 2, "ok", 9, 81, ["timing"], 82)]


def test_usage_snippets_do_not_shuffle_every_line(spark):
    from tessera.operators import contexts

    code = spark.range(300).selectExpr("id entry_va", "concat_ws('\n', transform(sequence(1, 200), i -> if(i = 100, 'call fn_1', concat(md5(string(id * 1000 + i)), md5(string(i + id)))))) body")
    code = code.unionByName(spark.createDataFrame([(299, "other\nfn_0\nlast"), (299, None)], "entry_va long, body string"))
    uses = spark.range(300).selectExpr("id caller_va", "1L callee_va", "'fn_1' callee_name").unionByName(spark.createDataFrame([(299, 0, "fn_0")], "caller_va long, callee_va long, callee_name string"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        _, sites = _shuffled(spark, lambda: graph_sites(code, uses).collect())
        _, whole = _shuffled(spark, lambda: code.repartition("entry_va").write.format("noop").mode("overwrite").save())
        got, wrote = _shuffled(spark, lambda: contexts.usage_snippets(code, uses).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    found = {(r["caller_va"], r["callee_va"]): r["snippet"].split("\n") for r in got}
    assert len(got) == 301 and [len(s) for s in found.values()].count(3) == 300
    assert found[5, 1][1] == "call fn_1" and len(found[299, 0]) == 6 and {"other", "fn_0", "last"} < set(found[299, 0])
    assert wrote - sites < 1.5 * whole


def test_drift_of_many_leaves_shuffles_narrow_rows(spark):
    one = spark.range(60_000).selectExpr("id div 2 k", "id % 2 m", "concat('text ', id) t")
    two = one.withColumn("t", F.when(F.col("k") % 100 == 0, "other").otherwise(F.col("t")))
    got, wrote = _shuffled(spark, lambda: drift.changed_rows(one, two, ["k", "m"], ["k", "m", "t"], bits=4).groupBy("change").count().collect())
    assert [tuple(r) for r in got] == [("changed", 600)]
    assert wrote < 120_000 * 55


def test_drift_of_a_key_with_many_rows(spark):
    one = spark.range(20_000).selectExpr("1 k", "id % 3 t")
    two = one.unionByName(spark.range(1).selectExpr("1 k", "0L t"))
    assert [tuple(r) for r in drift.changed_rows(one, two, ["k"], ["k", "t"]).collect()] == [(1, "changed")]
    assert drift.changed_rows(one, one, ["k"], ["k", "t"]).count() == 0


def test_drift_down_to_the_rows(spark):
    rng = random.Random(7)
    one = [(i, rng.choice(["x", "y", "", None]), i % 7) for i in range(500)] + [(None, "n", 1), (9, "again", 2), (9, "again", 2)]
    two = [r for r in one if r[0] not in (3, 4)]
    two = [(i, None if i == 20 and t == "" else (t or "") + "!", n) if i in (10, 11, 20) else (i, t, n) for i, t, n in two] + [(1000, "new", 0), (12, "second", 0)]
    two.remove((9, "again", 2))
    schema, key, columns = "id long, t string, n int", ["id"], ["id", "t", "n"]
    a, b = spark.createDataFrame(one, schema), spark.createDataFrame(two, schema)
    got = {r["id"]: r["change"] for r in drift.changed_rows(a, b, key, columns, bits=8).collect()}
    assert got == {3: "removed", 4: "removed", 10: "changed", 11: "changed", 20: "changed", 1000: "added", 12: "changed", 9: "changed"}
    assert drift.changed_rows(a, a, key, columns).count() == 0 and drift.changed_rows(a, a.limit(0), key, columns).count() == a.select("id").distinct().count()
    gone, come = a.exceptAll(b), b.exceptAll(a)
    kept_up = drift.updated(drift.leaves(a, key, columns, 8), gone, come, key, columns, 8)
    assert drift.differing_leaves(kept_up, drift.leaves(b, key, columns, 8), 8).count() == 0
    assert drift.differing_leaves(drift.leaves(a, key, columns, 8), drift.leaves(b, key, columns, 8), 8).count() > 0


def first_value(text, preferred):
    """Every place tried in turn with the library's own decoder."""
    first, kinds = None, {"object": dict, "array": list, None: object}
    for t in [text] + ([text.replace("\n", " ")] if "\n" in text else []):
        tries = [t.lstrip()] + [t[i:] for i, c in enumerate(t) if c in ({"object": "{", "array": "["}.get(preferred, "{["))]
        for part in tries:
            try:
                value, _ = json.JSONDecoder().raw_decode(part)
            except ValueError:
                continue
            if isinstance(value, kinds[preferred]):
                return True, value
            first = first or (True, value)
    return first or (False, None)


def test_json_values_match_trying_every_place(spark):
    rng = random.Random(8)
    pieces = ['{"a": ', "[", "]", "}", '"', "1", ", ", "null", "\n", " x ", '"b": ', '"s\\"{"', "-0.5e3", "{", ":", "NaN", "true", '{"k": [1, {"z": "]"}]}']
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    texts += ['argument [0] means\n{"answer": [1]}', '{"a": "line\nend"}', "", "   ", "[[[[1]", '["[1', '{"a": 1} {"b": 2}', "5 then [1]", "-"]
    for preferred in (None, "object", "array"):
        for t in texts:
            assert repr(lenient_json.value_in(t, preferred)) == repr(first_value(t, preferred)), (t, preferred)
    df = spark.createDataFrame([(None, 1), ("<think>[9]</think> {\"b\": 2, \"a\": 1}", 2), ("no", 3), ("say [1] {\"a\": {}}", 4)], "answer string, value_ int")
    assert [r["value"] for r in lenient_json.json_values(df, "answer", "object").orderBy("value_").collect()] == [None, '{"a":1,"b":2}', None, '{"a":{}}']


def test_json_scan_takes_time_in_proportion():
    import time

    for text in ("[" * 300_000, '{"a":' * 100_000, "[{" * 150_000, '["x",' * 100_000, "{" * 300_000, "[1] " * 1):
        began = time.perf_counter()
        lenient_json.value_in(text)
        assert time.perf_counter() - began < 5


def test_usage_sums_of_nested_reports(spark):
    tree = {"token_usage": {"prompt_tokens": 10, "completion_tokens": "5", "api_calls": 1}, "steps": [{"usage": {"prompt_tokens": 99}}], "more": [{"usage": {"total_tokens": 3}, "usage_records": [{"usage": {"total_tokens": 50}}], "deep": {"x": [[{"usage": {"prompt_tokens": 2}}]]}}, {"usage": {"other": 1}}, 7, None]}
    rows = [(1, json.dumps(tree)), (1, json.dumps([{"usage": {"failed_api_calls": 2, "prompt_tokens": "bad"}}])), (2, None), (3, "not json"), (4, json.dumps({"a": 1})), (5, json.dumps({"token_usage": 4, "usage": {"prompt_tokens": None, "total_tokens": 6}}))]
    got = {r["id"]: [r[k] for k in usage_trees.KEYS] for r in usage_trees.usage_sums(spark.createDataFrame(rows, "id long, report string"), ["id"], "report").collect()}
    assert got == {1: [12.0, 5.0, 20.0, 1.0, 0.0, 2.0], 5: [0.0, 0.0, 6.0, 0.0, 0.0, 0.0]}
    assert usage_trees.usage_sums(spark.createDataFrame([], "id long, report string"), ["id"], "report").count() == 0


def _jobs(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    try:
        return work(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_usage_sums_of_deep_reports_take_no_round_for_each_depth(spark):
    deep = {"usage": {"prompt_tokens": 1, "api_calls": 2}}
    for _ in range(120):
        deep = {"usage": {"prompt_tokens": 1}, "steps": [deep], "usage_records": [{"usage": {"prompt_tokens": 9}}]}
    odd = '{"usage": {"prompt_tokens": "0x", "api_calls": "NaN", "total_tokens": true}, "a": [{"usage": {"prompt_tokens": null}}, {"usage": []}, {"token_usage": {}, "steps": {"usage": {"api_calls": 1}}}, {"usage": {"prompt_tokens": "1e2", "completion_tokens": 0.25}}]}'
    rows = spark.createDataFrame([("d", json.dumps(deep)), ("o", odd), ("e", '{"usage": {"prompt_tokens": {"x": 1}}, "token_usage": {}}'), ("s", '"usage"'), ("t", '{"usage": {"api_calls": 1}, "usage": {"api_calls": 2}}')], "id string, report string")
    got, jobs = _jobs(spark, "deep", lambda: {r["id"]: [r[k] for k in usage_trees.KEYS] for r in usage_trees.usage_sums(rows, ["id"], "report").collect()})
    assert got == {"d": [121.0, 0.0, 121.0, 2.0, 0.0, 0.0], "o": [100.0, 0.25, 100.25, 0.0, 0.0, 0.0], "e": [0.0] * 6}
    assert jobs < 10


def test_redaction_of_nested_values(spark):
    df = spark.sql("select 1 id, named_struct('Api_Key', 'k', 'in', array(named_struct('token_id', 5, 'x', 1))) a, map('password', 'p', 'b', 'c') m, map('secret', 1, 'n', 2) i, cast(null as struct<password: string>) e, 's' my_secret")
    r = usage_trees.redact(df).first().asDict(True)
    assert r == {"id": 1, "a": {"Api_Key": "<redacted>", "in": [{"token_id": "<redacted>", "x": 1}]}, "m": {"password": "<redacted>", "b": "c"}, "i": {"secret": None, "n": 2}, "e": None, "my_secret": "<redacted>"}
    rows = [('{"a": [{"TOKEN": {"x": 1}, "b": "ü"}]}', 1), (None, 2), ("{", 3)]
    got = usage_trees.redacted_json(spark.createDataFrame(rows, "t string, k int"), "t").orderBy("k").collect()
    assert [x["t"] for x in got] == ['{"a":[{"TOKEN":"<redacted>","b":"ü"}]}', None, None]


def test_rescoring_reads_the_tables_as_they_are(spark, tmp_path):
    from tessera.plans.queries import incremental_rescore

    for size, rows in (("0.001", 200), ("0.01", 2000)):
        for name in ("part", "lineitem"):
            spark.read.parquet(f"/root/testdata/sf{size}/{name}.parquet").write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        spark.catalog.clearCache()
        whole = spark.read.parquet(f"{tmp_path}/part.parquet").count()
        assert incremental_rescore(spark, str(tmp_path)).count() == whole >= rows


def test_call_sites_of_names_of_every_shape(spark):
    from tessera.operators import graph

    body = "a\\Eb(x);\nfoo_bar(1); foo()\nxfoo(); foo\nstd::sort(v); xstd::sort\n?x@@Y(1)\nf.o.o\nfoo\nfoo\nfoo\nfoo\nfoo"
    names = {1: "foo", 2: "std::sort", 3: "?x@@Y", 4: "a\\Eb", 5: "f.o", 6: "none", 7: "", 8: None, 9: "x"}
    calls = spark.createDataFrame([(1, k, n) for k, n in names.items()] + [(1, 1, "foo")], "caller_va long, callee_va long, callee_name string")
    code = spark.createDataFrame([(1, body), (2, None)], "entry_va long, body string")
    got = {}
    for r in graph.call_sites(code, calls, 4).collect():
        got.setdefault(r["callee_va"], []).append(r["call_line"])
    assert {k: sorted(v) for k, v in got.items()} == {1: [1, 2, 6, 7], 2: [3], 3: [4], 4: [0], 5: [5], 9: [0, 4]}
    found = {r["callee_va"]: r["status"] for r in graph.edge_conditions(code, calls.unionByName(calls.limit(1).selectExpr("2L caller_va", "1L callee_va", "'foo' callee_name"))).where("caller_va = 2 or callee_va in (1, 6)").collect()}
    assert found[6] == "callsite_not_found" and set(found.values()) >= {"callsite_not_found"}


def test_contexts_of_functions_without_anything(spark):
    from tessera.operators import contexts

    nodes = spark.createDataFrame([(16, None), (32, "g")], "entry_va long, name string")
    none = spark.createDataFrame([], "entry_va long, signature string, summary string")
    code = spark.createDataFrame([(32, "x = 1;\nsub_00000010(x);\n")], "entry_va long, body string")
    calls = spark.createDataFrame([(32, 16), (32, 16), (32, 99)], "entry_va long, callee_va long")
    got = {r["entry_va"]: r for r in contexts.validation_context(nodes, none, code, calls).collect()}
    assert got[16]["callers"] == 1 and "x = 1;\nsub_00000010(x);" in got[16]["context"] and got[16]["context"].startswith("sub_00000010 @ 0x00000010")
    assert got[32]["callees"] == 1 and "none seen" in got[32]["context"]
    binaries = spark.createDataFrame([(3,)], "id int")
    assert contexts.picked_binary(binaries) == 3 and contexts.picked_binary(binaries, 5) == 5
    with pytest.raises(ValueError):
        contexts.picked_binary(binaries.limit(0))
    assert contexts.reusable(spark.createDataFrame([("aligned",), ("failed",), (None,)], "status string")).count() == 1
