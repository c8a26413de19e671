"""Validation waves and dependent generations against brute force, stopped and gone on with."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import waves
from tessera.sources.store import Store

RNG = random.Random(11)
CALLS = sorted({(RNG.randrange(40), RNG.randrange(40)) for _ in range(90)})
OUT = {}
for _a, _b in CALLS:
    if _a != _b:
        OUT.setdefault(_a, []).append(_b)
ENTRIES, PENDING, HELD = [1, 2, 3, 4, 5, 6, 9], {n for n in range(40) if n % 7 != 3}, {n for n in range(40) if n % 9 == 4}
CONFIDENCE = {n: (n * 37 % 100) / 100 for n in range(40)}


def expected():
    met, front, wave = {}, dict.fromkeys(ENTRIES, 100.0), 0
    while front:
        for n, priority in front.items():
            outcome = "skipped" if n not in PENDING else "locked" if n in HELD else "failed" if n % 5 == 1 else "validated"
            met[n] = (wave, priority, outcome)
        told = {}
        for n in front:
            conf = {"locked": 0.9, "validated": CONFIDENCE[n]}.get(met[n][2])
            if met[n][2] == "locked" or (met[n][2] == "validated" and conf > 0.6):
                for m in OUT.get(n, []):
                    if m not in met and (met[n][2] != "locked" or m in PENDING):
                        told[m] = max(told.get(m, 0), conf * 100)
        front, wave = told, wave + 1
    # the second try judges those whose address is 1 above a multiple of ten
    return sorted((n, w, round(p, 6), "validated" if o == "failed" and n % 10 == 1 else o) for n, (w, p, o) in met.items())


@pytest.fixture
def program(spark):
    calls = spark.createDataFrame([*CALLS, (1, None), (None, 2)], "entry_va long, callee_va long")
    frame = lambda ns: spark.createDataFrame([(n,) for n in ns], "entry_va long")
    return frame([*ENTRIES, 1, None]), frame(PENDING), frame(HELD), calls


def analyst(spark, asked_before):
    known = spark.createDataFrame(list(CONFIDENCE.items()), "entry_va long, confidence double")

    def ask(asked):
        asked_before.append(sorted(r[0] for r in asked.select("entry_va").collect()))
        again = len(asked_before) > 1 and all(n % 5 == 1 for n in asked_before[-1])
        could = asked.where(F.col("entry_va") % 10 == 1) if again else asked.where(F.col("entry_va") % 5 != 1)
        return could.join(known, "entry_va").select("entry_va", F.lit("CONFIRM").alias("action"), F.lit("seen").alias("note"), "confidence")

    return ask


def rows(met):
    return sorted((r["entry_va"], r["wave"], round(r["priority"], 6), r["outcome"]) for r in met.collect())


def test_waves_match_brute_force_and_go_on_where_they_stopped(spark, program, tmp_path):
    whole = waves.validate(Store(spark, f"{tmp_path}/a"), *program, analyst(spark, []))
    assert rows(whole) == expected()
    store, asked = Store(spark, f"{tmp_path}/b"), []
    ask = analyst(spark, asked)

    def dies(frame):
        raise RuntimeError("stopped")

    waves.validate(store, *program, ask, most_waves=2)
    with pytest.raises(RuntimeError):
        waves.validate(store, *program, dies)
    spark.range(3).write.parquet(f"{tmp_path}/b/wave_000002/vhalf")  # a wave that was written and not committed
    assert rows(waves.validate(store, *program, ask)) == expected()
    count = len(asked)
    assert rows(waves.validate(store, *program, ask)) == expected() and len(asked) == count
    # nobody is asked about twice but those that failed
    flat = [n for batch in asked for n in batch]
    assert all(flat.count(n) == (2 if n % 5 == 1 else 1) for n in set(flat))


def test_waves_without_entries_and_status_after_them(spark, program, tmp_path):
    entries, pending, held, calls = program
    assert waves.validate(Store(spark, f"{tmp_path}/c"), entries.limit(0), pending, held, calls, analyst(spark, [])).count() == 0
    met = waves.validate(Store(spark, f"{tmp_path}/d"), entries, pending, held, calls, analyst(spark, []))
    functions = spark.createDataFrame([(10, 2), (11, 2), (12, 39)], "id long, entry_va long")
    status = spark.createDataFrame([(10, "ANALYZED", None), (11, "PENDING", "text"), (12, "ANALYZED", "x")], "function_id long, analysis_state string, semantic_summary string")
    got = {r["function_id"]: (r["analysis_state"], r["semantic_summary"]) for r in waves.status_after(status, functions, met).collect()}
    want39 = next((o for n, _, _, o in expected() if n == 39), None)
    assert got[10] == ("LOCKED", "seen") and got[11] == ("LOCKED", "text\nseen") and (got[12][0] == "LOCKED") == (want39 == "validated")


NAMES = {n: ["alpha_beta", "beta_gamma", "gamma_delta", "delta_alpha"][n % 4] for n in range(40)}


def walk(goal, most, reach, tokens):
    """One goal's generations in plain Python."""
    near, calls_into = {}, {}
    for a, b in CALLS:
        if a != b:
            near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = 1.0
            calls_into.setdefault(b, set()).add(a)

    def around(root):
        dist, done = {root: 0.0}, []
        while set(dist) - set(done):
            n = min(set(dist) - set(done), key=lambda x: (dist[x], x))
            done.append(n)
            for m in near.get(n, {}):
                if dist[n] + 1 <= reach.radius + 1e-9:
                    dist[m] = min(dist.get(m, math.inf), dist[n] + 1)
        soft = int(0.8 * reach.max_nodes)
        limit = reach.radius if len(done) < soft else dist[done[soft - 1]] + (reach.radius - dist[done[soft - 1]]) * 0.6
        return {n for k, n in enumerate(done[: reach.max_nodes], 1) if k <= soft or dist[n] <= limit + 1e-9}

    def paths_from(root):
        found, stack = [], [[root]]
        while stack and len(found) < reach.max_paths:
            path = stack.pop()
            free = [c for c in sorted(OUT.get(path[-1], [])) if c not in path]
            if len(path) > reach.max_depth or not free:
                found.append(path)
            else:
                stack += [[*path, c] for c in reversed(free)]
        return found

    def above(anchor):
        hop, front = {anchor: 0}, [anchor]
        for d in range(1, reach.ancestor_depth + 1):
            front = [p for p in {q for n in front for q in calls_into.get(n, ())} if p not in hop]
            hop |= dict.fromkeys(front, d)
        words = lambda n: set(NAMES[n].split("_")) | {NAMES[n]}
        weigh = {}
        for p, d in hop.items():
            if d:
                a, b = {NAMES[p]}, {NAMES[anchor]}  # names are one word of letters and underscores each
                weigh[p] = round(math.exp(-0.35 * d) / (1 + 0.2 * len(calls_into.get(p, ()))) * (1 + 0.5 * len(a & b) / len(a | b)), 6)
        ranked = sorted(weigh, key=lambda p: (-weigh[p], p))
        if not ranked:
            return [anchor]
        return ranked[:1] if weigh[ranked[0]] >= reach.least_weight else ranked[: reach.frontier]

    out, covered, spent, paths, nodes = [], set(), 0, [], set()
    for k in range(1, most + 1):
        if k == 1:
            roots = {goal}
        else:
            score = {}
            for path in sorted(paths)[:12]:
                for n in path[1]:
                    score[n] = score.get(n, 0) + 5
            for n in nodes:
                score[n] = score.get(n, 0) + n % 9
            score[goal] = score.get(goal, 0) + 50
            best = sorted(score, key=lambda n: (-score[n], n))[:6]
            roots = {r for a in best for r in above(a)}
            roots = roots - covered or roots
        union = {n for r in roots for n in around(r)}
        new = union - covered
        add = sum(tokens[n] for n in new)
        stop = None
        if k > 1:
            stop = "saturated" if k > 2 and len(new) / max(1, len(covered)) < reach.least_new else "budget" if reach.token_budget and spent + add > reach.token_budget else None
        if stop:
            out.append((goal, k, len(roots), len(union), len(new), 0, 0, stop))
            break
        paths = []
        for r in sorted(roots):
            own = paths_from(r)
            inside = [p for p in own if set(p) <= union]
            paths += [((r, own.index(p)), p) for p in inside or own]
        covered |= union
        nodes, spent = union, spent + add
        out.append((goal, k, len(roots), len(union), len(new), len(paths), add, "most" if k == most else None))
    return out


@pytest.mark.parametrize("budget", [0, 250])
def test_generations_match_brute_force_and_go_on_where_they_stopped(spark, tmp_path, budget):
    reach = waves.Reach(radius=1.4, max_nodes=9, max_depth=4, max_paths=15, ancestor_depth=2, least_weight=0.3, frontier=2, least_new=0.4, token_budget=budget)
    goals, tokens = {1: 4, 2: 3, 7: 1, 30: 4, 38: 2}, {n: n * 3 % 50 for n in range(40)}
    calls = spark.createDataFrame(CALLS, "entry_va long, callee_va long").where("entry_va != callee_va")
    edges = calls.select(F.least("entry_va", "callee_va").alias("a"), F.greatest("entry_va", "callee_va").alias("b"), F.lit(1.0).alias("cost")).distinct()
    facts = spark.createDataFrame([(n, [NAMES[n]], tokens[n], n % 9) for n in range(40)], "entry_va long, names array<string>, tokens int, richness int")
    asked = spark.createDataFrame([*goals.items(), (None, 2)], "entry_va long, most int")
    want = sorted(x for g, most in goals.items() for x in walk(g, most, reach, tokens))
    key = lambda r: (r["goal"], r["generation"])
    store = Store(spark, f"{tmp_path}/a")
    assert waves.generations(store, asked, calls, edges, facts, reach, most_steps=0).count() == 0
    waves.generations(store, asked, calls, edges, facts, reach, most_steps=2)
    got = waves.generations(Store(spark, f"{tmp_path}/a"), asked, calls, edges, facts, reach)
    assert [tuple(r) for r in sorted(got.collect(), key=key)] == want
    assert {x[7] for x in want} >= {"most", "budget" if budget else "saturated"}
