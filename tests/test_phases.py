"""Globals named in steps, agreement of two views and references of chosen functions against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import phases
from tessera.sources.store import Store

RNG = random.Random(5)
GLOBALS = {v: RNG.sample([f"z_{v}", f"g_{v}", f"a_{v}"], RNG.randrange(3)) for v in range(60)}
SCORES = {v: RNG.randrange(1, 9) for v in range(60) if v % 8 != 1}
TOLD = {v: "x" * RNG.randrange(0, 400) for v in range(60) if v % 9 != 2}
KNOWN = [(v, f"k{v}", None, "ANALYZED" if v % 2 else "PENDING", 1, "before") for v in range(0, 60, 5)] + [(99, "far", None, "PENDING", 2, "before")]


def answer(v):
    name = {0: "ok_name\t", 1: "no name", 2: "", 3: None, 4: "x" * 256}[v % 5]
    return None if v % 7 == 3 else (name, " t " if v % 2 else "  ", f"r{v} ", {0: "0.29", 1: None, 2: "much"}[v % 3])


def plan(batch, budget, most):
    done = {v for v, *_, state, _, _ in KNOWN if state == "ANALYZED"}
    order = sorted((v for v in SCORES if v not in done), key=lambda v: (-SCORES[v], v))[:most]
    out, size, tokens, k = {}, 0, 0, -1
    for v in order:
        t = -(-len(TOLD.get(v, "")) // 4)
        if k < 0 or size == batch or tokens + t > budget:
            k, size, tokens = k + 1, 0, 0
        out[v], size, tokens = k, size + 1, tokens + t
    return out


def expected(batches):
    out = []
    for v, k in batches.items():
        if (a := answer(v)) is None:
            out.append((v, k, SCORES[v], None, None, None, None, "FAILED"))
            continue
        name = "ok_name" if v % 5 == 0 else min(GLOBALS[v], default=f"g_{v:08X}")
        confidence = int((0.29 if v % 3 == 0 else 0.8) * 100)
        out.append((v, k, SCORES[v], name, a[1].strip() or None, confidence, a[2].strip(), "ANALYZED"))
    return sorted(out)


@pytest.fixture
def given(spark):
    df = spark.createDataFrame
    known = "address_va long, name string, guessed_type string, analysis_state string, confidence_score int, reasoning string"
    return df(list(GLOBALS.items()), "global_va long, names array<string>"), df(list(SCORES.items()), "global_va long, score int"), df(list(TOLD.items()), "global_va long, context string"), df(KNOWN, known)


def analyst(asked):
    spark = asked.sparkSession
    rows = [(v, *a) for v in GLOBALS if (a := answer(v)) is not None]
    return asked.select("global_va").join(spark.createDataFrame(rows, "global_va long, name string, type string, reason string, confidence string"), "global_va")


@pytest.mark.parametrize("most", [None, 13])
def test_globals_are_named_in_steps(spark, tmp_path, given, most):
    batches = plan(5, 150, most)
    assert len(set(batches.values())) > 2
    store = Store(spark, str(tmp_path / "s"))
    run = lambda **kw: phases.name_globals(store, *given, analyst, most=most, batch=5, budget=150, step=2, **kw)
    first = {r["batch"] for r in run(most_steps=1).collect()}
    assert first == {0, 1}

    def broken(asked):
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):  # within a step: nothing of it is kept
        phases.name_globals(store, *given, broken, most=most, batch=5, budget=150, step=2)
    got = run()
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == expected(batches)
    assert {r["batch"] for r in phases.name_globals(store, *given, broken, most=most, batch=5, budget=150, step=2).collect()} == set(batches.values())  # nobody is asked again
    after = {r["address_va"]: r for r in phases.globals_after(given[3], got).collect()}
    named = {v for v in batches if answer(v) is not None}
    assert set(after) == named | {r[0] for r in KNOWN} and len(after) == phases.globals_after(given[3], got).count()
    assert all(after[r[0]]["reasoning"] == ("before" if r[0] not in named else answer(r[0])[2].strip()) for r in KNOWN)
    # the next run asks for what failed or was left over
    again = phases.name_globals(store, *given[:3], phases.globals_after(given[3], got), analyst, name="next")
    assert {r["global_va"] for r in again.collect()} == {v for v in SCORES if v not in named and (v, "ANALYZED") not in {(r[0], r[3]) for r in KNOWN}}


def test_a_long_plan_takes_few_steps(spark, tmp_path, given, monkeypatch):
    monkeypatch.setattr(phases, "MOST_STEPS", 3, raising=False)
    store = Store(spark, str(tmp_path / "s"))
    run = lambda **kw: phases.name_globals(store, *given, analyst, batch=1, step=1, **kw)
    first = run(most_steps=1).count()
    got = run().collect()
    batches = plan(1, 8000, None)
    assert sorted(map(tuple, got), key=lambda r: r[0]) == expected(batches) and 1 < first < len(batches)
    assert len([t for t in store.tables() if t.startswith("globals_step")]) <= 3


def test_no_globals(spark, tmp_path, given):
    none = [df.limit(0) for df in given]
    got = phases.name_globals(Store(spark, str(tmp_path / "s")), *none, analyst)
    assert got.count() == 0 and phases.globals_after(given[3], got).count() == len(KNOWN)


def test_references_of_chosen_functions(spark):
    rng = random.Random(8)
    df = spark.createDataFrame
    functions = [(i, 1 + i % 2, 16 * (i // 2)) for i in range(20)]
    instructions = [(1 + f % 2, f, 1000 + 10 * f + k) for f in range(20) for k in range(5)]
    strings = [(view, 5000 + k, "" if k == 3 else f"s{k}") for view in (1, 2) for k in range(8)]
    outer = ["puts", "sub_12", "LOC_9", "deadbeef", " exit ", "", None, "0x10", "20", "add"]
    xrefs = [(v, a, rng.choice([16 * rng.randrange(12), 5000 + rng.randrange(9), None]), rng.choice(outer), rng.choice(["17", "READ", "COMPUTED_CALL"])) for v, _, a in instructions for _ in range(3)]
    chosen = [0, 16, 48, 999 * 16]
    got = phases.hydrated(df([(c,) for c in [*chosen, 16]], "entry_va long"), df(xrefs, "view_id int, src_va long, dst_va long, dst_name string, ref_type_raw string"), df(instructions, "view_id int, function_id long, address_va long"), df(functions, "id long, view_id int, entry_va long"), df(strings, "view_id int, address_va long, value string"), 3, 2, 2).collect()
    entry = {i: e for i, _, e in functions}
    owner, nodes, text = {(v, a): entry[f] for v, f, a in instructions}, set(entry.values()), {(v, a): s for v, a, s in strings}
    want = {c: (set(), set(), set()) for c in chosen}
    for v, src, dst, name, kind in xrefs:
        of = owner[v, src]
        if of not in want:
            continue
        if text.get((v, dst)):
            want[of][0].add(text[v, dst])
        if kind == "READ":
            continue
        raw = (name or "").strip()
        try:
            read = int(raw, 16)
        except ValueError:
            read = None
        target = dst if dst in nodes else read if read in nodes else None
        if target is not None:
            if target != of:
                want[of][1].add(target)
        elif raw and raw != "deadbeef" and not raw.lower().startswith(("sub_", "loc_", "label_")):
            want[of][2].add(raw)
    assert {r["entry_va"]: (r["strings"], r["callees"], r["external"]) for r in got} == {c: (sorted(s)[:3], sorted(i)[:2], sorted(x)[:2]) for c, (s, i, x) in want.items()}
    assert len(got) == len(chosen) and want[0][0] and want[0][1] and any(w[2] for w in want.values())


def test_consensus_takes_the_first_of_each_side(spark):
    df = spark.createDataFrame
    functions = df([(1, 1, 16, "same"), (2, 2, 16, "Same "), (3, 2, 16, "later"), (4, 1, 32, "alone"), (5, 3, 32, "other binary"), (6, 1, 48, None), (7, 4, 48, "x")], "id long, view_id long, entry_va long, name string")
    code = df([(1, 9, "b(c)"), (1, 8, "f(a1)"), (2, 7, "f(a1)"), (3, 70, "nothing"), (4, 2, "x"), (5, 3, "x"), (6, 4, None), (7, 5, "y")], "function_id long, code_id long, body string")
    views = df([(1, 1, 1), (2, 1, 2), (3, 2, 2), (4, 1, 3)], "id long, binary_id long, tool_id long")
    tools = df([(1, "Ghidra 11"), (2, "IDA Pro"), (3, "ida")], "id long, name string")
    agreed = phases.consensus(functions, code, views, tools, 1)
    got = {r["entry_va"]: r for r in agreed.collect()}
    assert set(got) == {16, 48}
    assert got[16]["agreement_score"] == 1.0 and (got[16]["code_a"], got[16]["name_b"]) == ("f(a1)", "Same ")
    # no token in common, no callees, strings or variables on either side, a name missing
    assert got[48]["agreement_score"] == pytest.approx(0.25 + 0.20 + 0.15 + 0.05)
    assert tuple(phases.consensus_summary(agreed).first()) == (2, pytest.approx(0.825), 1, 0)
    assert tuple(phases.consensus_summary(phases.consensus(functions, code, views, tools, 2)).first()) == (0, None, 0, 0)


def test_nearest_rows_say_what_is_left_out(spark):
    near = spark.createDataFrame([(s, p, 10 * s + p, p / 10) for s, n in ((1, 3), (2, 5)) for p in range(1, n + 1)], "start long, place int, node long, dist double")
    got = phases.nearest_rows(near, 3).groupBy("start").agg(F.count("*"), F.max("total"), F.first("truncated")).orderBy("start").collect()
    assert list(map(tuple, got)) == [(1, 3, 3, False), (2, 3, 5, True)]
