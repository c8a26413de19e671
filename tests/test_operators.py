"""Operators on small hand-made graphs and records."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import annotate, graph, metrics, ranking, reconcile, rules, status, unify


def rows(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


@pytest.fixture
def calls(spark):
    return spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (5, 5)], "entry_va long, callee_va long")


def test_scores(spark):
    nodes = spark.createDataFrame(
        [(1, ["a"], ["f", "g"], ["s"], [2], [], 10), (2, ["b"], [], [], [], [1], 0), (3, ["c"], [], [], [4, 5, 6], [1, 2, 4, 5, 6, 7, 8], 400)],
        "entry_va long, names array<string>, external_callees array<string>, string_refs array<string>, callees array<long>, callers array<long>, instr_count int")
    c = spark.createDataFrame([(1, 2)], "entry_va long, callee_va long")
    done = spark.createDataFrame([(2,)], "entry_va long")
    got = dict(rows(ranking.scores(nodes, c, done), "entry_va", "score"))
    assert got == {1: 280 + 135 + 36 + 0 + 15 + 25, 2: 60 + 6 - 20, 3: 28 + 40 - 25}
    assert [r.entry_va for r in ranking.entry_points(nodes, [], 1).collect()] == [1]
    assert [r.entry_va for r in ranking.entry_points(nodes, ["B", "0x3"]).collect()] == [2, 3]


def test_cliques_and_costs(spark, calls):
    strings = spark.createDataFrame([(v, " Shared ") for v in range(30)] + [(100, "one"), (1, "")], "entry_va long, value string")
    e = graph.mixed_edges(calls, strings)
    got = {(r.a, r.b): r.kinds for r in e.collect()}
    assert got[(1, 2)] == ["call", "string"] and (5, 5) not in got
    assert sum("string" in k for k in got.values()) == 190
    costs = dict(rows(e.where("a = 1").select("b", graph.edge_cost(F.col("kinds")).alias("c")), "b", "c"))
    assert costs[2] == 0.4
    assert spark.range(1).select(graph.edge_cost(F.array(F.lit("odd"))).alias("c")).first().c == 1.0


def test_distances(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 2.5), (3, 4, 0.1)], "a long, b long, cost double")
    start = spark.createDataFrame([(1,)], "entry_va long")
    got = {r.node: r.dist for r in graph.distances(e, start, 2.1).collect()}
    assert got == pytest.approx({1: 0, 2: 1, 3: 2, 4: 2.1})
    assert set(got) >= {r.node for r in graph.distances(e, start, 1.0).collect()}


def test_paths(spark, calls):
    start = spark.createDataFrame([(1,)], "entry_va long")
    got = rows(graph.simple_paths(calls, start, 10).select("start", F.array_join(F.transform("path", lambda x: x.cast("string")), "").alias("p"), "leaf"), "p", "leaf")
    assert got == {("124", "cycle_cut"), ("134", "cycle_cut")}
    got = rows(graph.simple_paths(calls, start, 1).select(F.array_join(F.transform("path", lambda x: x.cast("string")), "").alias("p"), "leaf"), "p", "leaf")
    assert got == {("12", "max_depth"), ("13", "max_depth")}
    first = graph.simple_paths(calls, start, 10, max_paths=1).collect()
    assert [list(r.path) for r in first] == [[1, 2, 4]]
    dag = spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "entry_va long, callee_va long")
    assert dict(rows(graph.longest_depth(dag), "entry_va", "depth")) == {1: 2, 2: 1, 3: 0}


def test_long_chains_and_cycles(spark):
    """Depth and distance go on beyond any fixed number of rounds; what reaches a cycle has no longest path."""
    chain = [(i, i + 1) for i in range(66)]
    loop = [(100, 101), (101, 100), (102, 100), (102, 103), (104, 104), (104, 103)]
    calls = spark.createDataFrame(chain + loop, "entry_va long, callee_va long")
    assert dict(rows(graph.longest_depth(calls), "entry_va", "depth")) == {**{i: 66 - i for i in range(67)}, 100: None, 101: None, 102: None, 103: 0, 104: 1}
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in chain], "a long, b long, cost double")
    got = {r.node: r.dist for r in graph.distances(edges, spark.createDataFrame([(0,)], "entry_va long"), 100.0).collect()}
    assert got == {i: float(i) for i in range(67)}
    with pytest.raises(ValueError, match="negative"):
        graph.distances(edges.withColumn("cost", -edges["cost"]), spark.createDataFrame([(0,)], "entry_va long"), 1.0)


def test_paths(spark):
    paths = spark.createDataFrame([(1, [1, 2, 3], [1, 1], 2, 0), (1, [1, 4, 5], [2, 1], 2, 3), (1, [1, 6], [3], 1, 9), (7, [7, 8], [1], 1, 0)], "start long, path array<long>, key array<int>, depth int, strength int")
    best = {r.start: list(r.path) for r in graph.deepest_path(paths, ["start"]).collect()}
    assert best == {1: [1, 4, 5], 7: [7, 8]}
    allowed = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 6)], "start long, entry_va long")
    assert sorted(list(r.path) for r in graph.paths_within(paths, allowed).collect()) == [[1, 2, 3], [1, 6], [7, 8]]
    edges = spark.createDataFrame([(1, 1, 2, ["net"], ["a", " "]), (1, 2, 3, ["file"], ["b", "c"]), (1, 3, 4, ["x"], ["d"])], "p int, position int, strength int, signals array<string>, guards array<string>")
    [r] = graph.path_conditions(edges, ["p"], most=3).collect()
    assert (r.strength, r.signals, r.guards) == (5, ["file", "net"], ["a", "b", "c"])
    sizes = spark.createDataFrame([(0, 2), (13, 3), (30, 4), (60, 5)], "n int, want int").select("want", graph.generations(F.col("n"), F.lit(0), F.lit(0), F.lit(0), F.lit(0)).alias("got"))
    assert all(r.want == r.got for r in sizes.collect())


def test_statistics_stay_within_a_binary(spark):
    tools = spark.createDataFrame([(1, "ida")], "id long, name string")
    views = spark.createDataFrame([(10, 1, 1), (20, 2, 1), (30, 3, 2)], "id long, binary_id long, tool_id long")
    of = lambda ids: spark.createDataFrame([(i,) for i in ids], "view_id long")
    got = {r.binary_id: tuple(r)[1:5] for r in status.binary_statistics(views, tools, of([10, 20, 20]), of([10, 20, 20, 20]), of([10, 20])).collect()}
    assert got == {1: (10, 1, 1, 1), 2: (20, 2, 3, 1), 3: (None, 0, None, None)}


def test_reports_of_no_functions(spark):
    from tessera.schema import TABLES

    none = lambda t: spark.createDataFrame([], TABLES[t])
    rows_ = status.analysed_functions(none("functions"), none("analysis_status"), none("binary_views"), none("tools"))
    [r] = status.report_counts(rows_).collect()
    assert (r.total, r.analyzed, r.analyzed_pct) == (0, 0, None)
    assert status.renamed_functions(rows_).collect() == [] and status.report_lines(rows_).collect() == []


def test_small_functions(spark):
    row = spark.createDataFrame([("int[4] or char or  long ", "/a/b/sample_ida/", {"api_key": "x", "name": "y", "Token": None})], "t string, f string, m map<string,string>")
    [r] = row.select(T.type_variants(F.col("t")).alias("t"), status.logical_name(F.col("f")).alias("f"), T.redacted(F.col("m")).alias("m")).collect()
    assert (sorted(r.t), r.f, r.m) == (["char", "int *", "int[4]", "long"], "sample", {"api_key": "***", "name": "y", "Token": None})
    lines = spark.createDataFrame([(1, 1, "00401000  push ebp"), (1, 2, "; note"), (1, 3, "0x401001 ret")], "entry_va long, line_no int, line string")
    assert rows(status.listing_addresses(lines), "line_no", "ea") == {(1, 0x401000), (3, 0x401001)}
    one = status.parameters_digest(spark.createDataFrame([(1, "x"), (1, "x"), (2, "x")], "b int, a string"), ["b", "a"]).collect()
    assert one[0].signature == one[1].signature != one[2].signature


def test_budget(spark):
    c = spark.createDataFrame([(0x1000, 0x1100), (0x1100, 0x1200)], "entry_va long, callee_va long")
    got = rows(graph.budget_neighbourhood(c, spark.createDataFrame([(0x1000,)], "entry_va long"), 3), "node", "hop")
    assert got == {(0x1000, 0), (0x1100, 1), (0x1200, 2)}


def test_ancestors(spark, calls):
    names = spark.createDataFrame([(v, [f"node_{v}"]) for v in range(1, 6)], "entry_va long, names array<string>")
    got = rows(graph.ancestor_roots(calls, spark.createDataFrame([(4,), (9,)], "entry_va long"), names), "anchor", "root", "mode")
    assert (4, 2, "ancestor") in got and (9, 9, "anchor") in got


def test_guards(spark):
    body = "if (a == b)\n{\n  x = 1;\n  while (n)\n  f();\n}"
    lines = annotate.numbered_lines(spark.createDataFrame([(1, body)], "entry_va long, body string"))
    c = spark.createDataFrame([(1, 2, 5)], "caller_va long, callee_va long, call_line int")
    assert [(r.guard_line, r.guard) for r in graph.guards(lines, c).orderBy(F.desc("guard_line")).collect()] == [(4, "while (n)"), (1, "if (a == b)")]
    sites = graph.call_sites(spark.createDataFrame([(1, body)], "entry_va long, body string"), spark.createDataFrame([(1, 2, "f")], "caller_va long, callee_va long, callee_name string"))
    assert [r.call_line for r in sites.collect()] == [4]
    s = graph.edge_strength(sites, graph.guards(lines, c)).first()
    assert (s.sites, s.guard_count, s.strength) == (1, 2, 2)


def test_agreement(spark):
    df = spark.createDataFrame([("v1 = f(\"x\");", "v1 = f(\"x\");", "a", "A"), ("", "", None, "b"), ("f()", "g()", "a", "b")], "x string, y string, p string, q string")
    got = [r.agreement_score for r in reconcile.agreement(df, "x", "y", "p", "q").collect()]
    assert got[0] == 1.0 and got[1] == 0.95 and got[2] == pytest.approx(0.3 * 0.5 + 0.2 + 0.15, abs=1e-4)


def test_evidence_gate(spark):
    base = dict(summary_signature="", semantic_summary="", structured_analysis="", confidence_score=80, api=["recv"], relation=[], graph=[], existing=[], status="ok", choice="new", old_score=0.2, new_score=0.9, weak_old=False)
    p = [dict(base, name="decrypt_license_blob", string=["auth", "failed"], symbols=["x"]), dict(base, name="parse_auth_packet", string=["auth", "failed"], symbols=["parse_auth_packet"])]
    df = spark.createDataFrame(p, "name string, summary_signature string, semantic_summary string, structured_analysis string, confidence_score int, api array<string>, string array<string>, relation array<string>, graph array<string>, existing array<string>, symbols array<string>, status string, choice string, old_score double, new_score double, weak_old boolean")
    got = {r.name: r for r in reconcile.choose(reconcile.evidence(df)).collect()}
    assert got["decrypt_license_blob"].selected == "old" and got["decrypt_license_blob"].reasons == ["static_evidence_gate_failed"]
    assert got["parse_auth_packet"].selected == "new" and "auth" in got["parse_auth_packet"].overlaps["string"]


def test_relation_alone_stays_under_the_gate(spark):
    df = spark.createDataFrame([("license_reader", "", "", "", 0, [], [], ["license"], [], [], [])], "name string, summary_signature string, semantic_summary string, structured_analysis string, confidence_score int, api array<string>, string array<string>, relation array<string>, graph array<string>, existing array<string>, symbols array<string>")
    assert reconcile.evidence(df).first().evidence_score == 0.2


def test_board(spark):
    e = spark.createDataFrame(
        [(1, "tag", "a", 50, "gen2", "t", 1), (1, "tag", "b", 10, "gen1", "t", 2), (1, "tag", "c", 1, "manual", "t", 3), (1, "tag", "d", 99, "gen1", "t", 4), (1, "tag", "  ", 99, "manual", "t", 5), (2, "note", "x", 5, "odd", "t", 6)],
        "entry_va long, kind string, value string, confidence int, source string, ts string, seq long").withColumn("generation", F.lit(1)).withColumn("goal_index", F.lit(1))
    w = reconcile.board_winners(e)
    assert rows(w, "entry_va", "value") == {(1, "c"), (2, "x")}
    assert rows(reconcile.board_conflicts(e), "seq", "winner") == {(2, "b"), (3, "c"), (4, "c")}
    assert [r.value for r in reconcile.board_search(w, "C").collect()] == ["c"]
    ctx = reconcile.board_context(w, spark.createDataFrame([(1, 2)], "entry_va long, neighbour_va long")).where("entry_va = 1").first()
    assert [x.split(": ")[1] for x in ctx.lines] == ["c", "x"]


def test_write_back(spark):
    df = spark.createDataFrame([(1, 10, "new", 90), (2, None, "new", 90), (3, 11, "old", 90), (4, 12, "new", 10), (5, 13, "new", 90)], "entry_va long, function_id long, selected string, confidence_score int")
    got = dict(rows(reconcile.write_back(df, 60, 1), "entry_va", "reason"))
    assert got == {1: None, 2: "no_function", 3: "not_selected", 4: "low_confidence", 5: "over_limit"}


def test_states(spark):
    st = spark.createDataFrame([(1, "PENDING", 0, None, "old"), (2, "PENDING", 0, None, None)], "function_id long, analysis_state string, confidence_score int, summary_signature string, semantic_summary string")
    r = spark.createDataFrame([(1, "n", "int n()", "does", 0.579, False)], "function_id long, name string, signature string, summary string, confidence double, is_library boolean")
    out = reconcile.applied(st, r)
    assert rows(out, "function_id", "analysis_state", "confidence_score") == {(1, "ANALYZED", 57), (2, "PENDING", 0)}
    v = spark.createDataFrame([(1, "rename", "checked")], "function_id long, action string, note string")
    once = reconcile.validated(out, v)
    assert rows(reconcile.validated(once, v), "function_id", "analysis_state", "semantic_summary") == {(1, "LOCKED", "does\nchecked"), (2, "PENDING", None)}
    names = reconcile.sequence_names(spark.createDataFrame([(1, "f"), (2, "f"), (3, "g")], "id long, name string"), spark.createDataFrame([("f",), ("f_2",)], "name string"))
    assert rows(names, "id", "name") == {(1, "f_3"), (2, "f_4"), (3, "g")}


def test_recovery(spark):
    r = spark.createDataFrame([("g", 1, 1, "bad", 100), ("g", 2, 2, "ok", 200), ("g", 3, 1, "ok", 100), ("g", 4, 1, "bad", 100), ("g", 5, 2, "bad", 100)], "k string, seq int, attempt int, status string, budget int")
    x = metrics.recovery(r, ["k"], ["seq"]).first()
    assert (x.attempts, x.interactions, x.retried, x.recovered, x.failed, x.expansions) == (5, 3, 2, 1, 1, 1)


def test_summary(spark):
    r = spark.createDataFrame([("s", "v", "ok", "ok", 1.0), ("s", "v", "ok", "ok", 3.0), ("s", "v", "timeout", None, 9.0), ("s", "w", "ok", "ok", float("nan"))], "sample string, variant string, status string, report_status string, m double")
    got = {x.variant: x for x in metrics.summarise(r, ["m"], ["m"]).collect()}
    assert (got["v"].m_mean, got["v"].m_p95, got["v"].m_cv, got["v"].timeouts, got["v"].success_rate) == (2.0, 2.9, 0.5, 1, pytest.approx(2 / 3))
    assert got["w"].m_mean is None and got["w"].m_cv is None
    assert rows(metrics.acceptance(metrics.summarise(r, ["m"], [])), "variant", "passed") == {("v", False), ("w", True)}


def test_digests(spark):
    a = spark.range(1000).select("id", (F.col("id") % 97).cast("string").alias("v"))
    x, y = metrics.chunked_digest(a, ["id", "v"]).first(), metrics.chunked_digest(a.orderBy(F.desc("id")), ["id", "v"]).first()
    assert x == y and x["rows"] == 1000
    assert metrics.chunked_digest(a.where("id != 5"), ["id", "v"]).first().digest != x.digest
    d = metrics.diff(metrics.profile({"t": (a, ["id"]), "u": (a, ["v"])}), metrics.profile({"t": (a, ["id"])}))
    assert [(r.metric, r.rows_rebuilt) for r in d.collect()] == [("u", -1)]


def test_rules_reach_a_fixed_point(spark):
    edges = spark.createDataFrame([("a", "b", "CALLS"), ("b", "c", "CALLS"), ("c", "a", "CALLS"), ("b", "api:x", "USES_API")], "source_id string, target_id string, edge_type string")
    facts = spark.createDataFrame([("a", "v1", "int", "given", 0.99), ("c", "return", "bool", "given", 0.9), ("c", "name", "parse", "given", 0.8)], "node_id string, variable string, value string, source string, confidence double")
    api = spark.createDataFrame([("api:x", "p", "HANDLE")], "api_id string, variable string, value string")
    out = rules.run(facts, edges, [(1, rules.type_propagation()), (2, rules.return_propagation()), (3, rules.api_injection(api)), (1, rules.naming_hints())])
    got = rows(out, "node_id", "variable", "value")
    assert {("b", "v1", "int"), ("c", "v1", "int"), ("b", "called_return", "bool"), ("b", "p", "HANDLE"), ("b", "hint", "calls_parse")} <= got
    assert len(got) == out.count()


def test_batches_and_analyst(spark):
    items = spark.createDataFrame([("g", i, t) for i, t in enumerate([5, 5, 5, 20, 1, 1])], "g string, i int, tokens int")
    got = [(r.i, r.batch) for r in annotate.batches(items, "tokens", 12, 3, "g", ["i"]).orderBy("i").collect()]
    assert got == [(0, 0), (1, 0), (2, 1), (3, 2), (4, 3), (5, 3)]
    tries = []

    def analyst(batch):
        tries.append(1)
        return [{"i": r["i"], "out": r["i"] * 2} for r in batch]

    assert rows(annotate.analysed(items, analyst, "i int, out int"), "i", "out") == {(i, 2 * i) for i in range(6)}


def test_comments(spark):
    code = spark.createDataFrame([(1, "a = 1;\n}\nb;")], "entry_va long, body string")
    c = spark.createDataFrame([(1, 1, "one"), (1, 2, "brace"), (1, 3, "x"), (1, 3, "y")], "entry_va long, line_no int, comment string")
    assert annotate.annotate(code, c).first().body == "a = 1;  // one\n}\nb;  // x | y"
    assert annotate.pruned_comments(c, max_total=2).count() == 2
    ea = spark.createDataFrame([(1, 1, 100), (1, 3, 100)], "entry_va long, line_no int, ea long")
    by = annotate.comments_by_address(c, ea)
    assert by.first().comment == "one | x | y"
    assert annotate.comments_by_line(by, ea).first().line_no == 1


def test_offset_and_globals(spark):
    a = spark.createDataFrame([("f", 110), ("g", 210), ("h", 311)], "name string, address_va long")
    b = spark.createDataFrame([("f", 10), ("g", 110), ("h", 210)], "name string, address_va long")
    assert tuple(unify.address_offset(a, b, 2).first()) == (100, 2)
    assert unify.address_offset(a, b, 3).first().offset is None
    uses = spark.createDataFrame([(7, 1, True), (7, 2, False), (8, 3, False)], "global_va long, entry_va long, writes boolean")
    conf = spark.createDataFrame([(1, 0.5), (2, 0.9)], "entry_va long, confidence double")
    assert rows(unify.global_scores(uses, conf), "global_va", "score") == {(7, 210), (8, 10)}
