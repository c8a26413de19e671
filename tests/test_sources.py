"""Readers of tool exports and the versioned store, on files written here."""

from tessera.operators import unify
from tessera.schema import conform, missing_tables
from tessera.sources import exports, store


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_view(spark, tmp_path):
    write(tmp_path / "p_segments.csv", 'Name,Start Address,End Address,Length,Read,Write,Execute\nHeaders,0x400000,0x400fff,4096,True,False,False\n.text,0x401000,0x401fff,4096,True,False,True\nbad,EXT:1,0x1,1,True,True,True\n')
    write(tmp_path / "p_sections.csv", "Name,Start Address,End Address,Length\n.text,401000,401fff,4096\n")
    write(tmp_path / "p_symbols.csv", 'Name,Address,Type,Source,Is Global,Is Primary,Is External,Namespace\n"main, really",0x401000,Function,USER,True,True,False,g\nputs,0xEXTERNAL:00000001,Function,IMPORT,True,True,True,g\n')
    write(tmp_path / "p_strings.csv", "String,Address,Length\nhello,0x402000,5\nlost,EXTERNAL:2,4\n")
    write(tmp_path / "xrefs/p_402000_hello_refs.csv", "Reference From Address,Reference Type,Containing Function\n0x401001,READ,main\n")
    write(tmp_path / "xrefs/p_401100_do_it_refs.csv", "Reference From Address,Reference Type,Containing Function\n0x401002,17,main\n")
    write(tmp_path / "disassembly/0x401000_main.asm", "; Function: main\n; Start EA: 0x401000\n\n00401000  push  rbp ; 55\n0x401001  mov   rax, [x] ; 48 8B 05\nnot an instruction\n00401002  call do_it ; E8\n")
    write(tmp_path / "disassembly/00401100_do_it.asm", "00401100  ret ; C3\n")
    write(tmp_path / "pseudocode/0x401000_main.c", "// Function: main\n// Start EA: 0x401000\n\nint main(void)\n{\n  do_it();\n}\n")
    v = exports.load_view(spark, str(tmp_path), "p", 1)
    assert [r.name for r in v["segments"].orderBy("start_va").collect()] == ["Headers", ".text"]
    assert exports.image_base(v["segments"]).first()["image_base"] == 0x400000
    assert {(r.name, r.kind, r.address_va) for r in v["symbols"].collect()} == {("main, really", "function", 0x401000), ("puts", "import", None)}
    assert [r.value for r in v["strings"].collect()] == ["hello"]
    fs = {r.entry_va: r for r in v["functions"].collect()}
    assert {k: r.name for k, r in fs.items()} == {0x401000: "main", 0x401100: "do_it"}
    rows = v["instructions"].where(f"function_id = {fs[0x401000].id}").orderBy("index_in_function").collect()
    assert [(r.index_in_function, r.mnemonic, r.op_str, r.bytes) for r in rows] == [(0, "push", "rbp", "55"), (1, "mov", "rax, [x]", "48 8B 05"), (2, "call", "do_it", "E8")]
    code = v["pseudo_functions"].first()
    assert (code.prototype, code.body) == ("int main(void)", "{\n  do_it();\n}")
    # by its own convention the name with an underscore shifts the target
    assert {(r.dst_va, r.dst_name) for r in v["xrefs"].collect()} == {(0x402000, "hello"), (None, "it")} or {(r.dst_va, r.dst_name) for r in v["xrefs"].collect()} == {(0x402000, "hello"), (0xD0, "it")}
    whole = exports.read_xrefs(spark, str(tmp_path / "xrefs"), 1, strict=True)
    assert {(r.dst_va, r.dst_name) for r in whole.collect()} == {(0x402000, "hello"), (0x401100, "do_it")}
    refs = unify.string_refs(v["xrefs"], v["instructions"], v["functions"], v["strings"])
    assert [(r.entry_va, r.value) for r in refs.collect()] == [(0x401000, "hello")]
    calls = unify.resolve_calls(whole, v["instructions"], v["functions"])
    assert [(r.entry_va, r.callee_va) for r in calls.collect()] == [(0x401000, 0x401100)]
    assert exports.read_segments(spark, str(tmp_path / "p_segments.csv"), 2, offset=0x1000).orderBy("start_va").first().start_va == 0x3FF000


def test_masked_permissions(spark, tmp_path):
    write(tmp_path / "s.csv", "Name,Start Address,End Address,Length,Perm\n.text,1000,2000,0x1000,5\n")
    r = exports.read_segments(spark, str(tmp_path / "s.csv"), 1).first()
    assert (r.perm_r, r.perm_w, r.perm_x, r.length) == (1, 0, 1, 4096)


def test_manifest(spark, tmp_path):
    write(tmp_path / "m.json", '{"defaults": {"timeout_seconds": 5},\n "samples": [{"name": "a", "input": "x", "expectations": {"goal_vas": ["0x1"]}}]}')
    r = exports.read_manifest(spark, str(tmp_path / "m.json")).first()
    assert (r["name"], r.timeout_seconds, r.expectations.goal_vas, r.engines) == ("a", 5, ["0x1"], ["practical"])


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "db"))
    assert s.read("functions").count() == 0 and s.counts()["functions"] == -1
    f = conform(spark.createDataFrame([(1, 1, 16, "a"), (2, 1, 32, "b")], "id long, view_id long, entry_va long, name string"), "functions")
    s.replace("functions", f)
    s.replace("functions", store.upsert(s.read("functions"), conform(spark.createDataFrame([(2, "c")], "id long, name string"), "functions"), ["id"]))
    assert {(r.id, r.name) for r in s.read("functions").collect()} == {(1, "a"), (2, "c")}
    assert {r.name for r in s.read("functions", 0).collect()} == {"a", "b"}
    other = store.Store(spark, str(tmp_path / "copy"))
    s.clone(other)
    assert other.read("functions").count() == 2 and "functions" not in missing_tables(other.tables())


def test_keyed_changes(spark):
    t = spark.createDataFrame([(1, "x", 1), (2, None, 2), (None, "n", 3)], "k int, s string, n int")
    up = store.update(t, spark.createDataFrame([(2, "y"), (None, "m")], "k int, s string"), ["k"])
    assert {(r.k, r.s, r.n) for r in up.collect()} == {(1, "x", 1), (2, "y", 2), (None, "m", 3)}
    assert store.delete(t, spark.createDataFrame([(1,)], "k int"), ["k"]).count() == 2
    added = store.insert_missing(t, spark.createDataFrame([(1, "no", 9), (5, "yes", 9), (5, "again", 9)], "k int, s string, n int"), ["k"])
    assert added.count() == 4
    live = spark.createDataFrame([(16, "main"), (48, "new")], "entry_va long, name string")
    f = spark.createDataFrame([(1, 16, "sub_10"), (2, 32, "b")], "id long, entry_va long, name string")
    st = conform(spark.createDataFrame([(1, "LOCKED"), (2, "LOCKED")], "function_id long, analysis_state string"), "analysis_status")
    fs, ss, c = store.sync_names(f, live, st, unlock=True)
    assert {(r.id, r.name) for r in fs.collect()} == {(1, "main"), (2, "b")}
    assert {(r.function_id, r.analysis_state) for r in ss.collect()} == {(1, "ANALYZED"), (2, "LOCKED")}
    assert tuple(c.first()) == (2, 1, 1, 1)
    assert {(r.entry_va, r.verdict) for r in store.compare_names(f, live).collect()} == {(16, "name_differs"), (32, "only_stored"), (48, "only_live")}
