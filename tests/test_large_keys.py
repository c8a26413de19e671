"""Queries over keys as large as a large table has, and exports that stay few files."""

from pyspark.sql import functions as F

from tessera.operators import graph, rules, waves
from tessera.plans import details, queries
from tessera.sources import store

PARTS = "p_partkey long, p_name string, p_brand string, p_type string, p_size int"


def parts(spark, tmp_path, keys):
    rows = [(k, f"name {k}", "Brand#1", "STEEL", k % 3 + 1) for k in keys]
    spark.createDataFrame(rows, PARTS).write.parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


def test_addresses_of_more_than_eight_digits(spark, tmp_path):
    keys = [1, 1048575, 1048576, 7200001]
    where = parts(spark, tmp_path, keys)
    got = {r["name"]: (r["start_va"], r["end_va"]) for r in details.read_segments(spark, where).collect()}
    assert got == {f"seg_{k}": (k * 4096 - 16, k * 4096 + 4079) for k in keys if k % 9}
    rows = details.read_assembly_instructions(spark, where)
    first = rows.where("index_in_function = 0").agg(F.collect_set("address_va").alias("a")).first()["a"]
    assert set(first) == {k * 4096 for k in keys}


def test_identifiers_that_two_views_use(spark, tmp_path):
    where = parts(spark, tmp_path, [3, 6, 1000003])
    lines = [(3, 1), (3, 2), (3, 9), (1000003, 1), (1000003, 9), (1000003, 9), (1000003, 9)]
    spark.createDataFrame(lines, "l_partkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r["entry_va"] // 16: (r["functions"], r["instr_count"], r["primary_function_id"]) for r in queries.unified_nodes(spark, where).collect()}
    # identifier 1000003 is part 1000003 (4 lines) and the second view of part 3 (2 lines): a row for each of both
    assert got == {3: (3, 4, 1000003), 6: (2, 0, 6), 1000003: (2, 4, 1000003)}


def test_types_of_globals_do_not_depend_on_rounding(spark):
    # doubles sum 0.1 and 0.2 to more than 0.3; of equal sums the greater type counts
    uses = [("a", "int", 0.1), ("b", "int", 0.2), ("c", "long", 0.3)]
    facts = spark.createDataFrame([(n, "access_type", t, "given", c) for n, t, c in uses], "node_id string, variable string, value string, source string, confidence double")
    edges = spark.createDataFrame([(n, "g", "ACCESSES") for n, _, _ in uses], "source_id string, target_id string, edge_type string")
    got = rules.run(facts, edges, [(60, rules.global_consistency(0.5))]).where("variable = 'type'").collect()
    assert [(r["value"], r["confidence"]) for r in got] == [("long", 0.5)]


def test_an_order_of_more_than_sixteen_lines(spark, tmp_path):
    lines = [(1, n, n, n) for n in range(1, 19)] + [(2, 1, 1, 1), (2, 2, 2, 2), (2, 3, 3, 3)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = sorted((r["entry_va"], r["depth"]) for r in queries.deepest_path(spark, str(tmp_path)).collect())
    assert got == sorted([(16 + n, 18 - n) for n in range(1, 19)] + [(32 + n, 3 - n) for n in range(1, 4)])


def test_exports_of_many_functions_are_few_files(spark, tmp_path):
    where = parts(spark, tmp_path, range(1, 60))
    spark.createDataFrame([(k, f"s{k}") for k in range(1, 60)], "s_suppkey long, s_name string").write.parquet(str(tmp_path / "supplier.parquet"))
    lines = [(k, 1, k, k, k % 2) for k in range(1, 60)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, x int").write.parquet(str(tmp_path / "lineitem.parquet"))
    for read in (details.read_assembly_functions, details.read_assembly_instructions, details.read_pseudocode, details.read_xrefs, details.file_hashes):
        got = read(spark, where)
        assert len(got.inputFiles()) <= 16 and got.count() >= 59, read.__name__
    assert {r["rows"] for r in details.load_view(spark, where).collect()} == {59, 118}


def counted(spark, rows, schema):
    """A table, and how many of its rows were made so far."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    return spark.createDataFrame(rows, schema).mapInArrow(run, schema), made


def test_rounds_do_not_make_the_calls_again(spark):
    calls, made = counted(spark, [(k, k + 1) for k in range(8)], "entry_va long, callee_va long")
    got = graph.simple_paths(calls, spark.createDataFrame([(0,)], "entry_va long"), 6).collect()
    assert [(r["depth"], r["leaf"]) for r in got] == [(6, "max_depth")] and made.value == 8


def test_waves_do_not_make_the_calls_again(spark, tmp_path):
    calls, made = counted(spark, [(k, k + 1) for k in range(3)], "entry_va long, callee_va long")
    nodes = spark.createDataFrame([(k,) for k in range(4)], "entry_va long")
    analyst = lambda asked: asked.select("entry_va", F.lit("CONFIRM").alias("action"), F.lit("").alias("note"), F.lit(0.9).alias("confidence"))
    met = waves.validate(store.Store(spark, str(tmp_path / "store")), nodes.limit(1), nodes, nodes.limit(0), calls, analyst)
    assert {(r["wave"], r["entry_va"]) for r in met.collect()} == {(k, k) for k in range(4)} and made.value == 3
