"""Registered queries over derived tables, each with its SQL equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import annotate, graph, metrics, ranking, reconcile, rules, typed_graph, unify
from tessera.operators import status as reports
from tessera.plans import derive as D
from tessera.plans import deeper, details  # noqa: F401  register their queries
from tessera.plans.registry import QUERIES, Query, query
from tessera.sources import exports, store


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in QUERIES.items() if sql}


# ---- sources and scalar functions ------------------------------------------------------------


@query(f"""WITH {D.RAW_SYMBOLS} SELECT name, address_va, CASE t WHEN 0 THEN CASE WHEN e THEN 'import' ELSE 'function' END WHEN 1 THEN 'label' WHEN 2 THEN 'data' ELSE 'other' END AS kind,
 CASE WHEN g THEN 1 ELSE 0 END AS is_global, CAST(NULL AS INTEGER) AS is_primary, CASE WHEN e THEN 1 ELSE 0 END AS is_external FROM raw""")
def load_symbols_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.normal_symbols(D.raw_symbols(spark, sf_dir), 1).select("name", "address_va", "kind", "is_global", "is_primary", "is_external")


@query(f"""WITH {D.RAW_SYMBOLS}, v AS (SELECT name, address_va FROM raw WHERE t = 0 AND NOT e AND address_va IS NOT NULL),
 d AS (SELECT a.address_va + 65536 + CASE WHEN a.address_va % 7 = 0 THEN 16 ELSE 0 END - b.address_va AS diff, count(*) AS n FROM v a JOIN v b USING (name) GROUP BY 1)
 SELECT diff AS "offset", n AS matches FROM d ORDER BY n DESC, diff LIMIT 1""")
def address_offset_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.raw_symbols(spark, sf_dir)
    symbols = exports.normal_symbols(rows, 2).withColumn("ord", F.col("address_va"))
    two = unify.function_symbols(symbols)
    one = two.withColumn("address_va", F.col("address_va") + 65536 + F.when(F.col("address_va") % 7 == 0, 16).otherwise(0))
    return unify.address_offset(one, two)


@query("""WITH a AS (SELECT p_partkey AS v, p_name AS n FROM part WHERE p_partkey % 5 <> 0), b AS (SELECT p_partkey AS v, CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE upper(p_name) END AS n FROM part WHERE p_partkey % 7 <> 0),
 m AS (SELECT a.v, lower(a.n) = lower(b.n) AS same FROM a JOIN b USING (v)), low AS (SELECT * FROM m ORDER BY v LIMIT 20)
 SELECT (SELECT count(*) FROM a) AS count1, (SELECT count(*) FROM b) AS count2, (SELECT count(*) FROM m) AS matched, (SELECT count(*) FILTER (same) FROM low) AS names_equal, (SELECT count(*) FROM low) AS names_seen,
 round((SELECT count(*) FROM m) / least((SELECT count(*) FROM a), (SELECT count(*) FROM b)), 6) AS match_rate, (SELECT count(*) FROM m) / least((SELECT count(*) FROM a), (SELECT count(*) FROM b)) < 0.3 AS low_match""")
def cross_view_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.table(spark, sf_dir, "part")
    a = p.where("p_partkey % 5 != 0").select(F.col("p_partkey").alias("entry_va"), F.col("p_name").alias("name"))
    b = p.where("p_partkey % 7 != 0").select(F.col("p_partkey").alias("entry_va"), F.when(F.col("p_partkey") % 3 == 0, "x").otherwise(F.upper("p_name")).alias("name"))
    return unify.cross_validation(a, b)


@query("""WITH a AS (SELECT p_partkey AS id, p_partkey * 16 AS entry_va, p_name AS name FROM part UNION ALL SELECT p_partkey + 1000000, p_partkey * 16, 'v2_' || p_name FROM part WHERE p_partkey % 3 = 0),
 i AS (SELECT l_partkey AS id, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT l_partkey + 1000000, count(*) FROM lineitem WHERE l_linenumber <= 5 GROUP BY 1),
 f AS (SELECT a.*, coalesce(n, 0) AS n FROM a LEFT JOIN i USING (id))
 SELECT entry_va, count(*) AS functions, string_agg(DISTINCT name, '|' ORDER BY name) AS names, max(n) AS instr_count, arg_min(id, (-n, id)) AS primary_function_id FROM f GROUP BY entry_va""")
def unified_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, li = D.table(spark, sf_dir, "part"), D.table(spark, sf_dir, "lineitem")
    one = p.select(F.col("p_partkey").alias("id"), F.lit(1).alias("view_id"), (F.col("p_partkey") * 16).alias("entry_va"), F.col("p_name").alias("name"))
    two = p.where("p_partkey % 3 = 0").select((F.col("p_partkey") + 1000000).alias("id"), F.lit(2).alias("view_id"), (F.col("p_partkey") * 16).alias("entry_va"), F.concat(F.lit("v2_"), "p_name").alias("name"))
    views = spark.createDataFrame([(1, 1), (2, 2)], "id int, tool_id int")
    tools = spark.createDataFrame([(1, "one"), (2, "two")], "id int, name string")
    # keys over a million are identifiers of both views, whose listings are counted apart
    instructions = li.select(F.col("l_partkey").alias("function_id"), F.lit(1).alias("listing")).unionByName(li.where("l_linenumber <= 5").select((F.col("l_partkey") + 1000000).alias("function_id"), F.lit(2).alias("listing")))
    nodes = unify.unified_nodes(one.unionByName(two), views, tools, instructions)
    return nodes.select("entry_va", "functions", F.array_join("names", "|").alias("names"), "instr_count", "primary_function_id")


def _names_sql(column: str) -> str:
    return f"list_distinct(regexp_extract_all({column}, '\\b(?:a\\d+|arg\\d+|arg_\\d+|v\\d+|var_[0-9A-Fa-f]+)\\b'))"


@query("""SELECT doc_id, CAST(len(list_filter(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: trim(x) NOT IN ('', '{', '}'))) AS INTEGER) AS effective FROM documents""")
def effective_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "documents").select("doc_id", T.effective_lines(F.col("text")).alias("effective"))


@query(f"""WITH c AS (SELECT p_partkey, 'a' || p_size || ' = v' || (p_size % 7) || ' + var_' || (p_partkey % 16) || '(arg_1, ' || p_name || ')' AS code FROM part)
 SELECT p_partkey, CAST(len({_names_sql('code')}) AS INTEGER) AS n, array_to_string(list_sort({_names_sql('code')}), ',') AS names FROM c""")
def generic_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.table(spark, sf_dir, "part")
    s = lambda c: F.col(c).cast("string")
    code = F.concat(F.lit("a"), s("p_size"), F.lit(" = v"), (F.col("p_size") % 7).cast("string"), F.lit(" + var_"), (F.col("p_partkey") % 16).cast("string"), F.lit("(arg_1, "), "p_name", F.lit(")"))
    names = T.generic_names(code)
    return p.select("p_partkey", F.size(names).alias("n"), F.array_join(names, ",").alias("names"))


def _signals_sql() -> str:
    cases = [f"CASE WHEN {' OR '.join(f"contains(t, '{k}')" for k in ks)} THEN '{c}' END" for c, ks in T.ENVIRONMENT.items()]
    return f"SELECT p_partkey, concat_ws(',', {', '.join(cases)}) AS signals FROM (SELECT p_partkey, lower('If (' || CASE p_partkey % 4 WHEN 0 THEN 'argv' WHEN 1 THEN 'GetTickCount() > Sleep(' WHEN 2 THEN 'VMware' ELSE p_name END || ') ' || CASE WHEN p_size % 2 = 0 THEN 'CreateFile' ELSE 'recv(' END) AS t FROM part)"


@query(_signals_sql())
def env_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 4
    text = F.concat(F.lit("If ("), F.when(k == 0, "argv").when(k == 1, "GetTickCount() > Sleep(").when(k == 2, "VMware").otherwise(F.col("p_name")), F.lit(") "), F.when(F.col("p_size") % 2 == 0, "CreateFile").otherwise("recv("))
    return p.select("p_partkey", F.array_join(T.environment_signals(text), ",").alias("signals"))


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9_]+') AS ws FROM documents)
 SELECT doc_id, CAST(len(t) AS INTEGER) AS n, array_to_string(t, ',') AS tokens FROM (SELECT doc_id, list_sort(list_filter(list_distinct(list_transform(ws, lambda x: lower(x))), lambda x: length(x) >= 3)) AS t FROM w)""")
def token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.plain_tokens(F.col("text"))
    return D.table(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n"), F.array_join(t, ",").alias("tokens"))


@query("""WITH x AS (SELECT conv_id, turn, [turn, turn + 1] AS expected FROM conversations), a AS (SELECT conv_id, list(turn ORDER BY turn) AS actual, max(turn) AS last FROM conversations GROUP BY 1)
 SELECT conv_id, turn, turn + 1 <= last AS found FROM x JOIN a USING (conv_id)""")
def subsequence_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = D.table(spark, sf_dir, "conversations")
    actual = c.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("actual"))
    return c.join(actual, "conv_id").select("conv_id", "turn", T.is_subsequence(F.array("turn", F.col("turn") + 1), F.col("actual")).alias("found"))


@query("""SELECT p_partkey, regexp_replace(regexp_replace('v1 = ' || p_name || ' + v12; v1++; v2 = v1', '\\bv12\\b', 'twelve', 'g'), '\\bv1\\b', 'first', 'g') AS code FROM part""")
def rename_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entry_va"), F.concat(F.lit("v1 = "), "p_name", F.lit(" + v12; v1++; v2 = v1")).alias("body"))
    names = p.select("entry_va", F.create_map(F.lit("v1"), F.lit("first"), F.lit("v12"), F.lit("twelve"), F.lit("v2"), F.lit("not a name")).alias("renames"))
    return annotate.renamed(p, names).select(F.col("entry_va").alias("p_partkey"), F.col("body").alias("code"))


_LINES = "string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))"


@query(f"""WITH l AS (SELECT doc_id, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) AS n FROM documents),
 m AS (SELECT doc_id, n, CASE WHEN n % 3 = 1 AND trim(line) NOT IN ('', '{{', '}}') THEN rtrim(line) || CASE WHEN contains(line, '//') THEN ' | line ' ELSE '  // line ' END || n ELSE line END AS line FROM l)
 SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS body FROM m GROUP BY doc_id""")
def annotate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    lines = annotate.numbered_lines(d, "doc_id")
    comments = lines.where("line_no % 3 = 1").select("doc_id", "line_no", F.concat(F.lit("line "), F.col("line_no").cast("string")).alias("comment"))
    return annotate.annotate(d, comments, "doc_id")


# ---- ranking ---------------------------------------------------------------------------------


@query(f"""WITH {D.PART_NODES}, done AS (SELECT p_partkey AS v FROM part WHERE p_size <= 10),
 an AS (SELECT c.entry_va, count(*) AS k FROM calls c JOIN done ON c.callee_va = v GROUP BY 1)
 SELECT n.entry_va, {D.score_sql('coalesce(k, 0)')} AS score FROM nodes n LEFT JOIN an USING (entry_va) ORDER BY score DESC, n.entry_va LIMIT 100""")
def priority_score_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = D.table(spark, sf_dir, "part").where("p_size <= 10").select(F.col("p_partkey").alias("entry_va"))
    return ranking.top(ranking.scores(D.part_nodes(spark, sf_dir), D.part_calls(spark, sf_dir), done), 100, F.desc("score"))


@query(f"""WITH {D.PART_NODES}, ch AS (SELECT p_partkey AS v FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 5), td AS (SELECT v FROM ch UNION SELECT entry_va FROM calls JOIN ch ON callee_va = v),
 k1 AS (SELECT c.entry_va, count(*) AS k FROM calls c JOIN part ON c.callee_va = p_partkey WHERE p_size <= 10 GROUP BY 1), k2 AS (SELECT c.entry_va, count(*) AS k FROM calls c JOIN part ON c.callee_va = p_partkey WHERE p_size <= 20 GROUP BY 1)
 SELECT n.entry_va, {D.score_sql('CASE WHEN td.v IS NULL THEN coalesce(k1.k, 0) ELSE coalesce(k2.k, 0) END')} AS score FROM nodes n LEFT JOIN td ON td.v = n.entry_va LEFT JOIN k1 USING (entry_va) LEFT JOIN k2 USING (entry_va)""")
def incremental_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.table(spark, sf_dir, "part")
    done = lambda n: p.where(F.col("p_size") <= n).select(F.col("p_partkey").alias("entry_va"))
    calls, changed = D.part_calls(spark, sf_dir), p.orderBy(F.desc("p_retailprice"), "p_partkey").limit(5).select(F.col("p_partkey").alias("entry_va"))
    kept = deeper.new_store(spark, "scores")
    old = ranking.stored_scores(kept, "10", lambda: ranking.scores(D.part_nodes(spark, sf_dir), calls, done(10)))
    todo = graph.kept(ranking.to_rescore(calls, changed), "todo")
    return ranking.rescored(D.part_nodes(spark, sf_dir, todo), calls, done(20), old, todo)


def _richness_sql() -> str:
    found = " + ".join(f"CASE WHEN contains(low, '{k}') THEN {w} ELSE 0 END" for k, w in ranking.SIGNALS.items())
    return f"""WITH {D.PART_NODES}, x AS (SELECT n.*, lower(p_brand || chr(10) || p_type || chr(10) || p_name) AS low FROM nodes n JOIN part ON entry_va = p_partkey)
 SELECT entry_va, CAST(4 * least(apis, 15) + 3 * 2 + 2 * least(internal, 20) + 2 * least(callers, 20) + CASE WHEN instr >= 120 THEN 2 WHEN instr >= 30 THEN 1 ELSE 0 END + least({found}, 80) AS INTEGER) AS richness FROM x"""


@query(_richness_sql())
def semantic_richness(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = D.part_nodes(spark, sf_dir)
    return n.select("entry_va", ranking.richness(F.lit(""), F.col("names"), F.col("string_refs"), F.col("external_callees"), ranking.count_of(n, "callees"), ranking.count_of(n, "callers"), F.col("instr_count")).alias("richness"))


@query(f"""WITH {D.PART_NODES} SELECT entry_va FROM nodes WHERE internal > 0 AND callers = 0 ORDER BY internal DESC, entry_va LIMIT 5""")
def entry_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.entry_points(D.part_nodes(spark, sf_dir), [], 5)


@query("""SELECT lower(p_name) AS name, min(p_partkey) AS first_va, count(*) AS entries FROM part GROUP BY 1""")
def name_index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unify.name_index(D.part_nodes(spark, sf_dir)).groupBy("name").agg(F.min("entry_va").alias("first_va"), F.count(F.lit(1)).alias("entries"))


@query("""SELECT CASE WHEN p_size < 5 THEN 'too_small' WHEN p_brand LIKE '%1' THEN 'brand' WHEN p_retailprice > 1000 THEN 'price' ELSE 'candidate' END AS reason, count(*) AS n FROM part GROUP BY 1""")
def exclusion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = [("too_small", F.col("p_size") >= 5), ("brand", ~F.col("p_brand").endswith("1")), ("price", F.col("p_retailprice") <= 1000)]
    return ranking.candidates(D.table(spark, sf_dir, "part"), checks).groupBy(F.coalesce("reason", F.lit("candidate")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# ---- joins on references ---------------------------------------------------------------------


@query("""WITH t AS (SELECT l_partkey * 16 AS entry_va, CASE WHEN l_linenumber = 7 THEN l_suppkey * 16 ELSE l_suppkey + 100000000 END AS dst, l_suppkey FROM lineitem),
 g AS (SELECT entry_va, dst AS global_va, count(*) AS refs FROM t WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey * 16 = dst) AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey + 100000000 = dst) GROUP BY 1, 2)
 SELECT entry_va, global_va, refs FROM (SELECT *, row_number() OVER (PARTITION BY entry_va ORDER BY refs DESC, global_va) AS r FROM g) WHERE r <= 128""")
def anti_join_globals(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = D.refs(spark, sf_dir)
    return unify.global_refs(r["xrefs"], r["instructions"], r["functions"], r["strings"])


@query("""SELECT l_partkey * 16 AS entry_va, s_name AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linenumber <> 7 AND s_suppkey % 2 = 0 GROUP BY 1, 2""")
def string_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = D.refs(spark, sf_dir)
    return unify.string_refs(r["xrefs"], r["instructions"], r["functions"], r["strings"])


@query("""WITH u AS (SELECT l_suppkey AS global_va, l_partkey AS v, bool_or(l_returnflag = 'R') AS w FROM lineitem GROUP BY 1, 2),
 c AS (SELECT p_partkey AS v, CASE WHEN p_brand LIKE '%1' THEN greatest(p_size / 100.0, 0.9) ELSE p_size / 100.0 END AS conf FROM part),
 s AS (SELECT global_va, CAST(floor((sum(CASE WHEN conf > 0 THEN (CASE WHEN w THEN 2.0 ELSE 1.0 END) * conf ELSE 0 END) + 0.1 * count(*)) * 100 + 1e-9) AS INTEGER) AS score FROM u LEFT JOIN c USING (v) GROUP BY 1)
 SELECT * FROM s WHERE score > 0""")
def global_rw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, li = D.table(spark, sf_dir, "part"), D.table(spark, sf_dir, "lineitem")
    uses = li.select(F.col("l_suppkey").alias("global_va"), F.col("l_partkey").alias("entry_va"), (F.col("l_returnflag") == "R").alias("writes"))
    functions = p.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("entry_va"))
    status = p.select(F.col("p_partkey").alias("function_id"), F.when(F.col("p_brand").endswith("1"), "LOCKED").otherwise("PENDING").alias("analysis_state"), F.col("p_size").alias("confidence_score"))
    return unify.global_scores(uses, unify.best_confidence(status, functions))


# ---- graph -----------------------------------------------------------------------------------


@query(f"WITH {D.MIXED} SELECT a, b, kinds, CAST(cost AS DOUBLE) AS cost FROM mixed")
def mixed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = graph.mixed_edges(D.order_calls(spark, sf_dir), D.brand_strings(spark, sf_dir))
    return e.select("a", "b", F.array_join("kinds", ",").alias("kinds"), graph.edge_cost(F.col("kinds")).alias("cost"))


@query(f"WITH {D.MIXED} SELECT a, b, kinds FROM mixed WHERE contains(kinds, 'call')")
def call_edges_of_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = graph.of_kind(graph.mixed_edges(D.order_calls(spark, sf_dir), D.brand_strings(spark, sf_dir)))
    return e.select("a", "b", F.array_join("kinds", ",").alias("kinds"))


@query(f"""WITH RECURSIVE {D.ORDER_CALLS}, r AS (SELECT v AS s, v, 0 AS hop FROM {D.busiest_sql(3)} UNION SELECT s, callee_va, hop + 1 FROM r JOIN ocalls ON entry_va = v WHERE hop < 4)
 SELECT s AS start, v AS node, min(hop) AS hop FROM r GROUP BY 1, 2""")
def bfs_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = D.order_calls(spark, sf_dir)
    return graph.hops(calls.select(F.col("entry_va").alias("src"), F.col("callee_va").alias("dst")), D.busiest(calls, 3), 4)


@query(f"""WITH RECURSIVE {D.ORDER_CALLS}, st AS {D.busiest_sql(4)}, dn AS (SELECT v AS s, v, 0 AS hop FROM st UNION SELECT s, callee_va, hop + 1 FROM dn JOIN ocalls ON entry_va = v WHERE hop < 5),
 up AS (SELECT v AS s, v, 0 AS hop FROM st UNION SELECT s, entry_va, hop + 1 FROM up JOIN ocalls ON callee_va = v WHERE hop < 5),
 b AS (SELECT s, v, min((hop, side)) AS x FROM (SELECT s, v, hop, 1 AS side FROM dn WHERE hop > 0 UNION ALL SELECT s, v, hop, 0 FROM up WHERE hop > 0) GROUP BY 1, 2),
 k AS (SELECT s, v, x[1] AS hop, x[2] AS side, row_number() OVER (PARTITION BY s, x[2] ORDER BY x[1], v) AS place FROM b),
 o AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY CASE WHEN place > CASE WHEN side = 0 THEN 9 ELSE 10 END THEN 1 ELSE 0 END, hop, side, v) AS n FROM k)
 SELECT s AS start, v AS node, hop, side FROM o WHERE n <= 19 UNION ALL SELECT v, v, 0, -1 FROM st""")
def budget_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = D.kept_order_calls(spark, sf_dir)
    return graph.budget_neighbourhood(calls, D.busiest(calls, 4), 20, 5)


@query(f"""WITH {D.MIXED}, e AS (SELECT a AS x, b AS y, cost FROM mixed UNION ALL SELECT b, a, cost FROM mixed), d0 AS (SELECT v AS s, v, 0.0 AS d FROM {D.busiest_sql(4)}),
 d1 AS (SELECT s, v, min(d) AS d FROM (SELECT * FROM d0 UNION ALL SELECT s, y, d + cost FROM d0 JOIN e ON x = v WHERE d + cost <= 1.4000001) GROUP BY 1, 2),
 d2 AS (SELECT s, v, min(d) AS d FROM (SELECT * FROM d1 UNION ALL SELECT s, y, d + cost FROM d1 JOIN e ON x = v WHERE d + cost <= 1.4000001) GROUP BY 1, 2),
 d3 AS (SELECT s, v, min(d) AS d FROM (SELECT * FROM d2 UNION ALL SELECT s, y, d + cost FROM d2 JOIN e ON x = v WHERE d + cost <= 1.4000001) GROUP BY 1, 2)
 SELECT s AS start, v AS node, round(CAST(d AS DOUBLE), 4) AS dist FROM d3""")
def relaxed_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = D.kept_order_calls(spark, sf_dir)
    e = graph.mixed_edges(calls, D.brand_strings(spark, sf_dir)).select("a", "b", graph.edge_cost(F.col("kinds")).alias("cost"))
    return graph.distances(e, D.busiest(calls, 4), 1.4).select("start", "node", F.round("dist", 4).alias("dist"))


_PATHS_OF_RANKS = f"""st AS {D.busiest_sql(5)},
 r AS (SELECT v AS s, [v] AS path, [] :: BIGINT[] AS key, 0 AS d, CAST(NULL AS VARCHAR) AS leaf FROM st
  UNION ALL SELECT s, CASE WHEN callee_va IS NULL OR list_contains(path, callee_va) THEN path ELSE list_append(path, callee_va) END, CASE WHEN callee_va IS NULL THEN key ELSE list_append(key, rank) END, d + 1, CASE WHEN callee_va IS NULL THEN 'no_callee' WHEN list_contains(path, callee_va) THEN 'cycle_cut' END
  FROM r LEFT JOIN rk ON entry_va = path[-1] WHERE leaf IS NULL AND d < 6),
 p AS (SELECT s, path, key, len(path) - 1 AS depth, coalesce(leaf, 'max_depth') AS leaf FROM r WHERE leaf IS NOT NULL OR d = 6)"""
# all callees of each function, or its first two
_ALL_PATHS = f"""{D.ORDER_CALLS}, rk AS (SELECT *, row_number() OVER (PARTITION BY entry_va ORDER BY callee_va) AS rank FROM ocalls), {_PATHS_OF_RANKS}"""
_PATHS = f"""{D.ORDER_CALLS}, rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry_va ORDER BY callee_va) AS rank FROM ocalls) WHERE rank <= 2), {_PATHS_OF_RANKS}"""


def _paths(spark: SparkSession, sf_dir: str, calls: DataFrame | None = None, max_branch: int | None = None) -> DataFrame:
    """Paths of up to six calls from the five functions that call the most others, along every callee."""
    calls = D.kept_order_calls(spark, sf_dir) if calls is None else calls
    return graph.simple_paths(calls, D.busiest(calls, 5), 6, max_branch=max_branch)


@query(f"WITH RECURSIVE {_ALL_PATHS} SELECT s AS start, array_to_string(path, '>') AS path, CAST(depth AS INTEGER) AS depth, leaf FROM p")
def simple_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("start", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "depth", "leaf")


@query(f"WITH RECURSIVE {_PATHS} SELECT s AS start, array_to_string(path, '>') AS path, CAST(depth AS INTEGER) AS depth FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY depth DESC, len(path) DESC, CAST(list_sum(path) AS BIGINT) % 7 DESC, key) AS n FROM p) WHERE n = 1")
def deepest_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _paths(spark, sf_dir, max_branch=2).withColumn("strength", F.aggregate("path", F.lit(0).cast("bigint"), lambda a, x: a + x) % 7)
    return graph.deepest_path(p, ["start"]).select("start", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "depth")


@query(f"""WITH RECURSIVE {_ALL_PATHS}, ok AS (SELECT *, len(list_filter(path, lambda x: x % 5 = 4)) = 0 AS inside FROM p)
 SELECT s AS start, array_to_string(path, '>') AS path FROM (SELECT *, bool_or(inside) OVER (PARTITION BY s) AS any_inside FROM ok) WHERE inside OR NOT any_inside""")
def paths_within_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = graph.kept(_paths(spark, sf_dir))
    # kept, so its size is known before every node of every path meets it
    allowed = graph.kept(graph.path_nodes(paths).where("entry_va % 5 <> 4"), "allowed")
    return graph.paths_within(paths, allowed).select("start", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query(f"""WITH RECURSIVE {_PATHS}, {D.PART_NODES}, o AS (SELECT s, unnest(path) AS v FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY key) AS n FROM p) WHERE n <= 12),
 t AS (SELECT s, v, 5 AS w FROM o UNION ALL SELECT s, v, CAST(4 * least(apis, 15) + 2 * least(callers, 20) AS INTEGER) FROM (SELECT DISTINCT s, unnest(path) AS v FROM p) x JOIN nodes ON entry_va = v UNION ALL SELECT v, v, 50 FROM st),
 g AS (SELECT s, v, sum(w) AS score FROM t GROUP BY 1, 2)
 SELECT s AS start, v AS entry_va, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY score DESC, v) AS n FROM g) WHERE n <= 6""")
def anchor_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = D.kept_order_calls(spark, sf_dir)
    paths = graph.kept(_paths(spark, sf_dir, calls, max_branch=2))
    nodes = graph.path_nodes(paths)
    n = D.part_nodes(spark, sf_dir, graph.kept(nodes.select("entry_va").distinct(), "nodes"))  # of what lies on paths alone
    of_node = n.select("entry_va", (4 * F.least(ranking.count_of(n, "external_callees"), F.lit(15)) + 2 * F.least(ranking.count_of(n, "callers"), F.lit(20))).alias("richness"))
    return graph.anchors(paths, nodes.join(of_node, "entry_va"), D.busiest(calls, 5))


@query("""WITH e AS (SELECT conv_id, turn, CAST(length(text) % 5 AS INTEGER) AS strength, CASE WHEN role = 'user' THEN ['network', role] ELSE [role] END AS signals, list_filter([CASE WHEN turn % 2 = 0 THEN '  ' ELSE 'a' || turn END, substring(role, 1, 3), 'if ' || turn, '', 'x' || turn], lambda g: trim(g) <> '') AS guards FROM conversations),
 c AS (SELECT *, coalesce(sum(len(guards)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e)
 SELECT conv_id, CAST(sum(strength) AS BIGINT) AS strength, array_to_string(list_sort(list_distinct(flatten(list(signals)))), ',') AS signals, array_to_string(flatten(list(guards ORDER BY turn))[1:12], '|') AS guards FROM c WHERE before < 12 GROUP BY 1""")
def path_condition_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, turn = D.table(spark, sf_dir, "conversations"), F.col("turn").cast("string")
    edges = c.select(
        "conv_id", F.col("turn").alias("position"), (F.length("text") % 5).alias("strength"), F.when(F.col("role") == "user", F.array(F.lit("network"), "role")).otherwise(F.array("role")).alias("signals"),
        F.array(F.when(F.col("turn") % 2 == 0, "  ").otherwise(F.concat(F.lit("a"), turn)), F.substring("role", 1, 3), F.concat(F.lit("if "), turn), F.lit(""), F.concat(F.lit("x"), turn)).alias("guards"))
    return graph.path_conditions(edges, ["conv_id"]).select("conv_id", "strength", F.array_join("signals", ",").alias("signals"), F.array_join("guards", "|").alias("guards"))


@query(f"WITH {D.LINES} SELECT v AS entry_va, CAST(below AS INTEGER) AS depth FROM lines WHERE n > 1")
def deepest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.longest_depth(D.line_calls(spark, sf_dir)).select(D.line_address(F.col("entry_va")).alias("entry_va"), "depth")


_WORDS = "list_filter(list_distinct(list_transform(regexp_extract_all(p_name, '[A-Za-z0-9_]+'), lambda x: lower(x))), lambda x: length(x) >= 3)"


@query(f"""WITH RECURSIVE {D.ORDER_CALLS}, an AS {D.busiest_sql(8, 'callee_va')}, r AS (SELECT v AS s, v, 0 AS hop FROM an UNION SELECT s, entry_va, hop + 1 FROM r JOIN ocalls ON callee_va = v WHERE hop < 2),
 u AS (SELECT s, v, min(hop) AS hop FROM r GROUP BY 1, 2), i AS (SELECT callee_va AS v, count(*) AS k FROM ocalls GROUP BY 1), nm AS (SELECT p_partkey AS v, {_WORDS} AS ws FROM part),
 j AS (SELECT s, u.v, hop, coalesce(k, 0) AS k, CASE WHEN len(a.ws) > 0 AND len(b.ws) > 0 THEN CAST(len(list_intersect(a.ws, b.ws)) AS DOUBLE) / len(list_distinct(list_concat(a.ws, b.ws))) ELSE 0 END AS o FROM u LEFT JOIN i ON i.v = u.v LEFT JOIN nm a ON a.v = u.v LEFT JOIN nm b ON b.v = s WHERE hop > 0),
 w AS (SELECT s, v, round(exp(-0.35 * hop) / (1 + 0.2 * k) * (1 + 0.5 * o), 6) AS w FROM j),
 p AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY w DESC, v) AS place, max(w) OVER (PARTITION BY s) AS best FROM w)
 SELECT s AS anchor, v AS root, CASE WHEN best >= 0.5 THEN 'ancestor' ELSE 'frontier' END AS mode, w AS weight FROM p WHERE (best >= 0.5 AND place = 1) OR (best < 0.5 AND place <= 3)
 UNION ALL SELECT v, v, 'anchor', NULL FROM an WHERE v NOT IN (SELECT s FROM w)""")
def wlca_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entry_va"), F.array("p_name").alias("names"))
    calls = D.order_calls(spark, sf_dir)
    return graph.ancestor_roots(calls, D.busiest(calls, 8, "callee_va"), names, 2, 0.5)


@query(f"""WITH l AS (SELECT doc_id, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) AS n FROM documents),
 c AS (SELECT doc_id, n AS call_line FROM l WHERE starts_with(line, 'The ')), g AS (SELECT doc_id, n, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS guard FROM l WHERE regexp_matches(line, '(?i)\\b(?:if|else\\s+if|switch|case|while|for)\\b') OR regexp_matches(line, '(==|!=|<=|>=|<|>|&&|\\|\\||\\?)')),
 o AS (SELECT c.doc_id, call_line, guard, max(n) AS guard_line FROM c JOIN g ON c.doc_id = g.doc_id AND n < call_line AND n >= call_line - 18 GROUP BY 1, 2, 3),
 p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, call_line ORDER BY guard_line DESC, guard) AS place FROM o)
 SELECT doc_id, call_line, guard_line, guard FROM p WHERE place <= 3""")
def guard_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry_va"), F.col("text").alias("body"))
    lines = annotate.numbered_lines(d)
    calls = lines.where(F.col("line").startswith("The ")).select(F.col("entry_va").alias("caller_va"), F.lit(0).alias("callee_va"), F.col("line_no").alias("call_line"))
    return graph.guards(lines, calls, 18, 3).select(F.col("caller_va").alias("doc_id"), "call_line", "guard_line", "guard")


@query(f"""WITH l AS (SELECT doc_id, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) AS n FROM documents),
 h AS (SELECT doc_id, n FROM (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k FROM l WHERE contains(line, ' the ')) WHERE k <= 3)
 SELECT h.doc_id, h.n AS line_no, string_agg(l.line, chr(10) ORDER BY l.n) AS snippet FROM h JOIN l ON l.doc_id = h.doc_id AND l.n BETWEEN h.n - 1 AND h.n + 1 GROUP BY 1, 2""")
def call_site_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry_va"), F.col("text").alias("body"))
    lines = annotate.numbered_lines(d)
    return reports.snippets(lines, lines.where(F.col("line").contains(" the ")), ["entry_va"]).select(F.col("entry_va").alias("doc_id"), "line_no", "snippet")


# ---- typed graph -----------------------------------------------------------------------------


@query("""SELECT DISTINCT l_partkey * 16 AS entry_va, l_suppkey * 16 AS callee_va FROM lineitem JOIN part ON p_partkey = l_suppkey WHERE l_linenumber = 7 AND l_suppkey <> l_partkey""")
def data_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = D.refs(spark, sf_dir)
    return typed_graph.data_edges(r["xrefs"], r["instructions"], r["functions"])


@query("""SELECT DISTINCT l_partkey * 16 AS entry_va, l_suppkey * 16 AS callee_va FROM lineitem JOIN part ON p_partkey = l_suppkey WHERE l_returnflag IN ('R', 'A') AND l_linenumber % 3 <> 0 AND l_linenumber % 4 <> 0 AND l_suppkey <> l_partkey""")
def indirect_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = D.refs(spark, sf_dir)
    found = typed_graph.indirect_candidates(D.computed_refs(spark, sf_dir), r["instructions"], r["functions"])
    index = D.table(spark, sf_dir, "part").select(F.concat(F.lit("fn_"), F.col("p_partkey").cast("string")).alias("name"), (F.col("p_partkey") * 16).alias("entry_va"))
    return typed_graph.indirect_edges(found, index)


@query("""SELECT count(*) AS candidates, count(*) > 1000 AS degraded, CASE WHEN count(*) > 1000 THEN 50 END AS top FROM lineitem WHERE l_returnflag IN ('R', 'A')""")
def indirect_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_graph.indirect_status(D.computed_refs(spark, sf_dir), 1000, 50)


@query(f"""WITH {D.FUNCTIONS} SELECT 'func:0x' || lower(to_hex(entry_va)) AS source_id, 'func:0x' || lower(to_hex(entry_va)) AS target_id, 'alias' AS edge_type, max(id) FILTER (view_id = 1) AS one_id, max(id) FILTER (view_id = 2) AS two_id FROM f GROUP BY entry_va HAVING count(DISTINCT view_id) = 2""")
def alias_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = D.program(spark, sf_dir)
    return typed_graph.alias_edges(g["functions"], g["views"], g["tools"])


def _typed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p, li, g = D.table(spark, sf_dir, "part"), D.table(spark, sf_dir, "lineitem"), D.program(spark, sf_dir)
    va, s = (F.col("l_partkey") * 16).alias("entry_va"), D.table(spark, sf_dir, "supplier")
    nodes = p.select((F.col("p_partkey") * 16).alias("entry_va"), F.array("p_name").alias("names"))
    calls = D.part_calls(spark, sf_dir).select((F.col("entry_va") * 16).alias("entry_va"), (F.col("callee_va") * 16).alias("callee_va"))
    there = li.join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    strings = there.where("s_suppkey % 2 = 0").select(va, (F.col("s_suppkey") + 100000000).alias("address_va"), F.col("s_name").alias("value"))
    globals_ = there.where("s_suppkey % 2 = 1").select(va, (F.col("s_suppkey") + 100000000).alias("global_va"))
    apis = li.where("l_returnflag = 'R'").select(va, F.concat(F.lit("api_"), F.col("l_linenumber").cast("string")).alias("api"))
    return typed_graph.typed_graph(nodes, calls, strings, globals_, apis, typed_graph.alias_edges(g["functions"], g["views"], g["tools"]))


_TYPED = f"""{D.FUNCTIONS}, j AS (SELECT l_partkey * 16 AS v, s_suppkey + 100000000 AS x, s_name, s_suppkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
 e AS (SELECT 'func:0x' || lower(to_hex(l_partkey * 16)) AS source_id, 'func:0x' || lower(to_hex(l_suppkey * 16)) AS target_id, 'calls' AS edge_type FROM lineitem WHERE l_partkey <> l_suppkey
  UNION SELECT 'func:0x' || lower(to_hex(v)), 'str:0x' || lower(to_hex(x)), 'refs_string' FROM j WHERE s_suppkey % 2 = 0 UNION SELECT 'func:0x' || lower(to_hex(v)), 'gvar:0x' || lower(to_hex(x)), 'accesses_global' FROM j WHERE s_suppkey % 2 = 1
  UNION SELECT 'func:0x' || lower(to_hex(l_partkey * 16)), 'api:api_' || l_linenumber, 'calls_api' FROM lineitem WHERE l_returnflag = 'R'
  UNION SELECT 'func:0x' || lower(to_hex(entry_va)), 'func:0x' || lower(to_hex(entry_va)), 'alias' FROM f GROUP BY entry_va HAVING count(DISTINCT view_id) = 2),
 n AS (SELECT 'func:0x' || lower(to_hex(p_partkey * 16)) AS node_id, 'function' AS node_type, p_name AS name FROM part UNION SELECT 'str:0x' || lower(to_hex(x)), 'string', s_name FROM j WHERE s_suppkey % 2 = 0
  UNION SELECT 'gvar:0x' || lower(to_hex(x)), 'global_var', 'gvar:0x' || lower(to_hex(x)) FROM j WHERE s_suppkey % 2 = 1 UNION SELECT 'api:api_' || l_linenumber, 'api', 'api_' || l_linenumber FROM lineitem WHERE l_returnflag = 'R')"""


@query(f"WITH {_TYPED} SELECT node_id, node_type, name FROM n")
def typed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(spark, sf_dir)[0]


@query(f"WITH {_TYPED} SELECT source_id, target_id, edge_type FROM e")
def typed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(spark, sf_dir)[1]


@query(f"WITH {_TYPED} SELECT 'node' AS part, node_type AS kind, count(*) AS n FROM n GROUP BY 2 UNION ALL SELECT 'edge', edge_type, count(*) FROM e GROUP BY 2")
def typed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_graph.graph_summary(*_typed(spark, sf_dir))


@query(f"""WITH {D.MIXED}, o AS (SELECT a AS v, b AS w FROM mixed WHERE contains(kinds, 'string') UNION ALL SELECT b, a FROM mixed WHERE contains(kinds, 'string')), k AS (SELECT v, w, row_number() OVER (PARTITION BY v ORDER BY w) AS n FROM o)
 SELECT v AS entry_va, string_agg('0x' || to_hex(w) || ' ' || p_name || ' [string]', chr(10) ORDER BY n) AS lines FROM k JOIN part ON p_partkey = w WHERE n <= 8 GROUP BY 1""")
def relation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entry_va"), F.col("p_name").alias("name"))
    found = typed_graph.relations(graph.mixed_edges(D.order_calls(spark, sf_dir), D.brand_strings(spark, sf_dir)), names)
    return found.select("entry_va", F.array_join("lines", "\n").alias("lines"))


@query("""WITH a AS (SELECT l_partkey AS v, list_sort(list_distinct(list('api_' || l_linenumber) FILTER (l_returnflag = 'R'))) AS apis, list_sort(list_distinct(list('s' || l_suppkey))) AS s FROM lineitem GROUP BY 1)
 SELECT v AS entry_va, concat_ws(chr(10), CASE WHEN len(apis) > 0 THEN 'apis: ' || array_to_string(apis[1:3], ', ') END, CASE WHEN len(s) > 0 THEN 'callees: ' || array_to_string(s[1:8], ', ') END) AS block FROM a""")
def evidence_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = D.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("entry_va")).agg(
        F.collect_set(F.when(F.col("l_returnflag") == "R", F.concat(F.lit("api_"), F.col("l_linenumber").cast("string")))).alias("apis"), F.collect_set(F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("callees"))
    return typed_graph.evidence_block(parts, {"apis": 3, "callees": 8})


# ---- status and reports ----------------------------------------------------------------------

_ANALYSED = f"""{D.STATUS}, {D.VIEWS}, an AS (SELECT entry_va, coalesce(f.name, '') AS original_name, coalesce(summary_signature, '') AS analyzed_name, coalesce(semantic_summary, '') AS semantic_summary, coalesce(analysis_state, 'PENDING') AS analysis_state,
 coalesce(confidence_score, 0) AS confidence, coalesce(annotation_status, 0) AS annotation_status FROM f JOIN v ON v.id = f.view_id JOIN tl ON tl.id = v.tool_id AND lower(tl.name) = 'ida' LEFT JOIN st ON st.function_id = f.id)"""


def _analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = D.program(spark, sf_dir)
    return reports.analysed_functions(g["functions"], g["status"], g["views"], g["tools"])


@query(f"WITH {_ANALYSED} SELECT * FROM an")
def analysed_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysed(spark, sf_dir)


@query(f"""WITH {_ANALYSED}, c AS (SELECT count(*) AS total, count(*) FILTER (analyzed_name <> '') AS analyzed, count(*) FILTER (analysis_state = 'LOCKED') AS locked, count(*) FILTER (annotation_status > 0) AS annotated FROM an)
 SELECT *, round(analyzed * 100.0 / total, 1) AS analyzed_pct, round(locked * 100.0 / total, 1) AS locked_pct, round(annotated * 100.0 / total, 1) AS annotated_pct FROM c""")
def report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.report_counts(_analysed(spark, sf_dir))


@query(f"""WITH {_ANALYSED} SELECT entry_va, printf('0x%08X', entry_va) AS address, original_name AS name, analyzed_name AS new_name, analysis_state || ' (' || confidence || ')' AS state,
 CASE WHEN length(semantic_summary) > 200 THEN substring(semantic_summary, 1, 197) || '...' ELSE semantic_summary END AS summary, annotation_status > 0 AS annotated FROM an""")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.report_lines(_analysed(spark, sf_dir))


@query(f"""WITH {_ANALYSED} SELECT entry_va, original_name, CASE WHEN contains(analyzed_name, '(') THEN string_split(trim(string_split(analyzed_name, '(')[1]), ' ')[-1] ELSE string_split(trim(analyzed_name), ' ')[1] END AS new_name, confidence
 FROM an WHERE analyzed_name <> '' AND analyzed_name <> original_name""")
def renamed_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.renamed_functions(_analysed(spark, sf_dir))


@query(f"""WITH {D.STATUS} SELECT function_id, upper(coalesce(analysis_state, 'PENDING')) AS analysis_state, coalesce(confidence_score, 0) AS confidence_score, coalesce(summary_signature, '') AS summary_signature, coalesce(semantic_summary, '') AS semantic_summary,
 coalesce(phase1_pending, 0) AS phase1_pending, coalesce(phase2_pending, 0) AS phase2_pending, lvar_optimized, annotation_status FROM st""")
def analysis_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.analysis_info(D.program(spark, sf_dir)["status"])


@query(f"""WITH {D.STATUS} SELECT function_id, upper(coalesce(analysis_state, 'PENDING')) AS analysis_state, coalesce(confidence_score, 0) AS confidence_score FROM st WHERE function_id IN (SELECT l_suppkey FROM lineitem)""")
def analysis_info_of_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = D.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("function_id"))
    return reports.analysis_info(D.program(spark, sf_dir)["status"], ids).select("function_id", "analysis_state", "confidence_score")


@query(f"""WITH {D.FUNCTIONS}, {D.VIEWS}, iv AS (SELECT binary_id, min(v.id) FILTER (lower(tl.name) = 'ida') AS view_id FROM v JOIN tl ON tl.id = v.tool_id GROUP BY 1), code AS (SELECT doc_id % 4 + 1 AS view_id FROM documents), x AS (SELECT l_linenumber % 5 + 1 AS view_id FROM lineitem),
 s AS (SELECT binary_id, view_id, (SELECT count(*) FROM f WHERE f.view_id = iv.view_id) AS functions, CASE WHEN view_id IS NOT NULL THEN (SELECT count(*) FROM x WHERE x.view_id = iv.view_id) END AS xrefs, CASE WHEN view_id IS NOT NULL THEN (SELECT count(*) FROM code WHERE code.view_id = iv.view_id) END AS pseudo_functions FROM iv)
 SELECT *, CASE WHEN functions > 15000 OR coalesce(xrefs, 0) > 800000 THEN 'very_large' WHEN functions > 8000 OR coalesce(xrefs, 0) > 300000 THEN 'large' ELSE 'normal' END AS size FROM s""")
def binary_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = D.program(spark, sf_dir)
    xrefs = D.table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 5 + 1).cast("bigint").alias("view_id"))
    code = D.table(spark, sf_dir, "documents").select((F.col("doc_id") % 4 + 1).alias("view_id"))
    return reports.binary_statistics(g["views"], g["tools"], g["functions"], xrefs, code)


_UNIFIED = "nd AS (SELECT p_partkey * 16 AS entry_va FROM part WHERE p_size > 3)"


def _unified(spark: SparkSession, sf_dir: str, g: dict[str, DataFrame]) -> DataFrame:
    some = D.table(spark, sf_dir, "part").where("p_size > 3").select((F.col("p_partkey") * 16).alias("entry_va"))
    return g["functions"].join(some, "entry_va").groupBy("entry_va").agg(F.collect_set("name").alias("names"))


@query(f"""WITH {D.STATUS}, {_UNIFIED} SELECT DISTINCT entry_va FROM f JOIN st ON st.function_id = f.id JOIN nd USING (entry_va) WHERE coalesce(analysis_state, 'PENDING') = 'ANALYZED' AND (coalesce(phase2_pending, 0) = 1 OR (coalesce(phase1_pending, 0) = 1 AND coalesce(phase2_pending, 0) = 0))""")
def pending_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = D.program(spark, sf_dir)
    return reports.pending_entries(g["functions"], g["status"], _unified(spark, sf_dir, g))


@query(f"""WITH {D.STATUS}, {_UNIFIED} SELECT entry_va FROM f JOIN nd USING (entry_va) WHERE regexp_matches(lower(name), 'main|entry|start') UNION SELECT entry_va FROM f JOIN st ON st.function_id = f.id JOIN nd USING (entry_va) WHERE confidence_score >= 80""")
def validation_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = D.program(spark, sf_dir)
    return reports.validation_entries(g["functions"], g["status"], _unified(spark, sf_dir, g))


@query(f"""WITH {D.STATUS} SELECT entry_va, NOT bool_or(coalesce(upper(analysis_state) IN ('ANALYZED', 'LOCKED'), false)) AS pending, bool_or(coalesce(upper(analysis_state) IN ('ANALYZED', 'LOCKED'), false) OR coalesce(phase1_pending, 0) <> 0) AS history,
 bool_or(view_id = 2 AND regexp_matches(name, '(?i)^(?:sub_|fun_|loc_)[0-9a-f]+$')) AS default_name FROM f LEFT JOIN st ON st.function_id = f.id GROUP BY 1""")
def node_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = D.program(spark, sf_dir)
    return reports.node_progress(g["functions"], g["status"], g["views"], g["tools"])


@query(f"""WITH {D.FUNCTIONS}, {D.CODE}, c AS (SELECT function_id, arg_min(coalesce(prototype, '') || chr(10) || coalesce(body, ''), (-length(coalesce(body, '')), code_id)) AS code FROM code WHERE trim(coalesce(body, '')) <> '' GROUP BY 1)
 SELECT entry_va, CASE WHEN max(view_id) = 2 THEN 'ida' ELSE 'ghidra' END AS tool, arg_max(id, view_id) AS function_id, trim(arg_max(code, view_id)) AS code FROM f JOIN c ON c.function_id = f.id GROUP BY 1""")
def preferred_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = D.program(spark, sf_dir)
    return reports.preferred_code(g["functions"], g["code"], g["views"], g["tools"])


@query(f"""WITH {D.STATUS} SELECT entry_va, arg_max(semantic_summary, (confidence_score, -id)) AS summary, max(confidence_score) AS confidence FROM f JOIN (SELECT function_id, semantic_summary, coalesce(confidence_score, 0) AS confidence_score FROM st) s ON function_id = id WHERE semantic_summary <> '' AND confidence_score >= 60 GROUP BY 1""")
def best_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = D.program(spark, sf_dir)
    return reports.best_summary(g["functions"], g["status"], 60)


@query(f"""WITH {D.STATUS} SELECT entry_va, arg_max(id, view_id) AS function_id, arg_max(upper(coalesce(analysis_state, 'PENDING')), view_id) AS analysis_state, arg_max(coalesce(confidence_score, 0), view_id) AS confidence, arg_max(coalesce(summary_signature, ''), view_id) AS signature, arg_max(coalesce(semantic_summary, ''), view_id) AS summary
 FROM f JOIN st ON st.function_id = f.id GROUP BY 1""")
def backup_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = D.program(spark, sf_dir)
    return reports.backup_profile(g["functions"], g["status"], g["views"], g["tools"])


@query("""WITH w AS (SELECT DISTINCT CASE WHEN n_nationkey % 2 = 0 THEN r_name ELSE n_name END AS name FROM nation JOIN region ON r_regionkey = n_regionkey), t AS (SELECT CAST(r_regionkey + 1 AS BIGINT) AS id, r_name AS name FROM region WHERE r_regionkey < 3)
 SELECT id, name FROM t UNION ALL SELECT (SELECT max(id) FROM t) + row_number() OVER (ORDER BY name), name FROM w WHERE name NOT IN (SELECT name FROM t)""")
def registered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = D.table(spark, sf_dir, "nation"), D.table(spark, sf_dir, "region")
    wanted = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.when(F.col("n_nationkey") % 2 == 0, F.col("r_name")).otherwise(F.col("n_name")).alias("name"))
    have = r.where("r_regionkey < 3").select((F.col("r_regionkey") + 1).cast("bigint").alias("id"), F.col("r_name").alias("name"))
    return reports.registered(have, wanted, "name")


# ---- reconciliation --------------------------------------------------------------------------

_TOKENS = "list_distinct(regexp_extract_all({}, '[A-Za-z_][\\p{{L}}\\p{{N}}_]*|\\p{{Nd}}+|[^\\s\\p{{L}}\\p{{N}}_]'))"


@query(f"""WITH c AS (SELECT conv_id, turn, text AS a, lead(text) OVER w AS b, role AS na, lead(role) OVER w AS nb FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
 t AS (SELECT conv_id, turn, {_TOKENS.format('a')} AS x, {_TOKENS.format('b')} AS y, na = nb AS same FROM c WHERE a IS NOT NULL AND b IS NOT NULL),
 j AS (SELECT *, CASE WHEN len(x) + len(y) = 0 THEN 1.0 ELSE CAST(len(list_intersect(x, y)) AS DOUBLE) / len(list_distinct(list_concat(x, y))) END AS sim FROM t)
 SELECT conv_id, turn, round(sim, 6) AS similarity FROM j""")
def token_jaccard_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reconcile.agreement(D.turns(spark, sf_dir), "code_a", "code_b", "name_a", "name_b")
    return rows.select("conv_id", "turn", F.round("pseudo_similarity", 6).alias("similarity"))


@query("""WITH p AS (SELECT p_partkey, p_size % 3 = 0 AS api, p_size % 5 = 0 AS str, p_size % 7 = 0 AS gr, p_size % 2 = 0 AS longer FROM part)
 SELECT p_partkey, round(CAST((CASE WHEN api THEN 0.35 ELSE 0 END) + (CASE WHEN str THEN 0.25 ELSE 0 END) + (CASE WHEN gr THEN 0.10 ELSE 0 END) AS DOUBLE), 4) AS evidence_score, CAST(api AS INTEGER) + CAST(str AS INTEGER) + CAST(gr AS INTEGER) AS signals,
  round(CAST(0.30 + 0.25 + (CASE WHEN longer THEN 0.25 ELSE 0 END) + (CASE WHEN p_partkey % 100 >= 60 THEN 0.20 ELSE 0 END) AS DOUBLE), 4) AS quality FROM p JOIN part USING (p_partkey)""")
def evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lambda when, w: F.when(when, F.array(F.lit(w))).otherwise(F.array().cast("array<string>"))
    p = D.table(spark, sf_dir, "part").select(
        "p_partkey", F.lit("parse_packet").alias("name"), F.lit("int parse_packet(char *)").alias("summary_signature"), F.when(F.col("p_size") % 2 == 0, "reads a packet and keeps its fields").otherwise("short").alias("semantic_summary"), F.lit("").alias("structured_analysis"),
        (F.col("p_partkey") % 100).cast("int").alias("confidence_score"), words(F.col("p_size") % 3 == 0, "packet").alias("api"), words(F.col("p_size") % 5 == 0, "parse").alias("string"), words(F.lit(False), "x").alias("relation"), words(F.col("p_size") % 7 == 0, "char").alias("graph"),
        words(F.lit(False), "x").alias("existing"), words(F.lit(True), "other_name").alias("symbols"))
    return reconcile.evidence(p).select("p_partkey", "evidence_score", "signals", "quality")


@query("""WITH o AS (SELECT o_orderkey, o_totalprice / 1000.0 AS new_score, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) / 1000.0 AS old_score, o_orderstatus FROM orders),
 x AS (SELECT o_orderkey, o_orderstatus = 'F' AS chosen, round(new_score - coalesce(old_score, 0), 6) >= 5 AS better FROM o)
 SELECT o_orderkey, CASE WHEN chosen AND better THEN 'new' ELSE 'old' END AS selected, concat_ws(',', CASE WHEN NOT chosen THEN 'llm_did_not_choose_new' END, CASE WHEN NOT better THEN 'delta_below_threshold' END) AS reasons FROM x""")
def profile_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    old = F.lag("o_totalprice").over(W.partitionBy("o_custkey").orderBy("o_orderkey")) / 1000.0
    o = D.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000.0).alias("new_score"), old.alias("old_score"), F.when(F.col("o_orderstatus") == "F", "new").otherwise("old").alias("choice"))
    return reconcile.choose(o, 5.0, gated=False).select("o_orderkey", "selected", F.array_join("reasons", ",").alias("reasons"))


_BOARD = """b AS (SELECT user_id AS entry_va, CASE event_id % 2 WHEN 0 THEN 'note' ELSE 'tag' END AS kind, event_type AS value, CAST(floor(value) % 130 - 10 AS INTEGER) AS confidence,
  CASE event_id % 6 WHEN 0 THEN 'manual' WHEN 1 THEN 'gen1' WHEN 2 THEN 'gen2' WHEN 3 THEN 'breadth' WHEN 4 THEN 'auto' ELSE 'gen3' END AS source, event_id AS seq FROM events),
 k AS (SELECT *, CASE source WHEN 'manual' THEN 100 WHEN 'gen1' THEN 80 WHEN 'gen2' THEN 60 WHEN 'breadth' THEN 40 WHEN 'auto' THEN 20 ELSE 0 END AS rank, least(greatest(confidence, 0), 100) AS conf FROM b)"""


def _board(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.table(spark, sf_dir, "events")
    m = F.col("event_id") % 6
    source = F.when(m == 0, "manual").when(m == 1, "gen1").when(m == 2, "gen2").when(m == 3, "breadth").when(m == 4, "auto").otherwise("gen3")
    return e.select(
        F.col("user_id").alias("entry_va"), F.when(F.col("event_id") % 2 == 0, "note").otherwise("tag").alias("kind"), F.col("event_type").alias("value"), (F.floor("value") % 130 - 10).cast("int").alias("confidence"),
        source.alias("source"), F.lit(0).alias("generation"), F.lit(0).alias("goal_index"), F.lit("").alias("ts"), F.col("event_id").alias("seq"))


@query(f"""WITH {_BOARD} SELECT entry_va, kind, value, confidence, source, seq FROM (SELECT *, row_number() OVER (PARTITION BY entry_va, kind ORDER BY rank DESC, conf DESC, seq DESC) AS r FROM k) WHERE r = 1""")
def blackboard_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.board_winners(_board(spark, sf_dir)).select("entry_va", "kind", "value", "confidence", "source", "seq")


@query(f"""WITH {_BOARD}, h AS (SELECT *, max((rank, conf, seq, value)) OVER (PARTITION BY entry_va, kind ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM k)
 SELECT entry_va, kind, seq, held[4] AS old_value, value AS new_value, CASE WHEN (rank, conf, seq, value) > held THEN value ELSE held[4] END AS winner FROM h WHERE held IS NOT NULL AND held[4] <> value""")
def blackboard_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.board_conflicts(_board(spark, sf_dir))


@query(f"""WITH {_BOARD}, w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry_va, kind ORDER BY rank DESC, conf DESC, seq DESC) AS r FROM k) WHERE r = 1),
 h AS (SELECT *, max((rank, conf, seq, value)) OVER (PARTITION BY entry_va, kind ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM k)
 SELECT 'total' AS part, 'entries' AS name, count(*) AS n FROM w UNION ALL SELECT 'total', 'addresses', count(DISTINCT entry_va) FROM w UNION ALL SELECT 'total', 'conflicts', count(*) FROM h WHERE held IS NOT NULL AND held[4] <> value
 UNION ALL SELECT 'kind', kind, count(*) FROM w GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM w GROUP BY 2""")
def blackboard_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = _board(spark, sf_dir)
    return reconcile.board_stats(reconcile.board_winners(board), reconcile.board_conflicts(board))


@query(f"""WITH {_BOARD}, w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry_va, kind ORDER BY rank DESC, conf DESC, seq DESC) AS r FROM k) WHERE r = 1) SELECT entry_va, kind, value FROM w WHERE kind IN ('note', 'other')""")
def blackboard_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.board_by_kinds(reconcile.board_winners(_board(spark, sf_dir)), ["note", "other"]).select("entry_va", "kind", "value")


_WINNERS = f"{_BOARD}, w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry_va, kind ORDER BY rank DESC, conf DESC, seq DESC) AS r FROM k) WHERE r = 1)"


@query(f"WITH {_WINNERS} SELECT entry_va, kind, value, confidence, source FROM w WHERE contains(lower(value), 'c')")
def blackboard_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winning entries that hold a word."""
    return reconcile.board_search(reconcile.board_winners(_board(spark, sf_dir)), "C").select("entry_va", "kind", "value", "confidence", "source")


@query(f"""WITH {_WINNERS}, ln AS (SELECT *, '0x' || lpad(to_hex(entry_va), 8, '0') || ' ' || kind || ': ' || value AS line FROM w),
 nb AS (SELECT me, entry_va, kind, line, row_number() OVER (PARTITION BY me ORDER BY rank DESC, confidence DESC, entry_va, kind) AS place FROM (SELECT DISTINCT user_id AS me FROM events) JOIN ln ON entry_va BETWEEN me + 1 AND me + 3),
 al AS (SELECT entry_va AS me, 0 AS tier, entry_va, kind, line FROM ln UNION ALL SELECT me, 1, entry_va, kind, line FROM nb WHERE place <= 4)
 SELECT me AS entry_va, string_agg(line, chr(10) ORDER BY tier, entry_va, kind) AS context FROM al GROUP BY me""")
def blackboard_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node's own entries and the surest four of its three neighbours."""
    board = _board(spark, sf_dir)
    near = board.select("entry_va").distinct().select("entry_va", F.explode(F.sequence(F.col("entry_va") + 1, F.col("entry_va") + 3)).alias("neighbour_va"))
    return reconcile.board_context(reconcile.board_winners(board), near, 4).select("entry_va", F.array_join("lines", "\n").alias("context"))


@query("""SELECT CAST(0 AS BIGINT) AS entry_va, 'note' AS kind, concat_ws(': ', nullif(trim(role), ''), trim(text)) AS value, CAST(turn AS INTEGER) AS confidence FROM conversations WHERE trim(coalesce(text, '')) <> ''""")
def blackboard_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = D.table(spark, sf_dir, "conversations").select(F.col("role").alias("title"), F.col("text").alias("finding"), F.col("turn").alias("confidence"))
    return reconcile.board_from_steps(steps, "auto", 1, 0).select("entry_va", "kind", "value", "confidence")


@query("""SELECT p_partkey AS function_id, CASE WHEN p_partkey % 4 = 0 AND p_size % 2 = 0 THEN 'LOCKED' WHEN p_partkey % 4 = 0 THEN 'ANALYZED' ELSE 'PENDING' END AS analysis_state, CASE WHEN p_partkey % 4 = 0 THEN p_size ELSE 0 END AS confidence_score FROM part""")
def status_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.table(spark, sf_dir, "part")
    base = p.where("p_partkey % 3 != 0").select(F.col("p_partkey").alias("function_id"), F.lit("PENDING").alias("analysis_state"), F.lit(0).alias("confidence_score"))
    rest = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("function_id"), F.lit("PENDING").alias("analysis_state"), F.lit(0).alias("confidence_score"))
    new = p.where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("function_id"), F.when(F.col("p_size") % 2 == 0, "LOCKED").otherwise("ANALYZED").alias("analysis_state"), F.col("p_size").alias("confidence_score"))
    return store.upsert(store.insert_missing(base, rest, ["function_id"]), new, ["function_id"])


@query("""SELECT p_partkey AS function_id, CASE WHEN p_partkey % 2 = 0 THEN 'ANALYZED' ELSE 'PENDING' END AS analysis_state FROM part""")
def status_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.schema import conform

    p = D.table(spark, sf_dir, "part")
    have = conform(p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("function_id"), F.lit("ANALYZED").alias("analysis_state")), "analysis_status")
    return store.ensure_status(have, p.select(F.col("p_partkey").alias("id"))).select("function_id", "analysis_state")


# ---- metrics ---------------------------------------------------------------------------------


@query(f"WITH {D.RUNS} SELECT sample, variant, runs, successes, timeouts, runner_errors, wall_mean AS wall_time_sec_mean, wall_p50 AS wall_time_sec_p50, wall_p95 AS wall_time_sec_p95, wall_max AS wall_time_sec_max, wall_cv AS wall_time_sec_cv FROM summary")
def run_metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = metrics.summarise(D.runs(spark, sf_dir), ["wall_time_sec"], ["wall_time_sec"])
    return s.select("sample", "variant", "runs", "successes", "timeouts", "runner_errors", *[f"wall_time_sec_{k}" for k in ("mean", "p50", "p95", "max", "cv")])


@query(f"""WITH {D.RUNS} SELECT m.sample, m.variant, round(b.wall_mean / m.wall_mean, 6) AS speedup, round((b.tok_mean - m.tok_mean) / b.tok_mean * 100, 4) AS reduction_pct, round(m.goal_mean - b.goal_mean, 6) AS goal_recall_delta
 FROM summary m JOIN summary b ON m.sample = b.sample AND b.variant = 'legacy' WHERE m.variant LIKE 'practical-%'""")
def variant_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = metrics.summarise(D.runs(spark, sf_dir), ["wall_time_sec", "total_tokens", "goal_recall"], [])
    return metrics.compare(s, "legacy", "practical-", "wall_time_sec", "total_tokens", ["goal_recall"])


@query(f"WITH {D.RUNS} SELECT sample, variant, successes = runs AS success_rate_100, timeouts = 0 AS no_timeouts, successes = runs AND timeouts = 0 AS passed FROM summary")
def acceptance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = metrics.summarise(D.runs(spark, sf_dir), ["wall_time_sec"], [])
    return metrics.acceptance(s).select("sample", "variant", "success_rate_100", "no_timeouts", "passed")


@query("""WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 2 END AS attempt, CASE WHEN event_type = 'purchase' THEN 'ok' ELSE 'bad' END AS status, CAST(event_id % 3 AS INTEGER) * 100 AS budget FROM events),
 g AS (SELECT *, sum(CASE WHEN attempt <= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM e),
 s AS (SELECT user_id, grp, count(*) AS n, max(attempt) AS most, arg_max(status, (ts, event_id)) AS last, arg_min(budget, (ts, event_id)) FILTER (budget > 0) AS fb, max(budget) AS mb, count(*) FILTER (budget > 0) AS bs FROM g GROUP BY 1, 2)
 SELECT user_id, CAST(sum(n) AS BIGINT) AS attempts, count(*) AS interactions, count(*) FILTER (n > 1 OR most > 1) AS retried, count(*) FILTER ((n > 1 OR most > 1) AND last = 'ok') AS recovered, count(*) FILTER ((n > 1 OR most > 1) AND last <> 'ok') AS failed, count(*) FILTER ((n > 1 OR most > 1) AND bs >= 2 AND mb > fb) AS expansions FROM s GROUP BY 1""")
def retry_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type") == "error", 1).otherwise(2).alias("attempt"), F.when(F.col("event_type") == "purchase", "ok").otherwise("bad").alias("status"), (F.col("event_id") % 3 * 100).cast("int").alias("budget"))
    return metrics.recovery(e, ["user_id"], ["ts", "event_id"])


@query("""WITH p AS (SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY 1), x AS (SELECT conv_id, len(list_filter(roles, lambda r: r = 'user')) >= 1 AND len(roles) - list_position(roles, 'user') >= 1 AND list_contains(roles[list_position(roles, 'user') + 1:], 'assistant') AS a FROM p)
 SELECT CAST(conv_id AS VARCHAR) AS sample, CAST(1 AS BIGINT) AS expected_paths, CAST(coalesce(a, false) AS DOUBLE) AS path_recall FROM x""")
def path_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = D.table(spark, sf_dir, "conversations")
    paths = c.groupBy(F.col("conv_id").cast("string").alias("sample")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("path"))
    expected = c.select(F.col("conv_id").cast("string").alias("sample")).distinct().withColumn("expected", F.array(F.lit("user"), F.lit("assistant")))
    return metrics.path_recall(paths, expected)


@query("""WITH h AS (SELECT sha256(coalesce(CAST(l_orderkey AS VARCHAR), '') || '|' || coalesce(CAST(l_linenumber AS VARCHAR), '') || '|' || coalesce(l_returnflag, '')) AS h FROM lineitem),
 c AS (SELECT CAST('0x' || substring(h, 49, 8) AS BIGINT) % 1024 AS chunk, count(*) AS n, sum(CAST('0x' || substring(h, 1, 15) AS BIGINT)) AS h0, sum(CAST('0x' || substring(h, 16, 15) AS BIGINT)) AS h1, sum(CAST('0x' || substring(h, 31, 15) AS BIGINT)) AS h2 FROM h GROUP BY 1)
 SELECT CAST(sum(n) AS BIGINT) AS rows, sha256(array_to_string(list_sort(list(chunk || ':' || n || ':' || h0 || ':' || h1 || ':' || h2)), chr(10))) AS digest FROM c""")
def metric_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.chunked_digest(D.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_returnflag"])


@query("""SELECT conv_id, CAST(sum(CASE WHEN turn % 3 = 0 THEN turn ELSE turn * 2 END) AS BIGINT) AS prompt_tokens, CAST(sum(CASE WHEN turn % 3 = 0 THEN 1 ELSE 2 END) AS BIGINT) AS completion_tokens, CAST(sum(CASE WHEN turn % 3 = 0 THEN turn + 1 ELSE turn * 2 + 2 END) AS BIGINT) AS total_tokens FROM conversations GROUP BY 1""")
def nested_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, none = D.table(spark, sf_dir, "conversations"), F.lit(None).cast("bigint")
    one = F.struct(F.col("turn").alias("prompt_tokens"), F.lit(1).cast("bigint").alias("completion_tokens"), none.alias("total_tokens"))
    own = F.col("turn") % 3 == 0
    step = F.struct(F.when(own, F.col("turn")).alias("prompt_tokens"), F.when(own, F.lit(1).cast("bigint")).alias("completion_tokens"), none.alias("total_tokens"), F.array(one, one).alias("attempts"))
    return metrics.flat_usage(c.select("conv_id", F.array(step).alias("usage")), ["conv_id"])


@query("""SELECT count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0""")
def finite_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = D.table(spark, sf_dir, "orders").withColumn("x", F.when(F.col("o_orderkey") % 5 == 0, float("nan")).when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")))
    return metrics.numeric(o, "x").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 4).alias("mean"))


@query("""SELECT 'parts' AS metric, (SELECT count(*) FROM part) AS rows_current, (SELECT count(*) FROM part WHERE p_size > 1) AS rows_rebuilt""")
def profile_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = D.table(spark, sf_dir, "part"), D.table(spark, sf_dir, "nation")
    current = metrics.profile({"parts": (p, p.columns), "nations": (n, n.columns)})
    rebuilt = metrics.profile({"parts": (p.where("p_size > 1"), p.columns), "nations": (n.orderBy(F.desc("n_name")), n.columns)})
    return metrics.diff(current, rebuilt).select("metric", "rows_current", "rows_rebuilt")


@query(f"""WITH RECURSIVE {D.ORDER_CALLS}, r AS (SELECT v, v AS origin, CAST(0.99 AS DOUBLE) AS conf, 0 AS k FROM {D.busiest_sql(2)}
  UNION SELECT callee_va, origin, conf * 0.9, k + 1 FROM r JOIN ocalls ON entry_va = v WHERE conf >= 0.7 AND k < 10)
 SELECT 'func:' || v AS node_id, 't' || origin AS value, CAST(min(k) AS INTEGER) AS round, round(arg_min(conf, k), 6) AS confidence FROM r GROUP BY v, origin""")
def rule_fixed_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = lambda c: F.concat(F.lit("func:"), F.col(c).cast("string"))
    calls = D.order_calls(spark, sf_dir)
    edges = calls.select(node("entry_va").alias("source_id"), node("callee_va").alias("target_id"), F.lit("CALLS").alias("edge_type"))
    facts = D.busiest(calls, 2).select(node("entry_va").alias("node_id"), F.lit("v1").alias("variable"), F.concat(F.lit("t"), F.col("entry_va").cast("string")).alias("value"), F.lit("given").alias("source"), F.lit(0.99).alias("confidence"))
    out = rules.run(facts, edges, [(100, rules.type_propagation())])
    return out.select("node_id", "value", "round", F.round("confidence", 6).alias("confidence"))


from tessera.plans import phases  # noqa: E402, F401  its queries build on those above
