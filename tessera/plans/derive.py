"""Program-structure tables derived from the driver's tables, in Spark and as the same SQL CTEs.

Parts are functions, line items their instructions and references, suppliers callees, orders
call graphs, documents and conversations code text, events benchmark runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols as a tool exports them: text columns."""
    p = table(spark, sf_dir, "part")
    va = F.col("p_partkey") * 16 + 4194304
    return p.select(
        F.col("p_partkey").alias("ord"), F.concat(F.lit("fn_"), F.col("p_partkey").cast("string")).alias("Name"),
        F.when(F.col("p_partkey") % 11 == 0, F.concat(F.lit("0xEXTERNAL:"), F.format_string("%08X", "p_partkey"))).when(F.col("p_partkey") % 2 == 0, F.format_string("0x%08X", va)).otherwise(F.lower(F.format_string("%08X", va))).alias("Address"),
        F.when(F.col("p_size") % 4 == 0, "Function").when(F.col("p_size") % 4 == 1, "LABEL").when(F.col("p_size") % 4 == 2, "Data").otherwise("thunk").alias("Type"), F.lit("ANALYSIS").alias("Source"),
        F.when(F.col("p_size") % 3 == 0, "True").otherwise("no").alias("Is Global"), F.lit("maybe").alias("Is Primary"), F.when(F.col("p_size") % 5 == 0, "yes").otherwise("f").alias("Is External"), F.col("p_brand").alias("Namespace"))


RAW_SYMBOLS = """raw AS (SELECT p_partkey AS ord, 'fn_' || p_partkey AS name, p_partkey % 11 AS odd,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_partkey * 16 + 4194304 END AS address_va,
  p_size % 4 AS t, p_size % 3 = 0 AS g, p_size % 5 = 0 AS e, p_brand AS namespace FROM part)"""


def part_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``entry_va, callee_va``: a part calls the parts numbered like its suppliers."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entry_va"), F.col("l_suppkey").alias("callee_va"))
    return li.where("entry_va != callee_va").distinct()


def part_nodes(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """Nodes of parts: numbers of callees and callers, string and interface references, instruction counts; of the
    parts ``only`` (``entry_va``), where given."""
    p = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "entry_va")
    li = table(spark, sf_dir, "lineitem")
    calls = li.select(F.col("l_partkey").alias("entry_va"), F.col("l_suppkey").alias("callee_va")).where("entry_va != callee_va").distinct()
    lines = li.withColumnRenamed("l_partkey", "entry_va")
    calling, called = calls.select("entry_va"), calls.select(F.col("callee_va").alias("entry_va"))
    if only is not None:
        p, lines, calling, called = (df.join(only, "entry_va", "left_semi") for df in (p, lines, calling, called))
    per = lines.groupBy("entry_va").agg(
        F.count(F.lit(1)).alias("instr_count"), F.collect_set(F.when(F.col("l_returnflag") == "R", F.concat(F.lit("api_"), F.col("l_linenumber").cast("string")))).alias("external_callees"))
    # calls are distinct already, so they are counted as they stand
    callees = calling.groupBy("entry_va").agg(F.count(F.lit(1)).cast("int").alias("callees"))
    callers = called.groupBy("entry_va").agg(F.count(F.lit(1)).cast("int").alias("callers"))
    own = p.select("entry_va", F.array("p_name").alias("names"), F.array_distinct(F.array("p_brand", "p_type")).alias("string_refs"), "p_size")
    return own.join(per, "entry_va", "left").join(callees, "entry_va", "left").join(callers, "entry_va", "left")


PART_NODES = """calls AS (SELECT DISTINCT l_partkey AS entry_va, l_suppkey AS callee_va FROM lineitem WHERE l_partkey <> l_suppkey),
per AS (SELECT l_partkey AS entry_va, count(*) AS instr, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_linenumber END) AS apis FROM lineitem GROUP BY 1),
co AS (SELECT entry_va, count(*) AS internal FROM calls GROUP BY 1),
ca AS (SELECT callee_va AS entry_va, count(*) AS callers FROM calls GROUP BY 1),
nodes AS (SELECT p_partkey AS entry_va, p_size, 2 AS strings, coalesce(apis, 0) AS apis, coalesce(instr, 0) AS instr, coalesce(internal, 0) AS internal, coalesce(callers, 0) AS callers
  FROM part LEFT JOIN per ON per.entry_va = p_partkey LEFT JOIN co ON co.entry_va = p_partkey LEFT JOIN ca ON ca.entry_va = p_partkey)"""


def score_sql(analysed: str) -> str:
    """The priority of ``nodes n`` with ``analysed`` callees."""
    return f"""CAST((CASE WHEN apis > 0 THEN 200 + 40 * least(apis, 5) ELSE 0 END) + (CASE WHEN strings > 0 THEN 120 + 15 * least(strings, 5) ELSE 0 END)
  + (CASE WHEN internal = 0 THEN 60 ELSE greatest(0, 40 - internal * 4) END) + least(callers * 6, 40)
  + (CASE WHEN instr = 0 THEN -20 WHEN instr <= 30 THEN 15 WHEN instr <= 150 THEN 5 ELSE -least(((instr - 150) // 50) * 5, 40) END) + 25 * {analysed} AS BIGINT)"""


def order_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``entry_va, callee_va``: an order's customer calls the part of its lowest line, numbers being addresses."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    first = li.groupBy("l_orderkey").agg(F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("callee_va"))
    return o.join(first, o["o_orderkey"] == first["l_orderkey"]).select(F.col("o_custkey").alias("entry_va"), "callee_va").where("entry_va != callee_va").distinct()


def kept_order_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, made once, for queries that read them in several places or rounds."""
    return graph.kept(order_calls(spark, sf_dir), "calls")


ORDER_CALLS = """ocalls AS (SELECT DISTINCT o_custkey AS entry_va, callee_va FROM orders JOIN (SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS callee_va FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE o_custkey <> callee_va)"""


def busiest(calls: DataFrame, k: int, by: str = "entry_va") -> DataFrame:
    """``entry_va`` of the ``k`` functions that call the most others (or are called by the most)."""
    return calls.groupBy(F.col(by).alias("entry_va")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "entry_va").limit(k).select("entry_va")


def busiest_sql(k: int, by: str = "entry_va") -> str:
    return f"(SELECT {by} AS v FROM ocalls GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT {k})"


def brand_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``entry_va, value``: parts refer to their brand."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entry_va"), F.col("p_brand").alias("value"))


MIXED = (
    ORDER_CALLS
    + """,
few AS (SELECT v, s FROM (SELECT p_partkey AS v, lower(p_brand) AS s, row_number() OVER (PARTITION BY lower(p_brand) ORDER BY p_partkey) AS r FROM part) WHERE r <= 20),
kinds AS (SELECT least(entry_va, callee_va) AS a, greatest(entry_va, callee_va) AS b, 'call' AS kind FROM ocalls
  UNION SELECT x.v, y.v, 'string' FROM few x JOIN few y ON x.s = y.s AND x.v < y.v),
mixed AS (SELECT a, b, string_agg(kind, ',' ORDER BY kind) AS kinds, min(CASE kind WHEN 'call' THEN 1.0 ELSE 0.4 END) AS cost FROM kinds WHERE a <> b GROUP BY a, b)""")


#: Lines of an order that have a node of their own.
ORDER_LINES = 1 << 24


def line_address(node: Column) -> Column:
    """Address of a line's node.  That of an order's 17th line is also that of the next order's first."""
    return F.shiftright(node, 24) * 16 + node % ORDER_LINES


def line_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``entry_va, callee_va``: each line of an order calls the next two.  These are nodes, a line each, as
    addresses (``line_address``) aren't unique."""
    li = table(spark, sf_dir, "lineitem")
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = li.select("l_orderkey", F.row_number().over(w).alias("n"))
    at = lambda k: (F.col("l_orderkey") * ORDER_LINES + F.col("n") + k)
    last = F.max("n").over(W.partitionBy("l_orderkey"))
    return lines.withColumn("last", last).select(at(0).alias("entry_va"), F.explode(F.filter(F.array(F.lit(1), F.lit(2)), lambda k: F.col("n") + k <= F.col("last"))).alias("k")).select("entry_va", (F.col("entry_va") + F.col("k")).alias("callee_va"))


LINES = """lines AS (SELECT l_orderkey * 16 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS v, count(*) OVER (PARTITION BY l_orderkey) - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS below,
  count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)"""

# Two views of a program over the parts, in words that both engines read alike.
FUNCTIONS = """f AS (SELECT p_partkey AS id, CAST(1 AS BIGINT) AS view_id, p_partkey * 16 AS entry_va, 'FUN_' || lpad(CAST(p_partkey AS STRING), 6, '0') AS name FROM part WHERE p_partkey % 4 <> 0
  UNION ALL SELECT p_partkey + 10000000, CAST(2 AS BIGINT), p_partkey * 16, CASE p_partkey % 4 WHEN 1 THEN p_name WHEN 2 THEN 'main_' || CAST(p_partkey AS STRING) ELSE 'sub_' || CAST(p_partkey AS STRING) END FROM part WHERE p_partkey % 5 <> 0)"""
STATUS = (
    FUNCTIONS
    + """,
st AS (SELECT id AS function_id, CASE id % 6 WHEN 0 THEN 'LOCKED' WHEN 1 THEN 'ANALYZED' WHEN 2 THEN 'analyzed' WHEN 3 THEN 'PENDING' WHEN 4 THEN 'ANALYZED' END AS analysis_state, CASE WHEN id % 8 <> 0 THEN CAST(id % 101 AS INT) END AS confidence_score,
  CASE id % 5 WHEN 1 THEN name WHEN 2 THEN 'int parse_' || CAST(id AS STRING) || ' (char *a)' WHEN 3 THEN 'open_' || CAST(id AS STRING) || ' handle' WHEN 4 THEN '' END AS summary_signature,
  CASE WHEN id % 3 <> 0 THEN 'summary of ' || name || repeat(' and more', CAST(id % 40 AS INT)) END AS semantic_summary, CAST(id % 2 AS INT) AS phase1_pending, CASE WHEN id % 4 <> 3 THEN CASE WHEN id % 10 >= 5 THEN 1 ELSE 0 END END AS phase2_pending,
  0 AS lvar_optimized, CASE WHEN id % 9 = 0 THEN 1 ELSE 0 END AS annotation_status FROM f WHERE id % 7 <> 0)""")
VIEWS = "v(id, binary_id, tool_id) AS (VALUES (1, 1, 1), (2, 1, 2), (3, 2, 1), (4, 3, 2)), tl(id, name) AS (VALUES (1, 'Ghidra'), (2, 'IDA'))"
CODE = """code AS (SELECT doc_id * 2 AS code_id, doc_id AS function_id, 'int f(void)' AS prototype, text AS body FROM documents UNION ALL SELECT doc_id * 2 + 1, doc_id, NULL, substring(text, 1, 50) FROM documents
  UNION ALL SELECT doc_id * 2 + 100000000, doc_id + 10000000, 'int g(void)', CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE substring(text, 1, 200) END FROM documents)"""


def program(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Functions, status, views, tools and code of the two views."""
    part, documents = table(spark, sf_dir, "part"), table(spark, sf_dir, "documents")
    cte = lambda text, name: spark.sql(f"WITH {text.replace('FROM part', 'FROM {part}').replace('FROM documents', 'FROM {documents}')} SELECT * FROM {name}", part=part, documents=documents)
    return {
        "functions": cte(FUNCTIONS, "f"), "status": cte(STATUS, "st"), "code": cte(CODE, "code"),
        "views": spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, 2, 1), (4, 3, 2)], "id long, binary_id long, tool_id long"),
        "tools": spark.createDataFrame([(1, "Ghidra"), (2, "IDA")], "id long, name string")}


def computed_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of which some are computed calls with a name and no known target."""
    li = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "19").when(F.col("l_returnflag") == "A", "COMPUTED_CALL").otherwise("READ")
    name = F.when(F.col("l_linenumber") % 4 == 0, "").otherwise(F.concat(F.lit(" FN_"), F.col("l_suppkey").cast("string")))
    dst = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_suppkey") * 16).otherwise(F.col("l_suppkey") + 100000000)
    return li.select(F.lit(1).cast("bigint").alias("view_id"), (F.col("l_partkey") * 16).alias("src_va"), dst.alias("dst_va"), name.alias("dst_name"), kind.alias("ref_type_raw"))


def refs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Functions, instructions, strings and references of one view: suppliers with an even key are
    strings, others globals."""
    p, s, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem")
    view = F.lit(1).cast("bigint").alias("view_id")
    return {
        "functions": p.select(F.col("p_partkey").alias("id"), view, (F.col("p_partkey") * 16).alias("entry_va"), F.col("p_name").alias("name"), F.lit("").alias("raw_file")),
        "instructions": p.select(view, F.col("p_partkey").alias("function_id"), F.lit(0).alias("index_in_function"), (F.col("p_partkey") * 16).alias("address_va")),
        "strings": s.where("s_suppkey % 2 = 0").select(view, F.col("s_name").alias("value"), (F.col("s_suppkey") + 100000000).alias("address_va")),
        "xrefs": li.select(view, (F.col("l_partkey") * 16).alias("src_va"), F.when(F.col("l_linenumber") == 7, F.col("l_suppkey") * 16).otherwise(F.col("l_suppkey") + 100000000).alias("dst_va"), F.lit(None).cast("string").alias("dst_name"), F.lit("READ").alias("ref_type_raw")),
    }


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive turns of a conversation as two views of one function's code."""
    c = table(spark, sf_dir, "conversations")
    w = W.partitionBy("conv_id").orderBy("turn")
    return c.select("conv_id", "turn", F.col("text").alias("code_a"), F.lead("text").over(w).alias("code_b"), F.col("role").alias("name_a"), F.lead("role").over(w).alias("name_b")).where("code_a is not null and code_b is not null")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark runs from events: samples are users' tens, variants event types."""
    e = table(spark, sf_dir, "events")
    ok = F.when(F.col("event_id") % 13 == 0, "timeout").when(F.col("event_id") % 17 == 0, "runner_error").otherwise("ok")
    return e.select(F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string")).alias("sample"), F.when(F.col("event_type") == "view", "legacy").otherwise(F.concat(F.lit("practical-"), "event_type")).alias("variant"), ok.alias("status"), F.lit("ok").alias("report_status"), F.col("value").alias("wall_time_sec"), (F.col("event_id") % 1000).cast("double").alias("total_tokens"), (F.col("user_id") % 2).cast("double").alias("goal_recall"))


RUNS = """runs AS (SELECT 's' || (user_id % 5) AS sample, CASE WHEN event_type = 'view' THEN 'legacy' ELSE 'practical-' || event_type END AS variant,
  CASE WHEN event_id % 13 = 0 THEN 'timeout' WHEN event_id % 17 = 0 THEN 'runner_error' ELSE 'ok' END AS status,
  value AS wall, CAST(event_id % 1000 AS DOUBLE) AS tok, CAST(user_id % 2 AS DOUBLE) AS goal FROM events),
summary AS (SELECT sample, variant, count(*) AS runs, count(*) FILTER (status = 'ok') AS successes, count(*) FILTER (status = 'timeout') AS timeouts, count(*) FILTER (status = 'runner_error') AS runner_errors,
  round(avg(wall) FILTER (status = 'ok'), 6) AS wall_mean, round(quantile_cont(wall, 0.5) FILTER (status = 'ok'), 6) AS wall_p50, round(quantile_cont(wall, 0.95) FILTER (status = 'ok'), 6) AS wall_p95, round(max(wall) FILTER (status = 'ok'), 6) AS wall_max,
  round(avg(tok) FILTER (status = 'ok'), 6) AS tok_mean, round(stddev_pop(wall) FILTER (status = 'ok') / avg(wall) FILTER (status = 'ok'), 6) AS wall_cv, round(avg(goal) FILTER (status = 'ok'), 6) AS goal_mean FROM runs GROUP BY 1, 2)"""
