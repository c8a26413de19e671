"""Registered queries of operators that go on until they settle: cycles, quotas, selection, segments, drift and waves."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import lenient_json
from tessera.operators import cycles, drift, graph, quota, segments, selection, usage_trees, waves
from tessera.plans import derive as D
from tessera.plans.registry import query
from tessera.sources import store


def joined(path: str = "path"):
    return F.array_join(F.transform(path, lambda x: x.cast("string")), ">")


# ---- cycles ----------------------------------------------------------------------------------


def chain_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``entry_va, callee_va``: lines of an order call the next line, some the one after it, and some the one before,
    which closes cycles."""
    li = D.table(spark, sf_dir, "lineitem")
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = li.withColumn("v", F.col("l_orderkey") * 16 + F.row_number().over(w))
    rows = rows.select("v", "l_suppkey", F.lead("v", 1).over(w).alias("next"), F.lead("v", 2).over(w).alias("after"), F.lag("v", 1).over(w).alias("before"))
    to = F.array(F.col("next"), F.when(F.col("l_suppkey") % 3 == 1, F.col("after")), F.when(F.col("l_suppkey") % 4 == 0, F.col("before")))
    return rows.select(F.col("v").alias("entry_va"), F.explode(F.filter(to, lambda x: x.isNotNull())).alias("callee_va"))


CHAINS = """ln AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_orderkey * 16 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS v FROM lineitem),
lw AS (SELECT v, l_suppkey, lead(v) OVER w AS n1, lead(v, 2) OVER w AS n2, lag(v) OVER w AS n0 FROM ln WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
e AS (SELECT DISTINCT * FROM (SELECT v AS a, n1 AS b FROM lw UNION ALL SELECT v, n2 FROM lw WHERE l_suppkey % 3 = 1 UNION ALL SELECT v, n0 FROM lw WHERE l_suppkey % 4 = 0) WHERE b IS NOT NULL)"""
COMPONENTS = """reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
nd AS (SELECT a AS v FROM e UNION SELECT b FROM e), mutual AS (SELECT x.a, min(x.b) AS low FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY 1),
cp AS (SELECT v, least(v, coalesce(low, v)) AS c FROM nd LEFT JOIN mutual ON a = v),
ce AS (SELECT DISTINCT x.c AS a, y.c AS b FROM e JOIN cp x ON x.v = e.a JOIN cp y ON y.v = e.b WHERE x.c <> y.c),
dd(c, d) AS (SELECT DISTINCT c, 0 FROM cp UNION SELECT ce.a, d + 1 FROM dd JOIN ce ON ce.b = c), dp AS (SELECT c, max(d) AS d FROM dd GROUP BY 1)"""


@query(f"WITH RECURSIVE {CHAINS}, {COMPONENTS} SELECT v AS entry_va, cp.c AS component, CAST(d AS INTEGER) AS depth FROM cp JOIN dp USING (c)")
def chain_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component and depth of every line of the orders' chains."""
    return cycles.condensed_depth(chain_calls(spark, sf_dir))


@query(f"WITH RECURSIVE {D.ORDER_CALLS}, e AS (SELECT entry_va AS a, callee_va AS b FROM ocalls), {COMPONENTS} SELECT v AS entry_va, cp.c AS component, CAST(d AS INTEGER) AS depth FROM cp JOIN dp USING (c)")
def cyclic_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component and depth of every function of the calls of orders, most of which lie on cycles."""
    return cycles.condensed_depth(D.kept_order_calls(spark, sf_dir))


@query(f"WITH RECURSIVE {D.ORDER_CALLS}, e AS (SELECT entry_va AS a, callee_va AS b FROM ocalls), {COMPONENTS} SELECT 'all' AS starts, CAST(max(d) AS INTEGER) AS depth FROM dp UNION ALL SELECT 'called only', CAST(max(d) AS INTEGER) FROM cp JOIN dp USING (c) WHERE v NOT IN (SELECT a FROM e)")
def deepest_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest of all functions and of the stated starts."""
    calls = D.kept_order_calls(spark, sf_dir)
    depths = cycles.condensed_depth(calls)
    only = cycles.deepest(depths, depths.join(calls, "entry_va", "left_anti"))
    return cycles.deepest(depths).select(F.lit("all").alias("starts"), "depth").unionByName(only.select(F.lit("called only").alias("starts"), "depth"))


# ---- quotas ----------------------------------------------------------------------------------

_NEAR = f"""{D.MIXED}, e AS (SELECT a AS x, b AS y, cost FROM mixed UNION ALL SELECT b, a, cost FROM mixed), d0 AS (SELECT v AS s, v, 0.0 AS d FROM {D.busiest_sql(20)}),
 d1 AS (SELECT s, v, min(d) AS d FROM (SELECT * FROM d0 UNION ALL SELECT s, y, d + cost FROM d0 JOIN e ON x = v WHERE d + cost <= 1.4) GROUP BY 1, 2),
 d2 AS (SELECT s, v, min(d) AS d FROM (SELECT * FROM d1 UNION ALL SELECT s, y, d + cost FROM d1 JOIN e ON x = v WHERE d + cost <= 1.4) GROUP BY 1, 2),
 d3 AS (SELECT s, v, min(d) AS d FROM (SELECT * FROM d2 UNION ALL SELECT s, y, d + cost FROM d2 JOIN e ON x = v WHERE d + cost <= 1.4) GROUP BY 1, 2),
 pl AS (SELECT s, v, CAST(d AS DOUBLE) AS d, row_number() OVER (PARTITION BY s ORDER BY d, v) AS place FROM d3), sh AS (SELECT s, max(CASE WHEN place = 40 THEN d END) AS far FROM pl GROUP BY 1),
 nb AS (SELECT s, place, v, d, coalesce(far + (1.4 - far) * 0.6, 1.4) AS reach FROM pl JOIN sh USING (s) WHERE place <= 50 AND (place <= 40 OR d <= far + (1.4 - far) * 0.6 + 0.000000001))"""


def _neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = D.kept_order_calls(spark, sf_dir)
    e = graph.mixed_edges(calls, D.brand_strings(spark, sf_dir)).select("a", "b", graph.edge_cost(F.col("kinds")).alias("cost"))
    return quota.neighbourhood(e, D.busiest(calls, 20), 1.4, 50)


@query(f"WITH {_NEAR} SELECT s AS start, CAST(place AS INTEGER) AS place, v AS node, round(d, 6) AS dist FROM nb")
def node_budget_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 50 nodes around each of 20 starts in the order of settling, with a radius that shrinks after 40."""
    return _neighbourhood(spark, sf_dir).select("start", "place", "node", F.round("dist", 6).alias("dist"))


@query(f"""WITH {_NEAR} SELECT s AS start, count(*) AS nodes, CAST(1.4 AS DOUBLE) AS radius, round(max(reach), 6) AS effective_radius, max(reach) < 1.4 AS shrunk, min(d) AS min_dist, round(max(d), 6) AS max_dist, round(avg(d), 6) AS mean_dist FROM nb GROUP BY 1""")
def neighbourhood_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the neighbourhood of each start came to."""
    t = quota.neighbourhood_trace(_neighbourhood(spark, sf_dir), 1.4)
    return t.withColumns({c: F.round(c, 6) for c in ("effective_radius", "max_dist")})


@query("""WITH RECURSIVE calls AS (SELECT DISTINCT l_partkey AS entry_va, l_suppkey AS callee_va FROM lineitem WHERE l_partkey <> l_suppkey),
 rk AS (SELECT *, row_number() OVER (PARTITION BY entry_va ORDER BY callee_va) AS rank FROM calls), hs AS (SELECT DISTINCT entry_va AS h FROM calls), st AS (SELECT entry_va AS v FROM calls GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 25),
 r AS (SELECT v AS s, [v] AS path, [] :: BIGINT[] AS key, CAST(NULL AS VARCHAR) AS leaf, 0 AS d FROM st
  UNION ALL SELECT s, CASE WHEN callee_va IS NULL THEN path ELSE list_append(path, callee_va) END AS path, CASE WHEN callee_va IS NULL THEN key ELSE list_append(key, rank) END AS key,
   CASE WHEN leaf IS NOT NULL THEN leaf WHEN callee_va IS NOT NULL THEN NULL WHEN h IS NULL THEN 'no_callee' ELSE 'cycle_cut' END AS leaf, d + 1
  FROM r LEFT JOIN hs ON h = path[-1] LEFT JOIN rk ON leaf IS NULL AND entry_va = path[-1] AND NOT list_contains(path, callee_va) WHERE d < 12
  QUALIFY row_number() OVER (PARTITION BY s ORDER BY CASE WHEN callee_va IS NULL THEN key ELSE list_append(key, rank) END) <= 40)
 SELECT s AS start, CAST(row_number() OVER (PARTITION BY s ORDER BY key) AS INTEGER) AS place, array_to_string(path, '>') AS path, CAST(len(path) - 1 AS INTEGER) AS depth, coalesce(leaf, 'max_depth') AS leaf FROM r WHERE d = 12""")
def first_deep_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 paths of 25 starts to a depth of 12 over all callees."""
    calls = graph.kept(D.part_calls(spark, sf_dir), "calls")
    return quota.first_paths(calls, D.busiest(calls, 25), 12, 40).select("start", "place", joined().alias("path"), "depth", "leaf")


# ---- selection, segments and drift -----------------------------------------------------------


_FRACTIONS = [0.0, 0.25, 0.5, 0.95, 0.999, 1.0]


@query(f"WITH {D.RUNS}, v AS (SELECT sample, variant, 'wall_time_sec' AS name, wall AS v FROM runs UNION ALL SELECT sample, variant, 'total_tokens', tok FROM runs) "
       + " UNION ALL ".join(f"SELECT sample, variant, name, CAST({q} AS DOUBLE) AS fraction, round(quantile_cont(v, {q}), 6) AS value FROM v GROUP BY 1, 2, 3" for q in _FRACTIONS))
def exact_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six percentiles of two numbers of every sample and variant."""
    found = selection.percentiles(D.runs(spark, sf_dir), ["sample", "variant"], ["wall_time_sec", "total_tokens"], _FRACTIONS)
    return found.withColumn("value", F.round("value", 6))


@query("""WITH RECURSIVE i AS (SELECT doc_id, length(text) // 4 AS t, row_number() OVER (ORDER BY doc_id) - 1 AS p, coalesce(sum(length(text) // 4) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents),
 n AS (SELECT a.p, least(a.p + 12, greatest(a.p + 2, coalesce(min(b.p) FILTER (b.before + b.t > a.before + 3000), a.p + 12))) AS e FROM i a JOIN i b ON b.p BETWEEN a.p AND a.p + 11 GROUP BY a.p),
 s(p, batch) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION ALL SELECT n.e, batch + 1 FROM s JOIN n ON n.p = s.p)
 SELECT doc_id, max(batch) AS batch FROM i JOIN s ON s.p <= i.p GROUP BY doc_id""")
def whole_table_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as one group in batches of at most 12 and 3000 tokens, and of two at least."""
    d = D.table(spark, sf_dir, "documents").select(F.lit(1).alias("one"), "doc_id", F.floor(F.length("text") / 4).alias("tokens"))
    return segments.batches(d, "tokens", 3000, 12, "one", ["doc_id"], least=2).select("doc_id", "batch")


def _later(li: DataFrame) -> DataFrame:
    """A later state of line items: some gone, some with another quantity, some new."""
    there = li.where("l_orderkey % 211 != 5").withColumn("l_quantity", F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 307 == 3, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    return there.unionByName(li.where("l_orderkey % 401 = 7").withColumn("l_linenumber", F.col("l_linenumber") + 10))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 211 = 5 THEN 'removed' ELSE 'changed' END AS change FROM lineitem WHERE l_orderkey % 211 = 5 OR (l_orderkey + l_linenumber) % 307 = 3
 GROUP BY ALL UNION ALL SELECT DISTINCT l_orderkey, l_linenumber + 10, 'added' FROM lineitem WHERE l_orderkey % 401 = 7""")
def drifted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items that differ between two states of the table."""
    li = D.table(spark, sf_dir, "lineitem")
    return drift.changed_rows(li, _later(li), ["l_orderkey", "l_linenumber"], li.columns)


@query("""WITH a AS (SELECT 'stored' AS tree, count(*) AS rows FROM lineitem WHERE l_orderkey % 211 != 5 UNION ALL SELECT 'added', count(*) FROM lineitem WHERE l_orderkey % 401 = 7)
 SELECT CAST(sum(rows) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS differing FROM a""")
def kept_up_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums brought up to date from a change alone: their rows, and leaves that differ from sums made anew (none)."""
    li = D.table(spark, sf_dir, "lineitem")
    key, columns = ["l_orderkey", "l_linenumber"], li.columns
    moved = (F.col("l_orderkey") + F.col("l_linenumber")) % 307 == 3
    later = _later(li)
    gone, come = li.where((F.col("l_orderkey") % 211 == 5) | moved), later.where(moved & (F.col("l_linenumber") <= 10) | (F.col("l_linenumber") > 10))
    tree = graph.kept(drift.updated(drift.leaves(li, key, columns), gone, come, key, columns), "leaves")
    apart = drift.differing_leaves(tree, drift.leaves(later, key, columns))
    return tree.agg(F.sum("n").alias("rows")).crossJoin(apart.agg(F.count(F.lit(1)).alias("differing")))


# ---- answers and reports ---------------------------------------------------------------------


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an analyst might answer: JSON alone, with reasoning before it, or amid prose with brackets of its own."""
    c = D.table(spark, sf_dir, "conversations")
    body = F.to_json(F.struct("conv_id", "turn", F.struct("role", F.array(F.col("turn"), F.col("turn") + 1).alias("near")).alias("of")))
    kind = F.col("turn") % 6
    text = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("<think>{\"turn\": 0}</think>\n"), body)).when(kind == 2, F.concat(F.lit("argument [0] of {x} means \"{\n"), body, F.lit("\n} done")))
    text = text.when(kind == 3, F.concat(body, F.lit(" and more: [1, 2"))).when(kind == 4, F.concat(F.lit("[1, 2, [3]] then {\"a\": {"), body, F.lit("}"))).otherwise(F.concat(F.lit("none {here ["), F.col("role")))
    return c.select("conv_id", "turn", text.alias("answer"))


_JSON = "'{\"conv_id\":' || conv_id || ',\"of\":{\"near\":[' || turn || ',' || (turn + 1) || '],\"role\":\"' || role || '\"},\"turn\":' || turn || '}'"


@query(f"""SELECT conv_id, turn, CASE WHEN turn % 6 = 5 THEN NULL ELSE {_JSON} END AS object, CASE WHEN turn % 6 IN (0, 1, 3) THEN '[' || turn || ',' || (turn + 1) || ']' WHEN turn % 6 = 2 THEN '[0]' WHEN turn % 6 = 4 THEN '[1,2,[3]]' END AS array FROM conversations""")
def answers_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The object and the array of every answer."""
    found = lenient_json.json_values(_answers(spark, sf_dir), "answer", "object", "object")
    found = lenient_json.json_values(found, "answer", "array", "array")
    # names in one order, whoever read the text
    named = F.from_json("object", "conv_id long, of struct<near: array<long>, role: string>, turn long")
    return found.select("conv_id", "turn", F.to_json(named).alias("object"), F.when(F.col("array").startswith("["), F.col("array")).otherwise(F.to_json(F.variant_get(F.parse_json("array"), "$.of.near", "array<long>"))).alias("array"))


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each order: steps nest as deep as an order has lines."""
    li = D.table(spark, sf_dir, "lineitem")
    number = lambda c: F.col(c).cast("bigint").cast("string")
    order = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("q"))))
    own = lambda x: F.concat(F.lit('{"usage": {"prompt_tokens": '), x["q"].cast("string"), F.lit(', "completion_tokens": "'), (x["q"] % 7).cast("string"), F.lit('"}, "usage_records": [{"usage": {"prompt_tokens": 1000}}], "next": '))
    shadow = lambda x: F.concat(F.lit('{"token_usage": {"total_tokens": '), x["q"].cast("string"), F.lit('}, "steps": [{"usage": {"prompt_tokens": 500}}], "next": [1, '))
    tree = F.aggregate("ls", F.lit("{}"), lambda acc, x: F.when(x["l_linenumber"] % 3 == 0, F.concat(shadow(x), acc, F.lit("]}"))).when(x["l_linenumber"] % 3 == 1, F.concat(own(x), acc, F.lit("}"))).otherwise(F.concat(F.lit('{"plain": [{"usage": {"other": 1}, "deep": '), acc, F.lit("}]}"))))
    return li.groupBy("l_orderkey").agg(order.alias("ls")).select("l_orderkey", tree.alias("report"), number("l_orderkey").alias("name"))


@query("""SELECT l_orderkey, CAST(sum(CASE WHEN l_linenumber % 3 = 1 THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS DOUBLE) AS prompt_tokens, CAST(sum(CASE WHEN l_linenumber % 3 = 1 THEN CAST(l_quantity AS BIGINT) % 7 ELSE 0 END) AS DOUBLE) AS completion_tokens,
 CAST(sum(CASE WHEN l_linenumber % 3 = 1 THEN CAST(l_quantity AS BIGINT) + CAST(l_quantity AS BIGINT) % 7 WHEN l_linenumber % 3 = 0 THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS DOUBLE) AS total_tokens FROM lineitem WHERE l_linenumber % 3 <> 2 GROUP BY 1""")
def usage_of_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token sums of every order's report, however deep it nests."""
    return usage_trees.usage_sums(_reports(spark, sf_dir), ["l_orderkey"], "report").select("l_orderkey", "prompt_tokens", "completion_tokens", "total_tokens")


@query("""SELECT p_partkey, '{"p_partkey":' || p_partkey || ',"call":{"Api_Key":"<redacted>","part":{"p_name":"' || p_name || '","auth_token":"<redacted>"}},"parts":[{"p_size":' || p_size || ',"my_password":"<redacted>"}],"texts":{"brand":"' || p_brand || '","client_secret":"<redacted>"}}' AS report,
 '{"brand":["' || p_brand || '",{"secret_key":"<redacted>","size":' || p_size || '}],"TOKEN":"<redacted>"}' AS answer FROM part""")
def redacted_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested reports by their schema, and JSON answers by their own shape, without sensitive values."""
    p = D.table(spark, sf_dir, "part")
    call = F.struct(F.col("p_brand").alias("Api_Key"), F.struct("p_name", F.col("p_type").alias("auth_token")).alias("part")).alias("call")
    nested = p.select("p_partkey", call, F.array(F.struct("p_size", F.col("p_name").alias("my_password"))).alias("parts"), F.create_map(F.lit("brand"), "p_brand", F.lit("client_secret"), "p_type").alias("texts"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    clean = usage_trees.redact(nested).select("p_partkey", F.to_json(F.struct("p_partkey", "call", "parts", "texts")).alias("report"), "brand", "size")
    answer = F.concat(F.lit('{"brand": ["'), "brand", F.lit('", {"secret_key": {"a": [1]}, "size": '), F.col("size").cast("string"), F.lit('}], "TOKEN": 7}'))
    return usage_trees.redacted_json(clean.select("p_partkey", "report", answer.alias("answer")), "answer")


# ---- waves and generations -------------------------------------------------------------------


def new_store(spark: SparkSession, name: str) -> store.Store:
    return store.Store(spark, f"{graph.shared_folder(spark)}/{name}-{uuid.uuid4().hex}")


def _analyst(asked: DataFrame) -> DataFrame:
    """A stand-in with a fixed rule; some functions it can't judge."""
    v = F.col("entry_va")
    return asked.where(v % 13 != 1).select("entry_va", F.when(v % 3 == 0, "RENAME").when(v % 3 == 1, "CONFIRM").otherwise("REJECT").alias("action"), F.concat(F.lit("checked "), v.cast("string")).alias("note"), (v * 7 % 100 / 100.0).alias("confidence"))


_WAVES = f"""{D.ORDER_CALLS}, nf AS (SELECT DISTINCT v, v % 4 <> 3 AS waits, v % 11 = 5 AS held, v % 13 <> 1 AS judged, (v * 7 % 100) / 100.0 AS conf FROM (SELECT entry_va AS v FROM ocalls UNION SELECT callee_va FROM ocalls)),
 op AS (SELECT v, waits AND held AS from_locked, CASE WHEN waits AND held THEN 0.9 ELSE conf END AS conf FROM nf WHERE waits AND (held OR (judged AND conf > 0.6))),
 eg AS (SELECT o.v AS a, callee_va AS b, o.conf FROM op o JOIN ocalls ON entry_va = o.v JOIN nf t ON t.v = callee_va WHERE t.waits OR NOT from_locked),
 lv(v, wave) AS (SELECT v, 0 FROM {D.busiest_sql(10)} UNION SELECT b, wave + 1 FROM lv JOIN eg ON a = v WHERE wave < 30),
 fw AS (SELECT v, min(wave) AS wave FROM lv GROUP BY 1)"""


@query(f"""WITH RECURSIVE {_WAVES}, pr AS (SELECT b AS v, y.wave, max(conf) * 100 AS priority FROM fw x JOIN eg ON a = x.v JOIN fw y ON y.v = b AND y.wave = x.wave + 1 GROUP BY 1, 2)
 SELECT fw.wave, fw.v AS entry_va, round(CAST(coalesce(priority, 100.0) AS DOUBLE), 4) AS priority, CASE WHEN NOT waits THEN 'skipped' WHEN held THEN 'locked' WHEN judged THEN 'validated' ELSE 'failed' END AS outcome,
 CASE WHEN waits AND NOT held AND judged THEN CASE fw.v % 3 WHEN 0 THEN 'RENAME' WHEN 1 THEN 'CONFIRM' ELSE 'REJECT' END END AS action
 FROM fw JOIN nf USING (v) LEFT JOIN pr ON pr.v = fw.v AND pr.wave = fw.wave""")
def validation_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation from ten entries on, stopped after its first wave and gone on with."""
    calls = D.kept_order_calls(spark, sf_dir)
    nodes = graph.kept(calls.select("entry_va").union(calls.select("callee_va")).distinct(), "nodes")
    pending, held, entries = nodes.where("entry_va % 4 != 3"), nodes.where("entry_va % 11 = 5"), D.busiest(calls, 10)
    kept = new_store(spark, "waves")
    waves.validate(kept, entries, pending, held, calls, _analyst, most_waves=1)
    met = waves.validate(kept, entries, pending, held, calls, _analyst)
    return met.select("wave", "entry_va", F.round("priority", 4).alias("priority"), "outcome", "action")


@query()
def goal_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve goals in up to three generations each, stopped after the first and gone on with."""
    calls = D.kept_order_calls(spark, sf_dir)
    e = graph.mixed_edges(calls, D.brand_strings(spark, sf_dir)).select("a", "b", graph.edge_cost(F.col("kinds")).alias("cost"))
    p = D.table(spark, sf_dir, "part")
    facts = p.select(F.col("p_partkey").alias("entry_va"), F.array("p_name").alias("names"), F.col("p_size").alias("tokens"), (F.col("p_size") % 9).alias("richness"))
    goals = D.busiest(calls, 12, "callee_va").withColumn("most", (F.col("entry_va") % 3 + 1).cast("int"))
    kept, e = new_store(spark, "generations"), graph.kept(e, "mixed")
    waves.generations(kept, goals, calls, e, facts, most_steps=1)
    return waves.generations(kept, goals, calls, e, facts)
