"""Registered queries of whole phases: globals named, views agreed, references of functions and nearest nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import phases
from tessera.plans import deeper, details, queries
from tessera.plans import derive as D
from tessera.plans.registry import QUERIES, query

# ---- globals ---------------------------------------------------------------------------------


def _analyst(asked: DataFrame) -> DataFrame:
    """A stand-in with a fixed rule: some globals it can't judge, some of its names can't be one."""
    v, text = F.col("global_va"), F.col("global_va").cast("string")
    name = F.when(v % 5 == 1, F.concat(F.lit("9 "), text)).otherwise(F.concat(F.lit(" Named_"), text, F.lit("\n")))
    confidence = F.when(v % 4 == 0, "high").when(v % 4 == 1, None).otherwise(F.concat(F.lit("0."), (v % 9 + 1).cast("string")))
    return asked.where(v % 5 != 0).select("global_va", name.alias("name"), F.when(v % 3 == 0, " ").otherwise("int *").alias("type"), F.concat(F.lit("batch "), F.col("batch").cast("string")).alias("reason"), confidence.alias("confidence"))


@query(f"""WITH RECURSIVE gc AS ({QUERIES["global_contexts"][1]}), sc AS ({QUERIES["global_rw_score"][1]}),
 i AS (SELECT global_va, score, CAST(ceil(length(context) / 4.0) AS BIGINT) AS t, row_number() OVER (ORDER BY score DESC, global_va) - 1 AS p FROM gc JOIN sc USING (global_va) WHERE global_va % 7 <> 3),
 j AS (SELECT *, coalesce(sum(t) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM i),
 n AS (SELECT a.p, least(a.p + 6, greatest(a.p + 1, coalesce(min(b.p) FILTER (b.before + b.t > a.before + 700), a.p + 6))) AS e FROM j a JOIN j b ON b.p BETWEEN a.p AND a.p + 5 GROUP BY a.p),
 s(p, batch) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION ALL SELECT n.e, batch + 1 FROM s JOIN n ON n.p = s.p),
 b AS (SELECT global_va AS v, max(batch) AS batch FROM i JOIN s ON s.p <= i.p GROUP BY 1)
 SELECT v AS address_va, CASE WHEN v % 5 = 1 THEN 'fn_' || v ELSE 'Named_' || v END AS name, CASE WHEN v % 3 <> 0 THEN 'int *' END AS guessed_type, 'ANALYZED' AS analysis_state,
  CAST(CASE WHEN v % 4 < 2 THEN 80 ELSE trunc((v % 9 + 1) / 10.0 :: DOUBLE * 100) END AS INTEGER) AS confidence_score, 'batch ' || batch AS reasoning FROM b WHERE v % 5 <> 0
 UNION ALL SELECT s_suppkey, 'kept_' || s_suppkey, NULL, CASE WHEN s_suppkey % 7 = 3 THEN 'ANALYZED' ELSE 'PENDING' END, 50, 'before' FROM supplier
 WHERE s_suppkey % 7 IN (3, 4) AND (s_suppkey % 7 = 3 OR s_suppkey % 5 = 0 OR s_suppkey NOT IN (SELECT v FROM b))""")
def globals_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Globals after their phase, which was stopped after its first step and gone on with; some were analysed before."""
    s = D.table(spark, sf_dir, "supplier")
    k, text = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    known = s.where("s_suppkey % 7 in (3, 4)").select(k.alias("address_va"), F.concat(F.lit("kept_"), text).alias("name"), F.lit(None).cast("string").alias("guessed_type"), F.when(k % 7 == 3, "ANALYZED").otherwise("PENDING").alias("analysis_state"), F.lit(50).alias("confidence_score"), F.lit("before").alias("reasoning"))
    globals_ = s.select(k.alias("global_va"), F.array(F.concat(F.lit("g_"), text), F.concat(F.lit("fn_"), text)).alias("names"))
    kept = deeper.new_store(spark, "globals")
    for steps in (1, None):
        met = phases.name_globals(kept, globals_, queries.global_rw_score(spark, sf_dir), details.global_contexts(spark, sf_dir), known, _analyst, batch=6, budget=700, step=100, most_steps=steps)
    return phases.globals_after(known, met)


# ---- two views -------------------------------------------------------------------------------

_SETS = {
    "tk": queries._TOKENS,
    "cl": "list_filter(list_distinct(regexp_extract_all({}, '\\b([A-Za-z_][A-Za-z0-9_]*)\\s*\\(', 1)), lambda x: x NOT IN ('if', 'for', 'while', 'switch', 'return', 'sizeof', 'else'))",
    "st": "list_distinct(regexp_extract_all({}, '\"([^\"]*)\"', 1))",
}


def _shared(name: str) -> str:
    x, y = f"{name}_a", f"{name}_b"
    return f"CASE WHEN len({x}) + len({y}) = 0 THEN 1.0 ELSE CAST(len(list_intersect({x}, {y})) AS DOUBLE) / len(list_distinct(list_concat({x}, {y}))) END"


_AGREED = f"""{D.FUNCTIONS}, {D.CODE}, sd AS (SELECT entry_va, f.view_id AS side, arg_min(coalesce(name, ''), code_id) AS n, arg_min(coalesce(body, ''), code_id) AS c FROM code JOIN f ON f.id = function_id GROUP BY 1, 2),
 pr AS (SELECT entry_va, x.n AS na, y.n AS nb, {", ".join(f"{sql.format(f'{s}.c')} AS {k}_{'a' if s == 'x' else 'b'}" for k, sql in _SETS.items() for s in "xy")}, len({queries._names_sql("x.c")}) AS va, len({queries._names_sql("y.c")}) AS vb
  FROM sd x JOIN sd y USING (entry_va) WHERE x.side = 1 AND y.side = 2),
 ag AS (SELECT entry_va, {_shared("tk")} AS pseudo, {_shared("cl")} AS callees, {_shared("st")} AS strings, CAST(va AS INTEGER) AS va, CAST(vb AS INTEGER) AS vb, CASE WHEN trim(na) = '' OR trim(nb) = '' THEN 0.5 WHEN lower(trim(na)) = lower(trim(nb)) THEN 1.0 ELSE 0.0 END AS name FROM pr),
 sc AS (SELECT *, round(0.30 :: DOUBLE * pseudo + 0.25 :: DOUBLE * callees + 0.20 :: DOUBLE * strings + 0.15 :: DOUBLE * (1.0 :: DOUBLE - abs(va - vb) / greatest(va, vb, 1) :: DOUBLE) + 0.10 :: DOUBLE * name, 4) AS score FROM ag)"""


def _agreed(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = D.program(spark, sf_dir)
    return phases.consensus(g["functions"], g["code"], g["views"], g["tools"], 1)


@query(f"WITH {_AGREED} SELECT entry_va, round(score, 3) AS score, round(pseudo, 6) AS pseudo, round(callees, 6) AS callees, round(strings, 6) AS strings, va AS variables_a, vb AS variables_b FROM sc")
def view_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well both tools' code of every function agrees."""
    r = lambda c, to, n=6: F.round(c, n).alias(to)
    return _agreed(spark, sf_dir).select("entry_va", r("agreement_score", "score", 3), r("pseudo_similarity", "pseudo"), r("callee_overlap", "callees"), r("string_overlap", "strings"), "variables_a", "variables_b")


@query(f"WITH {_AGREED} SELECT count(*) AS functions, round(avg(score), 4) AS mean, count(*) FILTER (score >= 0.8) AS high, count(*) FILTER (score < 0.5) AS low FROM sc")
def consensus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many functions agree well and badly over all."""
    return phases.consensus_summary(_agreed(spark, sf_dir)).withColumn("mean", F.round("mean", 4))


# ---- references and nearest nodes ------------------------------------------------------------


@query(f"""WITH k AS ({QUERIES["resolved_calls"][1]}), s AS (SELECT DISTINCT l_partkey * 16 AS v, s_name AS x FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_linenumber % 3 <> 0 AND s_suppkey % 2 = 0),
 st AS (SELECT v, string_agg(x, ',' ORDER BY x) AS a FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY x) AS p FROM s) WHERE p <= 4 GROUP BY 1),
 ca AS (SELECT v, string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) AS a FROM (SELECT v, x, row_number() OVER (PARTITION BY v ORDER BY x) AS p FROM (SELECT DISTINCT entry_va AS v, callee_va AS x FROM k WHERE callee_va IS NOT NULL)) WHERE p <= 3 GROUP BY 1),
 ex AS (SELECT v, string_agg(x, ',' ORDER BY x) AS a FROM (SELECT v, x, row_number() OVER (PARTITION BY v ORDER BY x) AS p FROM (SELECT DISTINCT entry_va AS v, callee_name AS x FROM k WHERE callee_va IS NULL)) WHERE p <= 2 GROUP BY 1)
 SELECT p_partkey * 16 AS entry_va, coalesce(st.a, '') AS strings, coalesce(ca.a, '') AS callees, coalesce(ex.a, '') AS external FROM part LEFT JOIN st ON st.v = p_partkey * 16 LEFT JOIN ca ON ca.v = p_partkey * 16 LEFT JOIN ex ON ex.v = p_partkey * 16""")
def references_of_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First strings, callees and external names of every function."""
    r = D.refs(spark, sf_dir)
    found = phases.hydrated(r["functions"], D.computed_refs(spark, sf_dir), r["instructions"], r["functions"], r["strings"], 4, 2, 3, ("COMPUTED_CALL", "19"))
    return found.select("entry_va", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("strings", "callees", "external")])


@query(f"WITH {deeper._NEAR}, n AS (SELECT *, count(*) OVER (PARTITION BY s) AS total FROM nb) SELECT s AS start, CAST(place AS INTEGER) AS place, v AS node, round(d, 6) AS dist, total, total > 30 AS truncated FROM n WHERE place <= 30")
def nearest_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 30 nodes around each start, and whether there are more."""
    return phases.nearest_rows(deeper._neighbourhood(spark, sf_dir), 30).select("start", "place", "node", F.round("dist", 6).alias("dist"), "total", "truncated")
