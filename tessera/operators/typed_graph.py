"""The typed graph: edges from references, names and views, and nodes and edges of all kinds together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.status import with_tools

#: Reference types of calls whose target is computed.
COMPUTED = ("COMPUTED_CALL", "19")


def _sources(xrefs: DataFrame, instructions: DataFrame, functions: DataFrame) -> DataFrame:
    """References with the ``entry_va`` of the function they are in, of the same view."""
    src = instructions.select("view_id", F.col("address_va").alias("src_va"), "function_id")
    return xrefs.join(src, ["view_id", "src_va"]).join(functions.select(F.col("id").alias("function_id"), "entry_va"), "function_id")


def data_edges(xrefs: DataFrame, instructions: DataFrame, functions: DataFrame, call_types: tuple[str, ...] = T.CALL_TYPES) -> DataFrame:
    """``entry_va, callee_va``: other functions that a function refers to without calling them, once each; both ends in
    one view."""
    refs = _sources(xrefs.where(~F.col("ref_type_raw").isin(*call_types)), instructions, functions)
    dst = instructions.select("view_id", F.col("address_va").alias("dst_va"), F.col("function_id").alias("to_id"))
    to = functions.select(F.col("id").alias("to_id"), F.col("entry_va").alias("callee_va"))
    return refs.join(dst, ["view_id", "dst_va"]).join(to, "to_id").where("entry_va != callee_va").select("entry_va", "callee_va").distinct()


def indirect_candidates(xrefs: DataFrame, instructions: DataFrame, functions: DataFrame, top: int | None = None) -> DataFrame:
    """``function_id, entry_va, name, n``: computed calls whose target is no known code but has a name; with ``top`` only
    the most frequent of them (for graphs over their budget)."""
    refs = xrefs.where(F.col("ref_type_raw").isin(*COMPUTED) & (F.coalesce("dst_name", F.lit("")) != ""))
    known = instructions.select("view_id", F.col("address_va").alias("dst_va")).distinct()
    unknown = refs.join(known, ["view_id", "dst_va"], "left_anti")
    out = _sources(unknown, instructions, functions).groupBy("function_id", "entry_va", F.col("dst_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return out if top is None else out.orderBy(F.desc("n"), "function_id", "name").limit(top)


def indirect_edges(candidates: DataFrame, index: DataFrame) -> DataFrame:
    """``entry_va, callee_va`` of candidates whose name the index (``name, entry_va``, lower case) knows, self aside."""
    to = index.select(F.col("name").alias("key"), F.col("entry_va").alias("callee_va"))
    named = candidates.select("entry_va", F.lower(F.trim("name")).alias("key"))
    return named.join(to, "key").where("entry_va != callee_va").select("entry_va", "callee_va").distinct()


def indirect_status(xrefs: DataFrame, budget: int, incremental_top: int | None = None) -> DataFrame:
    """One row ``candidates, degraded, top``: whether the computed calls are over the budget, and how many are then taken
    (null for all, 0 for none)."""
    n = xrefs.where(F.col("ref_type_raw").isin(*COMPUTED)).agg(F.count(F.lit(1)).alias("candidates"))
    over = F.col("candidates") > max(1, budget)
    return n.select("candidates", over.alias("degraded"), F.when(over, F.lit(incremental_top or 0)).alias("top"))


def alias_edges(functions: DataFrame, views: DataFrame, tools: DataFrame, one: str = "ghidra", two: str = "ida") -> DataFrame:
    """``source_id, target_id, edge_type, one_id, two_id``: an edge from a function to itself where both tools have one
    at its entry, with the last function of each."""
    f = with_tools(functions, views, tools)
    last = lambda tool, name: f.where(F.col("tool").contains(tool)).groupBy("entry_va").agg(F.max("id").alias(name))
    node = node_id("func", F.col("entry_va"))
    return last(one, "one_id").join(last(two, "two_id"), "entry_va").select(node.alias("source_id"), node.alias("target_id"), F.lit("alias").alias("edge_type"), "one_id", "two_id")


def node_id(kind: str, value: Column) -> Column:
    """Identifier of a node: its kind and, for addresses, the value in hexadecimal."""
    if kind in ("func", "gvar", "str"):
        return F.concat(F.lit(f"{kind}:0x"), F.lower(F.hex(value)))
    return F.concat(F.lit(f"{kind}:"), value.cast("string"))


def typed_graph(nodes: DataFrame, calls: DataFrame, strings: DataFrame | None = None, globals_: DataFrame | None = None, apis: DataFrame | None = None, aliases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (``node_id, node_type, name``) and edges (``source_id, target_id, edge_type``) of all kinds, each once.

    ``nodes`` has ``entry_va, names``; ``calls`` ``entry_va, callee_va``; ``strings`` ``entry_va, address_va, value``;
    ``globals_`` ``entry_va, global_va``; ``apis`` ``entry_va, api``."""
    func = node_id("func", F.col("entry_va"))
    made = [nodes.select(func.alias("node_id"), F.lit("function").alias("node_type"), F.try_element_at("names", F.lit(1)).alias("name"))]
    edges = [calls.select(func.alias("source_id"), node_id("func", F.col("callee_va")).alias("target_id"), F.lit("calls").alias("edge_type"))]
    for df, kind, node_type, edge, key, name in (
        (strings, "str", "string", "refs_string", "address_va", "value"), (globals_, "gvar", "global_var", "accesses_global", "global_va", None), (apis, "api", "api", "calls_api", "api", "api")):
        if df is not None:
            there = node_id(kind, F.col(key))
            made.append(df.select(there.alias("node_id"), F.lit(node_type).alias("node_type"), (F.col(name) if name else there).alias("name")))
            edges.append(df.select(func.alias("source_id"), there.alias("target_id"), F.lit(edge).alias("edge_type")))
    if aliases is not None:
        edges.append(aliases.select("source_id", "target_id", "edge_type"))
    all_nodes, all_edges = made[0], edges[0]
    for df in made[1:]:
        all_nodes = all_nodes.unionByName(df)
    for df in edges[1:]:
        all_edges = all_edges.unionByName(df)
    return all_nodes.groupBy("node_id", "node_type").agg(F.min("name").alias("name")), all_edges.distinct()


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``part, kind, n``: how many nodes and edges there are of each kind."""
    count = lambda df, part, c: df.groupBy(F.col(c).alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "kind", "n")
    return count(nodes, "node", "node_type").unionByName(count(edges, "edge", "edge_type"))


def relations(edges: DataFrame, names: DataFrame, most: int = 8) -> DataFrame:
    """``entry_va, lines``: each node's first ``most`` neighbours by other than calls, as text.  ``edges`` has ``a, b,
    kinds``, ``names`` ``entry_va, name``."""
    from pyspark.sql import Window as W

    other = edges.withColumn("kinds", F.filter("kinds", lambda k: k != "call")).where(F.size("kinds") > 0)
    both = other.select(F.col("a").alias("entry_va"), F.col("b").alias("other_va"), "kinds").unionByName(other.select(F.col("b").alias("entry_va"), F.col("a").alias("other_va"), "kinds"))
    first = both.withColumn("n", F.row_number().over(W.partitionBy("entry_va").orderBy("other_va"))).where(F.col("n") <= most)
    line = F.format_string("0x%X %s [%s]", F.col("other_va"), F.coalesce("name", F.lit("")), F.array_join("kinds", ","))
    j = first.join(names.select(F.col("entry_va").alias("other_va"), "name"), "other_va", "left").select("entry_va", "n", line.alias("line"))
    return j.groupBy("entry_va").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]).alias("lines"))


def evidence_block(parts: DataFrame, limits: dict[str, int]) -> DataFrame:
    """``entry_va, block``: a line for each kind of evidence (array columns named in ``limits``, in that order) with its
    first entries in ascending order; empty kinds are left out."""
    lines = [F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, F.concat(F.lit(f"{c}: "), F.array_join(F.slice(F.array_sort(F.array_distinct(c)), 1, n), ", "))) for c, n in limits.items()]
    return parts.select("entry_va", F.concat_ws("\n", *lines).alias("block"))
