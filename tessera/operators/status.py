"""Analysis status: loading, reports, pending sets, statistics and preferred code of functions.

``functions`` have ``id, view_id, entry_va, name``; ``views`` ``id, binary_id, tool_id``; ``tools`` ``id, name``;
``status`` is the table of that name, of which any function may lack a row or a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T

DONE = ("ANALYZED", "LOCKED")
#: Limits of the sizes of a binary: functions and references.
LARGE, VERY_LARGE = (8_000, 300_000), (15_000, 800_000)
# Names that a tool gives to functions it knows nothing of.
DEFAULT_NAME = r"(?i)^(?:sub_|fun_|loc_)[0-9a-f]+$"


def analysis_info(status: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Status rows with their defaults; of ``ids`` (``function_id``) only, where given."""
    rows = status if ids is None else status.join(ids.select("function_id").distinct(), "function_id", "left_semi")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    number = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select(
        "function_id", F.upper(F.coalesce("analysis_state", F.lit("PENDING"))).alias("analysis_state"), number("confidence_score"), text("summary_signature"), text("semantic_summary"),
        number("phase1_pending"), number("phase2_pending"), number("lvar_optimized"), number("annotation_status"))


def with_tools(functions: DataFrame, views: DataFrame, tools: DataFrame) -> DataFrame:
    """``functions`` with the ``tool`` (lower case) and ``binary_id`` of their view; tables of views and tools are small."""
    of = views.select(F.col("id").alias("view_id"), "binary_id", "tool_id").join(tools.select(F.col("id").alias("tool_id"), F.lower("name").alias("tool")), "tool_id")
    return functions.join(of.drop("tool_id"), "view_id")


def analysed_functions(functions: DataFrame, status: DataFrame, views: DataFrame, tools: DataFrame, tool: str = "ida") -> DataFrame:
    """Every function of a tool's views with what is known of it: ``entry_va, original_name, analyzed_name,
    semantic_summary, analysis_state, confidence, annotation_status``."""
    f = with_tools(functions, views, tools).where(F.col("tool") == tool)
    j = f.join(status.withColumnRenamed("function_id", "id"), "id", "left")
    text = lambda c: F.coalesce(c, F.lit(""))
    return j.select(
        "entry_va", text("name").alias("original_name"), text("summary_signature").alias("analyzed_name"), text("semantic_summary").alias("semantic_summary"),
        F.coalesce(F.nullif("analysis_state", F.lit("")), F.lit("PENDING")).alias("analysis_state"), F.coalesce("confidence_score", F.lit(0)).alias("confidence"), F.coalesce("annotation_status", F.lit(0)).alias("annotation_status"))


def report_counts(analysed: DataFrame) -> DataFrame:
    """``total, analyzed, locked, annotated`` and the last three as percentages (null of no functions)."""
    counts = analysed.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("analyzed_name") != "").alias("analyzed"), F.count_if(F.col("analysis_state") == "LOCKED").alias("locked"), F.count_if(F.col("annotation_status") > 0).alias("annotated"))
    return counts.select("*", *[F.round(F.try_divide(F.col(c) * 100.0, F.col("total")), 1).alias(f"{c}_pct") for c in ("analyzed", "locked", "annotated")])


def report_lines(analysed: DataFrame, most: int = 200) -> DataFrame:
    """``entry_va, address, name, new_name, state, summary, annotated`` of each function, long summaries clipped."""
    summary = F.when(F.length("semantic_summary") > most, F.concat(F.substring("semantic_summary", 1, most - 3), F.lit("..."))).otherwise(F.col("semantic_summary"))
    return analysed.select(
        "entry_va", F.format_string("0x%08X", "entry_va").alias("address"), F.col("original_name").alias("name"), F.col("analyzed_name").alias("new_name"),
        F.format_string("%s (%d)", "analysis_state", "confidence").alias("state"), summary.alias("summary"), (F.col("annotation_status") > 0).alias("annotated"))


def renamed_functions(analysed: DataFrame) -> DataFrame:
    """``entry_va, original_name, new_name, confidence`` of functions with another name than before: of a signature the
    last word before its parenthesis, else the first word."""
    name = F.col("analyzed_name")
    head = F.regexp_extract(name, r"^[^(]*", 0)
    new = F.when(name.contains("("), F.regexp_extract(head, r"(\S+)\s*$", 1)).otherwise(F.regexp_extract(name, r"(\S+)", 1))
    return analysed.where((name != "") & (name != F.col("original_name"))).select("entry_va", "original_name", new.alias("new_name"), "confidence")


def tool_view(views: DataFrame, tools: DataFrame, tool: str = "ida") -> DataFrame:
    """``binary_id, view_id``: the lowest view of a tool for each binary, null where it has none."""
    own = views.join(tools.where(F.lower("name") == tool).select(F.col("id").alias("tool_id")), "tool_id").groupBy("binary_id").agg(F.min("id").alias("view_id"))
    return views.select("binary_id").distinct().join(own, "binary_id", "left")


def binary_statistics(views: DataFrame, tools: DataFrame, functions: DataFrame, xrefs: DataFrame, code: DataFrame, tool: str = "ida") -> DataFrame:
    """``binary_id, view_id, functions, xrefs, pseudo_functions, size`` of each binary, within its own view of the tool;
    without one functions are 0 and the others null."""
    out = tool_view(views, tools, tool)
    for name, df in (("functions", functions), ("xrefs", xrefs), ("pseudo_functions", code)):
        out = out.join(df.groupBy("view_id").agg(F.count(F.lit(1)).alias(name)), "view_id", "left")
    there = F.col("view_id").isNotNull()
    counts = [F.when(there, F.coalesce(c, F.lit(0))).alias(c) for c in ("xrefs", "pseudo_functions")]
    out = out.select("binary_id", "view_id", F.coalesce("functions", F.lit(0)).alias("functions"), *counts)
    return out.withColumn("size", size_class(F.col("functions"), F.coalesce("xrefs", F.lit(0))))


def size_class(functions: Column, xrefs: Column, large: tuple[int, int] = LARGE, very_large: tuple[int, int] = VERY_LARGE) -> Column:
    """Which overrides a binary of that size takes: ``very_large``, ``large`` or none (``normal``)."""
    over = lambda limits: (functions > limits[0]) | (xrefs > limits[1])
    return F.when(over(very_large), "very_large").when(over(large), "large").otherwise("normal")


def pending_entries(functions: DataFrame, status: DataFrame, nodes: DataFrame) -> DataFrame:
    """``entry_va`` of nodes analysed but waiting for validation."""
    first, second = F.coalesce("phase1_pending", F.lit(0)), F.coalesce("phase2_pending", F.lit(0))
    waiting = status.where((F.coalesce("analysis_state", F.lit("PENDING")) == "ANALYZED") & ((second == 1) | ((first == 1) & (second == 0))))
    return functions.join(waiting.select(F.col("function_id").alias("id")), "id").select("entry_va").distinct().join(nodes.select("entry_va"), "entry_va", "left_semi")


def validation_entries(functions: DataFrame, status: DataFrame, nodes: DataFrame, least: int = 80) -> DataFrame:
    """``entry_va`` of nodes named like entry points (``main``, ``entry``, ``start``) or surely analysed."""
    named = nodes.where(F.exists("names", lambda n: F.lower(n).rlike("main|entry|start"))).select("entry_va")
    sure = functions.join(status.where(F.col("confidence_score") >= least).select(F.col("function_id").alias("id")), "id").select("entry_va")
    return named.unionByName(sure.join(nodes.select("entry_va"), "entry_va", "left_semi")).distinct()


def node_progress(functions: DataFrame, status: DataFrame, views: DataFrame, tools: DataFrame, tool: str = "ida") -> DataFrame:
    """``entry_va, pending, history, default_name``: whether no view's function is analysed, whether one is or was
    queued, and whether the tool still calls the function by a default name."""
    f = with_tools(functions, views, tools).join(analysis_info(status).withColumnRenamed("function_id", "id"), "id", "left")
    done = F.coalesce(F.col("analysis_state").isin(*DONE), F.lit(False))
    default = (F.col("tool") == tool) & F.coalesce(F.col("name").rlike(DEFAULT_NAME), F.lit(False))
    return f.groupBy("entry_va").agg((~F.bool_or(done)).alias("pending"), F.bool_or(done | (F.coalesce("phase1_pending", F.lit(0)) != 0)).alias("history"), F.bool_or(default).alias("default_name"))


def preferred_code(functions: DataFrame, code: DataFrame, views: DataFrame, tools: DataFrame, order: tuple[str, ...] = ("ida", "ghidra")) -> DataFrame:
    """``entry_va, tool, function_id, code``: prototype and body of each entry, by the first tool of ``order``, then of any
    other by name, that has a body; of a function's several bodies the longest, then the first."""
    rows = code.select(F.col("function_id").alias("id"), F.coalesce("prototype", F.lit("")).alias("prototype"), F.coalesce("body", F.lit("")).alias("body"), F.col("code_id")).where(F.trim("body") != "")
    longest = rows.groupBy("id").agg(F.min_by(F.struct("prototype", "body"), F.struct(-F.length("body"), "code_id")).alias("c"))
    rank = F.coalesce(*[F.when(F.col("tool") == t, i) for i, t in enumerate(order)], F.lit(len(order)))
    f = with_tools(functions, views, tools).select("id", "entry_va", "tool").join(longest, "id")
    best = f.groupBy("entry_va").agg(F.min_by(F.struct("tool", "id", "c"), F.struct(rank, "tool", "id")).alias("b"))
    return best.select("entry_va", "b.tool", F.col("b.id").alias("function_id"), F.trim(F.concat("b.c.prototype", F.lit("\n"), "b.c.body")).alias("code"))


def best_summary(functions: DataFrame, status: DataFrame, least: int = 0) -> DataFrame:
    """``entry_va, summary, confidence``: of each entry the surest status of at least ``least`` that has a summary."""
    info = analysis_info(status).where((F.col("semantic_summary") != "") & (F.col("confidence_score") >= least))
    j = functions.select("id", "entry_va").join(info.withColumnRenamed("function_id", "id"), "id")
    best = j.groupBy("entry_va").agg(F.max_by(F.struct("semantic_summary", "confidence_score"), F.struct("confidence_score", (-F.col("id")).alias("n"))).alias("b"))
    return best.select("entry_va", F.col("b.semantic_summary").alias("summary"), F.col("b.confidence_score").alias("confidence"))


def backup_profile(functions: DataFrame, status: DataFrame, views: DataFrame, tools: DataFrame, tool: str = "ida") -> DataFrame:
    """``entry_va, function_id, analysis_state, confidence, signature, summary``: the status of the preferred tool's
    function at each entry, of another tool's where that has none."""
    j = with_tools(functions, views, tools).join(analysis_info(status).withColumnRenamed("function_id", "id"), "id")
    best = j.groupBy("entry_va").agg(F.min_by(F.struct("id", "analysis_state", "confidence_score", "summary_signature", "semantic_summary"), F.struct(F.col("tool") != tool, "id")).alias("b"))
    return best.select("entry_va", F.col("b.id").alias("function_id"), "b.analysis_state", F.col("b.confidence_score").alias("confidence"), F.col("b.summary_signature").alias("signature"), F.col("b.semantic_summary").alias("summary"))


def registered(table: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``table`` (``id`` and ``key``) plus the values of ``wanted`` that it lacks, numbered on in order of the value.
    For small tables of tools, binaries and views: the new rows are numbered in one task."""
    new = wanted.select(key).where(F.col(key).isNotNull()).distinct().join(table.select(key), key, "left_anti")
    last = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))  # one row
    numbered = new.withColumn("n", F.row_number().over(W.orderBy(key))).crossJoin(F.broadcast(last)).select((F.col("last") + F.col("n")).alias("id"), key)
    return table.unionByName(numbered, allowMissingColumns=True)


def logical_name(folder: Column) -> Column:
    """A view folder's name without its tool's suffix, which both views of a binary share."""
    return F.regexp_replace(F.regexp_extract(folder, r"([^/\\\\]+)[/\\\\]*$", 1), r"(?i)[_\-.](?:ghidra|ida)(?:_(?:out|output|export))?$", "")


def snippets(lines: DataFrame, hits: DataFrame, by: list[str], around: int = 1, most: int = 3) -> DataFrame:
    """``<by>, line_no, snippet``: the first ``most`` hits (``<by>, line_no``) of each ``by`` with the lines ``around`` them.
    ``lines`` has ``entry_va, line_no, line``; ``by`` holds ``entry_va``."""
    first = hits.select(*by, "line_no").distinct().withColumn("n", F.row_number().over(W.partitionBy(*by).orderBy("line_no"))).where(F.col("n") <= most)
    near = first.withColumn("at", F.explode(F.sequence(F.col("line_no") - around, F.col("line_no") + around)))
    j = near.join(lines.select("entry_va", F.col("line_no").alias("at"), "line"), ["entry_va", "at"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    return j.groupBy(*by, "line_no").agg(text.alias("snippet"))


def listing_addresses(lines: DataFrame) -> DataFrame:
    """``entry_va, line_no, ea`` of listing lines that begin with an address."""
    raw = F.regexp_extract("line", r"^\s*(?:0x)?([0-9A-Fa-f]{4,16})\b", 1)
    return lines.select("entry_va", "line_no", T.parse_hex(F.lower(F.nullif(raw, F.lit("")))).alias("ea")).where("ea is not null")


def parameters_digest(parameters: DataFrame, columns: list[str]) -> DataFrame:
    """``parameters`` with ``signature``: SHA-256 of the columns as JSON in order of name, nulls left out."""
    return parameters.withColumn("signature", F.sha2(F.to_json(F.struct(*sorted(columns))), 256))
