"""What an analyst is told about a function or a global: facts gathered by joins, then laid out as text.

All functions of a table are done at once.  What is kept of callers, callees and users is decided by a rank that
Spark cuts down in each task before it brings a function's rows together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import annotate, graph


def _first(rows: DataFrame, by: str, most: int, *order: Column | str) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("place") <= most)


def _titled(name: Column, va: Column) -> Column:
    return F.concat(F.coalesce(name, T.default_name(va)), F.lit(" @ "), T.format_address(va))


def _section(title: str, lines: Column, none: str) -> Column:
    return F.concat(F.lit(f"[{title}]\n"), F.when(F.size(F.coalesce(lines, F.array())) > 0, F.array_join(lines, "\n")).otherwise(none))


def usage_snippets(code: DataFrame, uses: DataFrame, around: int = 1) -> DataFrame:
    """``caller_va, callee_va, snippet``: the first line of a caller's code that names what it uses, with the lines around it.
    ``uses`` has ``caller_va, callee_va, callee_name``; a name that isn't there gives no row."""
    sites = graph.call_sites(code, uses, 1).select(F.col("caller_va").alias("entry_va"), "callee_va", (F.col("call_line") + 1).alias("line_no"))
    # lines stay with their function: a site takes its own out of the cut text, so not every line is shuffled for it
    cut = code.groupBy("entry_va").agg(F.collect_list(F.split("body", annotate.LINE_END)).alias("texts"))
    low, high = F.greatest(F.col("line_no") - around, F.lit(1)), F.col("line_no") + around
    numbered = F.transform("texts", lambda t: F.transform(F.slice(t, low, high - low + 1), lambda x, i: F.struct((low + i).alias("at"), x.alias("line"))))
    snippet = F.array_join(F.transform(F.array_sort(F.flatten(numbered)), lambda x: x["line"]), "\n")
    return sites.join(cut, "entry_va").select(F.col("entry_va").alias("caller_va"), "callee_va", snippet.alias("snippet"))


def validation_context(nodes: DataFrame, info: DataFrame, code: DataFrame, calls: DataFrame, callers: int = 5, callees: int = 8) -> DataFrame:
    """``entry_va, callers, callees, context`` for every node: its result so far, how its first callers (by address, of those
    whose code shows the call) use it, and its first callees.

    ``nodes`` has ``entry_va, name``, ``info`` ``entry_va, signature, summary``, ``code`` ``entry_va, body``, ``calls``
    ``entry_va, callee_va``.  A node without a name has its default one."""
    named = nodes.select("entry_va", F.coalesce("name", T.default_name(F.col("entry_va"))).alias("name"))
    pairs = calls.select(F.col("entry_va").alias("caller_va"), "callee_va").where("caller_va != callee_va").distinct()
    pairs = pairs.join(named.select(F.col("entry_va").alias("callee_va"), F.col("name").alias("callee_name")), "callee_va")
    seen = usage_snippets(code, pairs).join(named.select(F.col("entry_va").alias("caller_va"), F.col("name").alias("caller")), "caller_va", "left")
    seen = _first(seen, "callee_va", callers, "caller_va")
    line = F.concat(F.lit("- "), _titled(F.col("caller"), F.col("caller_va")), F.lit("\n"), F.col("snippet"))
    of_callers = seen.groupBy(F.col("callee_va").alias("entry_va")).agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("users"))
    below = _first(pairs, "caller_va", callees, "callee_va")
    line = F.concat(F.lit("- "), _titled(F.col("callee_name"), F.col("callee_va")))
    of_callees = below.groupBy(F.col("caller_va").alias("entry_va")).agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("used"))
    j = named.join(info.select("entry_va", "signature", "summary"), "entry_va", "left").join(of_callers, "entry_va", "left").join(of_callees, "entry_va", "left")
    lines = lambda c: F.transform(c, lambda x: x["line"])
    blank = lambda c: F.coalesce(c, F.lit(""))
    text = F.concat_ws("\n\n", _titled(F.col("name"), F.col("entry_va")), F.concat(F.lit("[Result]\nSignature: "), blank("signature"), F.lit("\nSummary: "), blank("summary")), _section("Callers", lines("users"), "none seen"), _section("Callees", lines("used"), "none"))
    count = lambda c: F.size(F.coalesce(c, F.array()))
    return j.select("entry_va", count("users").alias("callers"), count("used").alias("callees"), text.alias("context"))


def global_context(globals_: DataFrame, uses: DataFrame, nodes: DataFrame, confidence: DataFrame, code: DataFrame, most: int = 6) -> DataFrame:
    """``global_va, users, context`` for every global: its names and how its surest users read and write it.

    ``globals_`` has ``global_va, names``, ``uses`` ``global_va, entry_va``, ``confidence`` ``entry_va, confidence`` (hundredths).
    Users without confidence, or whose code doesn't name the global, don't count; ties go by address."""
    by_name = globals_.select(F.col("global_va").alias("callee_va"), F.explode("names").alias("callee_name"))
    pairs = uses.select(F.col("entry_va").alias("caller_va"), F.col("global_va").alias("callee_va")).distinct().join(by_name, "callee_va")
    sure = confidence.where("confidence > 0").groupBy(F.col("entry_va").alias("caller_va")).agg(F.max("confidence").alias("confidence"))
    seen = usage_snippets(code, pairs.join(sure, "caller_va", "left_semi")).join(sure, "caller_va")
    seen = seen.join(nodes.select(F.col("entry_va").alias("caller_va"), "name"), "caller_va", "left")
    seen = _first(seen, "callee_va", most, F.desc("confidence"), "caller_va")
    line = F.concat(F.lit("- "), _titled(F.col("name"), F.col("caller_va")), F.format_string(" (%.2f)\n", (F.col("confidence") / 100).cast("double")), F.col("snippet"))
    users = seen.groupBy(F.col("callee_va").alias("global_va")).agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("users"))
    j = globals_.join(users, "global_va", "left")
    names = F.when(F.size("names") > 0, F.array_join(F.array_sort("names"), ", ")).otherwise(F.concat(F.lit("byte_"), F.lpad(F.hex("global_va"), 8, "0")))
    text = F.concat_ws("\n\n", F.concat(T.format_address(F.col("global_va")), F.lit(" "), names), _section("Users", F.transform("users", lambda x: x["line"]), "none seen"))
    return j.select("global_va", F.size(F.coalesce("users", F.array())).alias("users"), text.alias("context"))


def address_sections(addresses: DataFrame, first: int, last: int) -> DataFrame:
    """``entry_va, section``: which address each line from ``first`` to ``last`` stands for (``entry_va, line_no, ea``);
    lines without an address above 0 are left out, and texts without any such line."""
    rows = addresses.where((F.col("line_no") >= first) & (F.col("line_no") <= last) & (F.col("ea") > 0)).groupBy("entry_va", "line_no").agg(F.min("ea").alias("ea"))
    line = F.concat(F.when(F.col("line_no") < 1000, F.lpad(F.col("line_no").cast("string"), 3, "0")).otherwise(F.col("line_no").cast("string")), F.lit(" -> 0x"), F.hex("ea"))
    return rows.groupBy("entry_va").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", line.alias("line")))), lambda x: x["line"]), "\n").alias("section"))


def local_names_applied(code: DataFrame, status: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Code and status after new names of local variables, and ``function_id, changed, renamed, remaining`` of each result.

    ``code`` has ``function_id, body``, ``results`` ``function_id, renames`` (a map).  Only identifiers that differ from what they replace
    count; every function with a result is marked as looked at, changed or not; ``remaining`` are default names still in its code."""
    clean = results.select("function_id", F.coalesce(T.clean_renames(F.col("renames")), F.create_map().cast("map<string,string>")).alias("renames"))
    j = code.join(clean, "function_id", "left")
    has = F.coalesce(F.size("renames"), F.lit(0)) > 0
    new = j.withColumn("body", F.when(has, T.rename_identifiers(F.col("body"), F.col("renames"))).otherwise(F.col("body")))
    remaining = new.where("renames is not null").select("function_id", has.alias("changed"), F.size("renames").alias("renamed"), T.generic_names(F.col("body")).alias("remaining"))
    seen = clean.select("function_id").distinct().withColumn("seen", F.lit(1))
    marked = status.join(seen, "function_id", "left").withColumn("lvar_optimized", F.coalesce("seen", "lvar_optimized").cast(status.schema["lvar_optimized"].dataType)).select(*status.columns)
    return new.select(*code.columns), marked, remaining


def reusable(reports: DataFrame) -> DataFrame:
    """Reports of strict alignment that a later run may take over: those that ended in an aligned state."""
    return reports.where(F.coalesce("status", F.lit("")).isin("aligned", "replaced"))


def picked_binary(binaries: DataFrame, wanted: int | None = None) -> int:
    """The binary that is asked for, else the only one there is; more than one, or none, is an error."""
    if wanted is not None:
        return wanted
    ids = [r["id"] for r in binaries.select("id").distinct().orderBy("id").limit(11).collect()]
    if len(ids) != 1:
        raise ValueError(f"name one binary of {ids}" if ids else "there are no binaries")
    return ids[0]
