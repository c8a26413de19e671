"""Whole phases over a program: globals named in committed steps, two views held against each other, and what chosen
functions refer to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import graph, reconcile, segments, unify
from tessera.operators.waves import Analyst, steps_of
from tessera.sources.store import Store, upsert

# What a name may look like, how long it may be, and the confidence of an answer without one.
NAME, LONGEST_NAME, GIVEN_CONFIDENCE = r"\A[A-Za-z_][A-Za-z0-9_]*\z", 255, 0.8
#: Steps of a phase at most: those of a long plan take more batches each.
MOST_STEPS = 32
ANALYSED, FAILED = "ANALYZED", "FAILED"
_BLANKS = " \t\n\r\f\x0b"


def _trimmed(c: str) -> Column:
    return F.btrim(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(_BLANKS))


def _taken(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """What becomes of each global asked about.  An answer whose name can't be one keeps the first of the known names."""
    own = F.coalesce(F.try_element_at(F.array_sort("names"), F.lit(1)), F.format_string("g_%08X", F.col("global_va")))
    fits = _trimmed("name").rlike(NAME) & (F.length(_trimmed("name")) <= LONGEST_NAME)
    confidence = F.coalesce(F.col("confidence").cast("string").try_cast("double"), F.lit(GIVEN_CONFIDENCE))
    got = answers.select("global_va", "name", "type", "reason", "confidence", F.lit(True).alias("answered")).dropDuplicates(["global_va"])
    there = lambda c: F.when(F.col("answered"), c)
    return asked.join(got, "global_va", "left").select(
        "global_va", "batch", "score", there(F.when(fits, _trimmed("name")).otherwise(own)).alias("name"), there(F.nullif(_trimmed("type"), F.lit(""))).alias("guessed_type"),
        there((confidence * 100).cast("int")).alias("confidence_score"), there(_trimmed("reason")).alias("reasoning"), F.when(F.col("answered"), ANALYSED).otherwise(FAILED).alias("outcome"))


def name_globals(store: Store, globals_: DataFrame, scores: DataFrame, told: DataFrame, known: DataFrame, analyst: Analyst, most: int | None = None, batch: int = 10, budget: int = 8000, step: int = 64, most_steps: int | None = None, name: str = "globals") -> DataFrame:
    """``global_va, batch, score, name, guessed_type, confidence_score, reasoning, outcome`` of all globals asked about so far.

    Asked are globals (``global_va, names``) with a score (``global_va, score``) that aren't among the analysed of ``known``
    (``address_va, analysis_state``), highest score first, then by address; all of them or the first ``most``.  They are told about in batches
    of at most ``batch`` globals and ``budget`` tokens of ``told`` (``global_va, context``).  The plan is committed first, then
    ``step`` batches at a time, or a ``MOST_STEPS``-th of the plan if that is more; ``most_steps`` stops after so many steps of this call, and a later call goes on after the last one.

    ``analyst`` takes ``global_va, batch, context`` and gives ``global_va, name, type, reason, confidence`` for those it could judge;
    the others count as failed and are open in the next run (another ``name``).
    """
    if not store.exists(f"{name}_plan"):
        done = known.where(F.col("analysis_state") == ANALYSED).select(F.col("address_va").alias("global_va"))
        waiting = globals_.dropDuplicates(["global_va"]).join(scores.select("global_va", "score"), "global_va").join(done, "global_va", "left_anti")
        if most is not None:
            waiting = waiting.orderBy(F.desc("score"), "global_va").limit(most)
        rows = waiting.join(told.select("global_va", "context"), "global_va", "left").withColumns({"one": F.lit(1), "last": -F.col("score"), "tokens": F.ceil(F.length("context") / 4)})
        planned = segments.batches(graph.kept(rows, "waiting"), "tokens", budget, batch, "one", ["last", "global_va"])
        planned = planned.select("global_va", "names", "score", "context", F.col("batch").cast("long").alias("batch"))
        # in order of batch, so that a step reads the files that hold its batches
        store.replace(f"{name}_plan", planned.repartitionByRange("batch").sortWithinPartitions("batch"))
    plan = store.read(f"{name}_plan")
    batches = (plan.agg(F.max("batch")).first()[0] or 0) + 1
    step = max(step, -(-batches // MOST_STEPS))
    done = 0
    for k in range(-(-batches // step)):
        if store.exists(f"{name}_step_{k:06d}"):
            continue
        if most_steps is not None and done >= most_steps:
            break
        asked = plan.where((F.col("batch") >= k * step) & (F.col("batch") < (k + 1) * step))
        answers = graph.kept(analyst(asked.select("global_va", "batch", "context")), "answers")
        store.replace(f"{name}_step_{k:06d}", _taken(asked, answers))
        done += 1
    met = steps_of(store, f"{name}_step")
    return met if met is not None else _taken(plan.limit(0), plan.limit(0).select("global_va", *[F.lit("").alias(c) for c in ("name", "type", "reason", "confidence")]))


def globals_after(known: DataFrame, met: DataFrame) -> DataFrame:
    """``known`` (``address_va, name, guessed_type, analysis_state, confidence_score, reasoning``) with what was answered."""
    rows = met.where(F.col("outcome") == ANALYSED)
    return upsert(known, rows.select(F.col("global_va").alias("address_va"), "name", "guessed_type", F.col("outcome").alias("analysis_state"), "confidence_score", "reasoning"), ["address_va"])


def _listed(rows: DataFrame, value: str, most: int, name: str) -> DataFrame:
    """``entry_va`` and its first ``most`` values in order; a function's rows are cut down before they are brought together."""
    place = F.row_number().over(W.partitionBy("entry_va").orderBy(value))
    return rows.withColumn("place", place).where(F.col("place") <= most).groupBy("entry_va").agg(F.array_sort(F.collect_list(value)).alias(name))


def hydrated(chosen: DataFrame, xrefs: DataFrame, instructions: DataFrame, functions: DataFrame, strings: DataFrame, most_strings: int = 20, most_external: int = 50, most_internal: int = 200, call_types: tuple[str, ...] = T.CALL_TYPES) -> DataFrame:
    """``entry_va, strings, callees, external``: what the ``chosen`` functions (``entry_va``) refer to, the first of each in order.

    Only references out of the chosen functions' instructions are looked at.  External names that stand for an address or a place in
    code don't count; a function without references has empty lists."""
    wanted = chosen.select("entry_va").distinct()
    of = functions.join(wanted, "entry_va", "left_semi").select(F.col("id").alias("function_id"))
    within = instructions.join(of, "function_id", "left_semi")
    texts = unify.string_refs(xrefs, within, functions, strings).where("value != ''")
    calls = graph.kept(unify.resolve_calls(xrefs, within, functions, call_types), "calls")
    low = F.lower("callee_name")
    outside = calls.where(F.col("callee_va").isNull() & ~low.rlike("^(sub_|loc_|label_)") & ~T.is_bare_hex(low)).select("entry_va", "callee_name").distinct()
    out = wanted.join(_listed(texts, "value", most_strings, "strings"), "entry_va", "left")
    out = out.join(_listed(calls.where("callee_va is not null").select("entry_va", "callee_va").distinct(), "callee_va", most_internal, "callees"), "entry_va", "left")
    out = out.join(_listed(outside, "callee_name", most_external, "external"), "entry_va", "left")
    return out.withColumns({c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("strings", "callees", "external")})


def consensus(functions: DataFrame, code: DataFrame, views: DataFrame, tools: DataFrame, binary_id: int, weights: dict[str, float] = reconcile.AGREEMENT) -> DataFrame:
    """Agreement of both tools' code for every address of a binary that both have: ``entry_va``, names and code of either side
    (``name_a, name_b, code_a, code_b``) and the columns of ``reconcile.agreement``.

    Of several functions or texts of one side the first counts, by view and then by the text's identifier."""
    tool = F.lower("tool")
    sides = views.where(F.col("binary_id") == binary_id).join(tools.select(F.col("id").alias("tool_id"), F.col("name").alias("tool")), "tool_id")
    sides = sides.select(F.col("id").alias("view_id"), F.when(tool.contains("ghidra"), "a").when(tool.contains("ida"), "b").alias("side")).where("side is not null")
    f = functions.select(F.col("id").alias("function_id"), "entry_va", "view_id", F.coalesce("name", F.lit("")).alias("name")).join(F.broadcast(sides), "view_id")  # a row a view
    rows = f.join(code.select("function_id", "code_id", F.coalesce("body", F.lit("")).alias("body")), "function_id")
    order = F.struct("view_id", "code_id")
    first = lambda c, side: F.min_by(F.when(F.col("side") == side, F.col(c)), F.when(F.col("side") == side, order)).alias(f"{'code' if c == 'body' else c}_{side}")
    pairs = rows.groupBy("entry_va").agg(*[first(c, s) for c in ("name", "body") for s in "ab"]).where("name_a is not null and name_b is not null")
    return reconcile.agreement(pairs, "code_a", "code_b", "name_a", "name_b", weights)


def consensus_summary(agreed: DataFrame) -> DataFrame:
    """``functions, mean, high, low``: how many agree well (0.8 and more) and badly (under 0.5)."""
    s = F.col("agreement_score")
    return agreed.agg(F.count(F.lit(1)).alias("functions"), F.round(F.avg(s), 6).alias("mean"), F.count_if(s >= 0.8).alias("high"), F.count_if(s < 0.5).alias("low"))


def nearest_rows(near: DataFrame, most: int = 600) -> DataFrame:
    """The first ``most`` nodes of each start (``start, place, node, dist``) with how many there are and whether some are left out."""
    total = near.groupBy("start").agg(F.count(F.lit(1)).alias("total"))
    return near.where(F.col("place") <= most).join(total, "start").withColumn("truncated", F.col("total") > most)
