"""Agreement of two views, evidence for proposed profiles, choices between old and new ones, and a
board of facts where the best known value of each kind wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T

# Weights of agreement, of evidence and of profile quality, and ranks of sources.
AGREEMENT = {"pseudo": 0.30, "callees": 0.25, "strings": 0.20, "variables": 0.15, "name": 0.10}
EVIDENCE = {"api": 0.35, "string": 0.25, "relation": 0.20, "graph": 0.10, "existing": 0.10, "symbol_name": 0.20}
INDEPENDENT = ("api", "string", "relation", "graph", "symbol_name")
SOURCES = {"manual": 100, "gen1": 80, "gen2": 60, "breadth": 40, "auto": 20}


def agreement(pairs: DataFrame, code_a: str, code_b: str, name_a: str, name_b: str, weights: dict[str, float] = AGREEMENT) -> DataFrame:
    """``pairs`` with features of agreement between two views' code and their weighted score."""
    a, b = F.col(code_a), F.col(code_b)
    na, nb = F.lower(F.trim(F.coalesce(F.col(name_a), F.lit("")))), F.lower(F.trim(F.coalesce(F.col(name_b), F.lit(""))))
    va, vb = F.size(T.generic_names(a)), F.size(T.generic_names(b))
    out = pairs.withColumns({
        "pseudo_similarity": T.jaccard(T.code_tokens(a), T.code_tokens(b)), "callee_overlap": T.jaccard(T.callees_of(a), T.callees_of(b)), "string_overlap": T.jaccard(T.strings_of(a), T.strings_of(b)),
        "variables_a": va, "variables_b": vb, "name_match": F.when((na == "") | (nb == ""), 0.5).when(na == nb, 1.0).otherwise(0.0)})
    variables = 1.0 - F.abs(F.col("variables_a") - F.col("variables_b")) / F.greatest("variables_a", "variables_b", F.lit(1))
    score = weights["pseudo"] * F.col("pseudo_similarity") + weights["callees"] * F.col("callee_overlap") + weights["strings"] * F.col("string_overlap") + weights["variables"] * variables + weights["name"] * F.col("name_match")
    return out.withColumn("agreement_score", F.round(score, 4))


def evidence(profiles: DataFrame, min_confidence: int = 60) -> DataFrame:
    """``profiles`` with ``overlaps`` (a map of kinds to common words), ``evidence_score``,
    ``signals`` (independent kinds of evidence) and ``quality``.

    Columns: ``name, summary_signature, semantic_summary, structured_analysis, confidence_score``,
    and arrays of words ``api, string, relation, graph, existing`` and of names ``symbols``."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    words = T.name_tokens(F.concat_ws(" ", "name", "summary_signature", "semantic_summary", "structured_analysis"))
    own = T.name_tokens(F.col("name"))
    known = F.exists(F.coalesce("symbols", F.array().cast("array<string>")), lambda s: F.array_join(T.name_tokens(s), " ") == F.array_join(own, " "))
    common = {k: F.array_sort(F.array_intersect(words, F.coalesce(F.col(k), F.array().cast("array<string>")))) for k in ("api", "string", "relation", "graph", "existing")}
    common["symbol_name"] = F.when((F.size(own) > 0) & known, own).otherwise(F.array().cast("array<string>"))
    score = sum(F.when(F.size(common[k]) > 0, w).otherwise(0.0) for k, w in EVIDENCE.items())
    signals = sum(F.when(F.size(common[k]) > 0, 1).otherwise(0) for k in INDEPENDENT)
    quality = (
        F.when((F.trim(blank("name")) != "") & ~T.is_default_name(F.trim(blank("name"))), 0.30).otherwise(0.0) + F.when(F.trim(blank("summary_signature")) != "", 0.25).otherwise(0.0)
        + F.when(F.length(F.trim(blank("semantic_summary"))) >= 24, 0.25).otherwise(0.0) + F.when(F.coalesce("confidence_score", F.lit(0)) >= min_confidence, 0.20).otherwise(0.0))
    return profiles.withColumns({"overlaps": F.create_map(*[x for k, v in common.items() for x in (F.lit(k), v)]), "evidence_score": F.round(score, 4), "signals": signals, "quality": F.round(quality, 4)})


def choose(rows: DataFrame, min_delta: float = 0.05, threshold: float = 0.25, min_signals: int = 1, gated: bool = True) -> DataFrame:
    """``rows`` with ``selected`` (old or new) and ``reasons`` against the new profile.

    Columns: ``choice, old_score, new_score, status, weak_old`` and, if ``gated``, those of
    ``evidence``; the gate opens on enough evidence, or on good quality where the old profile is weak."""
    delta = F.round(F.coalesce("new_score", F.lit(0.0)) - F.coalesce("old_score", F.lit(0.0)), 6)
    checks = [("llm_did_not_choose_new", F.lower(F.trim(F.coalesce("choice", F.lit("old")))) != "new"), ("delta_below_threshold", delta < min_delta)]
    if gated:
        passed = (F.col("evidence_score") >= threshold) & (F.col("signals") >= min_signals)
        weak = F.coalesce("weak_old", F.lit(False)) & (F.col("quality") >= 0.80) & (F.col("signals") >= 1)
        checks += [("new_profile_not_ok", F.lower(F.trim(F.coalesce("status", F.lit("")))) != "ok"), ("static_evidence_gate_failed", ~(passed | weak))]
    reasons = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks]))
    return rows.withColumns({"delta": delta, "reasons": reasons}).withColumn("selected", F.when(F.size("reasons") == 0, "new").otherwise("old"))


def is_weak(name: Column, summary: Column, signature: Column) -> Column:
    """A default or missing name and no text."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return ((blank(name) == "") | T.is_default_name(blank(name))) & (blank(summary) == "") & (blank(signature) == "")


def state_of(library: Column, name: Column, signature: Column) -> Column:
    filled = (F.coalesce(name, F.lit("")) != "") & (F.coalesce(signature, F.lit("")) != "")
    return F.when(F.coalesce(library, F.lit(False)), "LOCKED").when(filled, "ANALYZED").otherwise("PENDING")


def write_back(profiles: DataFrame, min_confidence: int, max_rows: int) -> DataFrame:
    """``profiles`` with ``reason``: null for the rows to apply, the first ``max_rows`` by address."""
    reason = F.when(F.col("selected") != "new", "not_selected").when(F.coalesce("confidence_score", F.lit(0)) < min_confidence, "low_confidence").when(F.col("function_id").isNull(), "no_function")
    rows = profiles.withColumn("reason", reason)
    # the limit is the operator's own bound, so the chosen keys are few
    chosen = rows.where("reason is null").select("entry_va").orderBy("entry_va").limit(max_rows).withColumn("fits", F.lit(True))
    return rows.join(chosen.distinct(), "entry_va", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("fits").isNull(), "over_limit"))).drop("fits")


def source_rank(source: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SOURCES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, source), F.lit(0))


def _strength() -> Column:
    return F.struct(source_rank(F.col("source")).alias("rank"), F.least(F.greatest(F.coalesce("confidence", F.lit(0)), F.lit(0)), F.lit(100)).alias("confidence"), F.col("ts"), F.col("seq"))


def board_winners(entries: DataFrame) -> DataFrame:
    """The winning entry of each ``entry_va, kind``: by source, confidence, time, then order of
    writing (``seq``).  Blank values don't count."""
    rows = entries.where(F.trim(F.coalesce("value", F.lit(""))) != "").withColumn("value", F.trim("value"))
    best = F.max_by(F.struct("value", "confidence", "source", "generation", "goal_index", "ts", "seq"), _strength())
    return rows.groupBy("entry_va", "kind").agg(best.alias("w")).select("entry_va", "kind", "w.*")


def board_conflicts(entries: DataFrame) -> DataFrame:
    """``entry_va, kind, seq, old_value, new_value, winner``: writes whose value differs from the
    value that held until then."""
    rows = entries.where(F.trim(F.coalesce("value", F.lit(""))) != "").withColumn("value", F.trim("value"))
    before = W.partitionBy("entry_va", "kind").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    held = F.max(F.struct(_strength().alias("s"), F.col("value"))).over(before)
    rows = rows.withColumn("held", held).where(F.col("held").isNotNull() & (F.col("held.value") != F.col("value")))
    return rows.select("entry_va", "kind", "seq", F.col("held.value").alias("old_value"), F.col("value").alias("new_value"), F.when(_strength() > F.col("held.s"), F.col("value")).otherwise(F.col("held.value")).alias("winner"))


def board_search(winners: DataFrame, keyword: str) -> DataFrame:
    """Winning entries whose value holds the keyword, best first."""
    return winners.where(F.lower("value").contains(keyword.lower())).orderBy(F.desc(source_rank(F.col("source"))), F.desc("confidence"), "entry_va", "kind")


def board_context(winners: DataFrame, neighbours: DataFrame, limit: int = 20) -> DataFrame:
    """``entry_va, lines``: each node's own entries, then the first ``limit`` of its neighbours
    (``entry_va, neighbour_va``)."""
    line = F.format_string("0x%08X %s: %s", "entry_va", "kind", "value")
    own = winners.select("entry_va", F.lit(0).alias("tier"), F.col("entry_va").alias("of"), "kind", line.alias("line"))
    near = neighbours.select(F.col("entry_va").alias("me"), F.col("neighbour_va").alias("entry_va")).distinct().join(winners, "entry_va")
    place = F.row_number().over(W.partitionBy("me").orderBy(F.desc(source_rank(F.col("source"))), F.desc("confidence"), "entry_va", "kind"))
    near = near.withColumn("place", place).where(F.col("place") <= limit).select(F.col("me").alias("entry_va"), F.lit(1).alias("tier"), F.col("entry_va").alias("of"), "kind", line.alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("tier", "of", "kind", "line"))), lambda x: x["line"])
    return own.unionByName(near).groupBy("entry_va").agg(lines.alias("lines"))


def board_from_profiles(profiles: DataFrame, source: str, generation: int, goal_index: int) -> DataFrame:
    """Entries of profiles' fields: name, signature, summary and tags."""
    fields = F.expr("stack(3, 'func_name', name, 'signature', summary_signature, 'summary', semantic_summary) as (kind, value)")
    rows = profiles.select("entry_va", "confidence_score", fields)
    return rows.where("trim(value) != ''").select("entry_va", "kind", "value", F.col("confidence_score").alias("confidence"), F.lit(source).alias("source"), F.lit(generation).alias("generation"), F.lit(goal_index).alias("goal_index"))


def applied(status: DataFrame, results: DataFrame) -> DataFrame:
    """``status`` after analysts' ``results`` (``function_id, name, signature, summary, confidence,
    is_library``): state, confidence as whole hundredths cut off, and texts."""
    r = results.select(
        "function_id", state_of(F.col("is_library"), F.col("name"), F.col("signature")).alias("analysis_state"), (F.col("confidence") * 100).cast("int").alias("confidence_score"),
        F.col("signature").alias("summary_signature"), F.col("summary").alias("semantic_summary"))
    j = status.alias("a").join(r.alias("b"), "function_id", "left")
    new = r.columns[1:]
    return j.select(*[(F.coalesce(f"b.{c}", f"a.{c}") if c in new else F.col(c) if c == "function_id" else F.col(f"a.{c}")).alias(c) for c in status.columns])


def validated(status: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``status`` after validation (``function_id, action, note``): RENAME and CONFIRM lock, and
    the note is added to the summary once."""
    v = verdicts.where(F.upper("action").isin("RENAME", "CONFIRM")).select("function_id", "note")
    j = status.join(v, "function_id", "left").withColumn("hit", F.col("note").isNotNull())
    summary = F.coalesce("semantic_summary", F.lit(""))
    added = F.when(F.col("hit") & ~summary.contains(F.col("note")), F.btrim(F.concat(summary, F.lit("\n"), F.col("note")), F.lit(" \t\r\n"))).otherwise(F.col("semantic_summary"))
    return j.withColumns({"semantic_summary": added, "analysis_state": F.when(F.col("hit"), "LOCKED").otherwise(F.col("analysis_state"))}).select(*status.columns)


def sequence_names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """``id, name``: wanted names made unique with ``_1, _2, ...`` in order of identifier, after
    the numbers that taken names of the stem already use."""
    used = taken.select(F.regexp_replace("name", r"_\d+$", "").alias("stem"), F.coalesce(F.nullif(F.regexp_extract("name", r"_(\d+)$", 1), F.lit("")).cast("int"), F.lit(0)).alias("n")).groupBy("stem").agg((F.max("n") + 1).alias("next"))
    place = F.row_number().over(W.partitionBy("name").orderBy("id")) - 1
    rows = wanted.withColumn("place", place).join(used, F.col("name") == F.col("stem"), "left")
    number = F.coalesce("next", F.lit(0)) + F.col("place")
    return rows.select("id", F.when(number == 0, F.col("name")).otherwise(F.concat("name", F.lit("_"), number)).alias("name"))


def board_by_kinds(winners: DataFrame, kinds: list[str]) -> DataFrame:
    """Winning entries of the kinds given."""
    return winners.where(F.col("kind").isin(*kinds))


def board_merge(board: DataFrame, saved: DataFrame) -> DataFrame:
    """A board with the entries of a saved one behind its own: where both hold an entry, the usual order decides."""
    return board_winners(board.unionByName(saved, allowMissingColumns=True))


def board_stats(winners: DataFrame, conflicts: DataFrame) -> DataFrame:
    """``part, name, n``: entries, addresses and conflicts of a board, and entries by kind and by source."""
    count = lambda by: winners.groupBy(F.col(by).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(by).alias("part"), "name", "n")
    whole = lambda name, df: df.select(F.lit("total").alias("part"), F.lit(name).alias("name"), "n")
    total = whole("entries", winners.agg(F.count(F.lit(1)).alias("n"))).unionByName(whole("addresses", winners.agg(F.countDistinct("entry_va").alias("n"))))
    return total.unionByName(whole("conflicts", conflicts.agg(F.count(F.lit(1)).alias("n")))).unionByName(count("kind")).unionByName(count("source"))


def board_from_steps(steps: DataFrame, source: str, generation: int, goal_index: int) -> DataFrame:
    """Notes of steps (``title, finding, confidence``) at address 0; steps without a finding give none."""
    note = F.concat_ws(": ", F.nullif(F.trim("title"), F.lit("")), F.trim("finding"))
    return steps.where(F.trim(F.coalesce("finding", F.lit(""))) != "").select(
        F.lit(0).cast("bigint").alias("entry_va"), F.lit("note").alias("kind"), note.alias("value"), F.col("confidence").cast("int").alias("confidence"), F.lit(source).alias("source"), F.lit(generation).alias("generation"), F.lit(goal_index).alias("goal_index"))
