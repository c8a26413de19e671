"""Long analyses in committed steps: validation in waves over the call graph, and goals in dependent generations.

Every step is a table of the store, pointed to only when it is whole.  A run goes on after the last such step, so one that was
stopped between steps, or within one, gives what an undisturbed one gives.  A step writes what it adds; what holds
now is read from all steps together.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import graph, quota, reconcile
from tessera.sources.store import Store

Analyst = Callable[[DataFrame], DataFrame]
#: Outcome of a function in a wave; functions outside the pending ones are met and left alone.
VALIDATED, LOCKED, FAILED, SKIPPED = "validated", "locked", "failed", "skipped"
#: Confidence that a locked function passes on, and priority of the entries.
LOCKED_CONFIDENCE, FIRST_PRIORITY = 0.9, 100.0


def _steps(store: Store, name: str) -> list[str]:
    """Committed steps in order."""
    return sorted(t for t in store.tables() if t.startswith(f"{name}_") and store.exists(t))


def steps_of(store: Store, name: str) -> DataFrame | None:
    """All committed steps as one table, none if there is none yet."""
    out = None
    for step in _steps(store, name):
        df = store.read(step)
        out = df if out is None else out.unionByName(df)
    return out


def _judged(front: DataFrame, pending: DataFrame, locked: DataFrame, analyst: Analyst) -> DataFrame:
    """``front`` (``entry_va, priority``) with what becomes of each function."""
    # a wave is small: what is told of its functions is looked up before the join, so the whole tables aren't shuffled for it
    of = lambda df: df.join(front.select("entry_va"), "entry_va", "left_semi")
    marked = front.join(of(pending).select("entry_va", F.lit(True).alias("waits")), "entry_va", "left").join(of(locked).select("entry_va", F.lit(True).alias("is_locked")), "entry_va", "left")
    asked = graph.kept(marked.where("waits and is_locked is null").select("entry_va", "priority"), "asked")
    answers = graph.kept(analyst(asked).select("entry_va", "action", "note", F.col("confidence").cast("double").alias("confidence")), "answers")
    marked = marked.join(answers.dropDuplicates(["entry_va"]), "entry_va", "left")
    outcome = F.when(F.col("waits").isNull(), SKIPPED).when(F.col("is_locked"), LOCKED).when(F.col("confidence").isNull(), FAILED).otherwise(VALIDATED)
    rows = marked.withColumn("outcome", outcome)
    return rows.select("entry_va", "priority", "outcome", "action", "note", F.when(F.col("outcome") == LOCKED, LOCKED_CONFIDENCE).when(F.col("outcome") == VALIDATED, F.col("confidence")).alias("confidence"))


def validate(store: Store, entries: DataFrame, pending: DataFrame, locked: DataFrame, calls: DataFrame, analyst: Analyst, least: float = 0.6, most_waves: int | None = None, name: str = "wave") -> DataFrame:
    """``wave, entry_va, priority, outcome, action, note, confidence`` of every function that was met.

    Wave 0 are the entries.  A function validated with a confidence over ``least`` passes it on to its callees, a locked one
    ``LOCKED_CONFIDENCE`` to those of its callees that are pending; a callee that wasn't met before joins the next wave with
    100 times the highest confidence passed to it.  After the last wave those that failed are asked once more (wave -1),
    which passes nothing on.  ``most_waves`` stops after so many waves in this call; a later call goes on.

    ``analyst`` takes ``entry_va, priority`` and gives ``entry_va, action, note, confidence`` for those that it could judge.
    """
    # kept, as every wave reads them
    edges = graph.kept(calls.select("entry_va", "callee_va").where("entry_va != callee_va").distinct(), "edges")
    waiting = graph.kept(pending.select("entry_va").distinct(), "waiting")
    held = graph.kept(locked.select("entry_va").distinct(), "held")
    done = 0
    while f"{name}_retry" not in _steps(store, name):
        waves = [s for s in _steps(store, name)]
        if not waves:
            front = entries.select("entry_va").where("entry_va is not null").distinct().withColumn("priority", F.lit(FIRST_PRIORITY))
        else:
            met, last = steps_of(store, name), store.read(waves[-1])
            open_ = last.where((F.col("outcome") == LOCKED) | ((F.col("outcome") == VALIDATED) & (F.col("confidence") > least)))
            told = open_.join(edges, "entry_va").select(F.col("callee_va").alias("to"), "confidence", (F.col("outcome") == LOCKED).alias("from_locked"))
            told = graph.kept(told, "told")
            waits = waiting.select(F.col("entry_va").alias("to"), F.lit(True).alias("waits")).join(told.select("to"), "to", "left_semi")
            told = told.join(waits, "to", "left").where("waits or not from_locked")
            front = told.groupBy(F.col("to").alias("entry_va")).agg((F.max("confidence") * 100.0).alias("priority")).join(met, "entry_va", "left_anti")
        front = graph.kept(front, "front")
        if front.limit(1).count():
            if most_waves is not None and done >= most_waves:
                break
            wave = _judged(front, waiting, held, analyst).withColumn("wave", F.lit(len(waves)))
            store.replace(f"{name}_{len(waves):06d}", wave)
            done += 1
            continue
        met = steps_of(store, name)
        if met is None:
            break
        again = graph.kept(met.where(F.col("outcome") == FAILED).select("entry_va", "priority"), "again")
        store.replace(f"{name}_retry", _judged(again, waiting, held, analyst).withColumn("wave", F.lit(-1)))
    met = steps_of(store, name)
    if met is None:
        met = _judged(entries.limit(0).select("entry_va").withColumn("priority", F.lit(0.0)), waiting, held, analyst).withColumn("wave", F.lit(0))
    # what the second try says of a function stands for the first
    final = met.where("wave = -1").select("entry_va", *[F.col(c).alias(f"{c}_") for c in ("outcome", "action", "note", "confidence")])
    j = met.where("wave >= 0").join(final, "entry_va", "left")
    pick = lambda c: F.when(F.col("outcome_").isNotNull(), F.col(f"{c}_")).otherwise(F.col(c)).alias(c)
    return j.select("wave", "entry_va", "priority", *[pick(c) for c in ("outcome", "action", "note", "confidence")])


def status_after(status: DataFrame, functions: DataFrame, met: DataFrame) -> DataFrame:
    """``status`` with all verdicts so far: functions of validated addresses take action and note."""
    verdicts = functions.join(met.where(F.col("outcome") == VALIDATED), "entry_va").select(F.col("id").alias("function_id"), "action", "note")
    return reconcile.validated(status, verdicts)


@dataclass(frozen=True)
class Reach:
    """How far a generation goes."""

    radius: float = 1.4
    max_nodes: int = 180
    max_depth: int = 6
    max_paths: int = 40
    ancestor_depth: int = 2
    least_weight: float = 0.28
    frontier: int = 3
    least_new: float = 0.05
    token_budget: int = 0


def _explored(roots: DataFrame, calls: DataFrame, edges: DataFrame, reach: Reach) -> tuple[DataFrame, DataFrame]:
    """``goal, entry_va`` around each goal's roots, and the paths from them (``goal, start, key, path, depth, leaf``)
    within these nodes (all paths of a root that has none).  What goals share is explored once."""
    each = graph.kept(roots.select(F.col("root").alias("entry_va")).distinct(), "roots")
    near = quota.neighbourhood(edges, each, reach.radius, reach.max_nodes)
    nodes = roots.join(near, near["start"] == roots["root"]).select("goal", F.col("node").alias("entry_va")).distinct()
    paths = quota.first_paths(calls, each, reach.max_depth, reach.max_paths).withColumnRenamed("place", "key")
    nodes = graph.kept(nodes, "nodes")
    of_goal = graph.kept(roots.join(paths, paths["start"] == roots["root"]).select("goal", F.struct("goal", "start").alias("of"), "start", "key", "path", "depth", "leaf"), "paths")
    allowed = of_goal.select("goal", "of").distinct().join(nodes, "goal").select("of", "entry_va")
    return nodes, graph.paths_within(of_goal, allowed, "of").drop("of")


def generations(store: Store, goals: DataFrame, calls: DataFrame, edges: DataFrame, facts: DataFrame, reach: Reach = Reach(), most_steps: int | None = None, name: str = "generation") -> DataFrame:  # noqa: B008
    """``goal, generation, roots, nodes, new_nodes, paths, tokens, stop``: all goals (``entry_va, most``) a generation at a time.

    The first generation explores the goal.  Each further one starts at the heaviest ancestors of the anchors on its predecessor's
    paths, at those not covered yet if there are any, and explores the nodes around them.  A goal stops, each for itself, when there are no
    roots (``no roots``), when its new nodes are less than ``least_new`` of those covered, from the third generation on
    (``saturated``), when their tokens would exceed ``token_budget`` (``budget``), or after ``most`` generations
    (``most``); the first three stop before a generation, whose row then has no paths.

    ``facts`` has ``entry_va, names, tokens, richness``; ``edges`` ``a, b, cost``.  Nodes and paths of each generation are the
    tables ``<name>_nodes_<k>`` and ``<name>_paths_<k>``; its row in ``<name>_step_<k>`` commits it.
    """
    spark = store.spark
    goals = graph.kept(goals.where("entry_va is not null").groupBy("entry_va").agg(F.max("most").alias("most")).select(F.col("entry_va").alias("goal"), "most"), "goals")
    tokens = facts.select("entry_va", F.col("tokens").cast("long").alias("tokens"))
    names = facts.select("entry_va", "names")
    count = lambda df, c: df.groupBy("goal").agg(F.count(F.lit(1)).alias(c))
    done = 0
    while True:
        k = len(_steps(store, f"{name}_step")) + 1
        if most_steps is not None and done >= most_steps:
            break
        if k == 1:
            live, roots = goals, goals.where("most >= 1").select("goal", F.col("goal").alias("root"))
            covered = goals.select("goal", F.col("goal").alias("entry_va")).limit(0)
            spent = goals.select("goal", F.lit(0).cast("long").alias("spent"))
            lone = goals.where("most < 1").select("goal")
        else:
            rows = steps_of(store, f"{name}_step")
            live = graph.kept(rows.where(F.col("generation") == k - 1).where("stop is null").select("goal").join(goals, "goal"), "live")
            if not live.limit(1).count():
                break
            covered = graph.kept(steps_of(store, f"{name}_nodes").join(live.select("goal"), "goal", "left_semi").distinct(), "covered")
            spent = rows.groupBy("goal").agg(F.sum("tokens").alias("spent"))
            paths = store.read(f"{name}_paths_{k - 1:04d}").select(F.col("goal").alias("start"), "path", F.struct("start", "key").alias("key"))
            before = store.read(f"{name}_nodes_{k - 1:04d}").join(live.select("goal"), "goal", "left_semi")
            rich = before.join(facts.select("entry_va", "richness"), "entry_va").select(F.col("goal").alias("start"), "entry_va", "richness")
            own = live.select(F.col("goal").alias("entry_va"))
            found = graph.kept(graph.anchors(paths.join(own.select(F.col("entry_va").alias("start")), "start", "left_semi"), rich, own), "anchors")
            above = graph.ancestor_roots(calls, found.select("entry_va").distinct(), names, reach.ancestor_depth, reach.least_weight, reach.frontier)
            roots = found.join(above, found["entry_va"] == above["anchor"]).select(F.col("start").alias("goal"), "root").distinct()
            new = roots.join(covered.select("goal", F.col("entry_va").alias("root")), ["goal", "root"], "left_anti").withColumn("is_new", F.lit(True))
            roots = roots.join(new, ["goal", "root"], "left").join(new.select("goal").distinct().withColumn("some", F.lit(True)), "goal", "left").where("is_new or some is null").select("goal", "root")
            lone = live.select("goal").limit(0)
        roots = graph.kept(roots, "roots")
        nodes, paths = _explored(roots, calls, edges, reach)
        # tokens of all functions aren't shuffled for the few nodes
        fresh = nodes.join(covered, ["goal", "entry_va"], "left_anti").join(tokens.join(nodes.select("entry_va"), "entry_va", "left_semi"), "entry_va", "left")
        fresh = fresh.groupBy("goal").agg(F.count(F.lit(1)).alias("new_nodes"), F.sum("tokens").alias("new_tokens"))
        row = live.join(count(roots, "roots"), "goal", "left").join(count(nodes, "nodes"), "goal", "left").join(fresh, "goal", "left").join(count(covered, "covered"), "goal", "left").join(spent, "goal", "left")
        row = row.na.fill(0, ["roots", "nodes", "new_nodes", "new_tokens", "covered", "spent"])
        ratio = F.col("new_nodes") / F.greatest(F.lit(1), F.col("covered"))
        early = F.when(F.col("roots") == 0, "no roots").when(F.lit(k > 2) & (ratio < reach.least_new), "saturated").when(F.lit(reach.token_budget > 0) & (F.col("spent") + F.col("new_tokens") > reach.token_budget), "budget")
        row = graph.kept(row.withColumn("early", F.when(F.lit(k > 1), early)), "row")
        going = row.where("early is null").select("goal")
        store.replace(f"{name}_nodes_{k:04d}", nodes.join(going, "goal", "left_semi"))
        store.replace(f"{name}_paths_{k:04d}", paths.join(going, "goal", "left_semi"))
        counted = count(store.read(f"{name}_paths_{k:04d}"), "paths")
        out = row.join(counted, "goal", "left").join(lone.withColumn("none", F.lit(True)), "goal", "left")
        stop = F.when(F.col("early").isNotNull(), F.col("early")).when(F.col("none") | (F.col("most") <= k), "most")
        stays = F.when(F.col("early").isNull(), F.col("new_tokens")).otherwise(0).cast("long")
        store.replace(f"{name}_step_{k:04d}", out.select("goal", F.lit(k).alias("generation"), "roots", "nodes", "new_nodes", F.coalesce("paths", F.lit(0)).cast("long").alias("paths"), stays.alias("tokens"), stop.alias("stop")))
        done += 1
    rows = steps_of(store, f"{name}_step")
    return rows if rows is not None else spark.createDataFrame([], "goal long, generation int, roots long, nodes long, new_nodes long, paths long, tokens long, stop string")
