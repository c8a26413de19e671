"""Rules that derive facts on a typed graph until no rule adds any.

Facts are ``node_id, variable, value, source, confidence``.  A rule is a function of the facts of
the last round, all facts and the edges, giving new facts; what is known already is left out, so
runs end at a fixed point.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import kept

Rule = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]
KEY = ["node_id", "variable", "value"]
COLUMNS = [*KEY, "source", "confidence"]


def _edges(edges: DataFrame, kind: str) -> DataFrame:
    return edges.where(F.col("edge_type") == kind).select("source_id", "target_id")


def type_propagation(decay: float = 0.9, least: float = 0.7) -> Rule:
    """Types of a caller's variables are types of its callees' variables of the same name."""
    def rule(new: DataFrame, known: DataFrame, edges: DataFrame) -> DataFrame:
        typed = new.where((F.col("variable") != "") & (F.col("confidence") >= least))
        return typed.join(_edges(edges, "CALLS"), typed["node_id"] == F.col("source_id")).select(F.col("target_id").alias("node_id"), "variable", "value", F.lit("type_propagation").alias("source"), (F.col("confidence") * decay).alias("confidence"))

    return rule


def return_propagation(factor: float = 0.85 * 0.9, least: float = 0.7) -> Rule:
    """A callee's return type is a fact of its callers."""
    def rule(new: DataFrame, known: DataFrame, edges: DataFrame) -> DataFrame:
        typed = new.where((F.col("variable") == "return") & (F.col("confidence") >= least))
        return typed.join(_edges(edges, "CALLS"), typed["node_id"] == F.col("target_id")).select(F.col("source_id").alias("node_id"), F.lit("called_return").alias("variable"), "value", F.lit("return_propagation").alias("source"), (F.col("confidence") * factor).alias("confidence"))

    return rule


def api_injection(api_types: DataFrame, confidence: float = 0.95) -> Rule:
    """Parameter types of a known interface (``api_id, variable, value``) hold in what uses it."""
    def rule(new: DataFrame, known: DataFrame, edges: DataFrame) -> DataFrame:
        return _edges(edges, "USES_API").join(api_types, F.col("target_id") == F.col("api_id")).select(F.col("source_id").alias("node_id"), "variable", "value", F.lit("api_injection").alias("source"), F.lit(confidence).alias("confidence"))

    return rule


def naming_hints(factor: float = 0.3, least: float = 0.7) -> Rule:
    """Callers of a well-known function are hinted at by its name."""
    def rule(new: DataFrame, known: DataFrame, edges: DataFrame) -> DataFrame:
        named = new.where((F.col("variable") == "name") & (F.col("confidence") >= least))
        return named.join(_edges(edges, "CALLS"), named["node_id"] == F.col("target_id")).select(F.col("source_id").alias("node_id"), F.lit("hint").alias("variable"), F.concat(F.lit("calls_"), "value").alias("value"), F.lit("naming_hints").alias("source"), (F.col("confidence") * factor).alias("confidence"))

    return rule


def global_consistency(least: float = 0.6) -> Rule:
    """The type that most accesses of a global agree on, by confidence, is the global's.  Confidences are summed as
    decimals: sums of doubles depend on their order, and equal sums of two types would not be equal."""
    def rule(new: DataFrame, known: DataFrame, edges: DataFrame) -> DataFrame:
        votes = known.where(F.col("variable") == "access_type").join(_edges(edges, "ACCESSES"), F.col("node_id") == F.col("source_id")).groupBy(F.col("target_id").alias("node_id"), "value").agg(F.sum(F.col("confidence").cast("decimal(18,9)")).alias("w"))
        best = votes.groupBy("node_id").agg(F.max_by("value", F.struct("w", "value")).alias("value"), F.max("w").cast("double").alias("top"), F.sum("w").cast("double").alias("all"))
        return best.where(F.col("top") / F.col("all") >= least).select("node_id", F.lit("type").alias("variable"), "value", F.lit("global_consistency").alias("source"), F.least(F.col("top") / F.col("all"), F.lit(1.0)).alias("confidence"))

    return rule


def run(facts: DataFrame, edges: DataFrame, rules: list[tuple[int, Rule]], rounds: int = 10) -> DataFrame:
    """All facts with ``round`` (0: given).  Rules of higher priority come first; of a fact that
    several rules derive in a round the most confident stays.  ``rounds`` is part of what the rules mean:
    facts that only later rounds would derive are not wanted."""
    known = kept(facts.select(*COLUMNS).withColumn("round", F.lit(0)), "facts")
    new = known
    ordered = [r for _, r in sorted(rules, key=lambda x: -x[0])]
    for k in range(1, rounds + 1):
        made = None
        for rule in ordered:
            part = rule(new.select(*COLUMNS), known.select(*COLUMNS), edges).select(*COLUMNS)
            made = part if made is None else made.unionByName(part)
        if made is None:
            break
        best = made.groupBy(*KEY).agg(F.max(F.struct("confidence", "source")).alias("b")).select(*KEY, "b.source", "b.confidence")
        new = kept(best.join(known.select(*KEY), KEY, "left_anti").withColumn("round", F.lit(k)), "facts")
        if not new.limit(1).count():
            break
        known = kept(known.unionByName(new), "facts")
    return known
