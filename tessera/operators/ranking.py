"""Priorities, richness and top-k choices over unified nodes.

Nodes have ``entry_va, names, external_callees, string_refs, callees, callers`` (arrays; the last four may be
counts instead) and ``instr_count``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.sources.store import Store

# Keywords that make a function worth a goal, and what each counts.
SIGNALS = {
    "socket": 12, "send": 8, "recv": 8, "connect": 10, "bind": 8, "listen": 8, "accept": 8, "server": 10, "client": 8,
    "encrypt": 12, "decrypt": 12, "crypt": 10, "cipher": 10, "aes": 10, "rsa": 10, "sha": 8, "hash": 8, "hmac": 8,
    "file": 6, "open": 4, "read": 4, "write": 4, "close": 4, "transfer": 8, "download": 8, "upload": 8,
    "password": 10, "passwd": 10, "auth": 10, "login": 10, "token": 8, "key": 6, "cert": 8, "tls": 10, "ssl": 10,
    "exec": 8, "spawn": 8, "system": 6, "shell": 8, "command": 6, "inject": 10, "hook": 8, "patch": 6,
    "alloc": 4, "malloc": 4, "free": 4, "heap": 6, "mutex": 6, "thread": 6, "process": 6, "registry": 8, "config": 6, "setting": 4,
    "network": 8, "http": 8, "dns": 8, "url": 6, "packet": 8, "buffer": 6, "overflow": 10, "exploit": 12, "syslog": 6, "log": 4, "debug": 4,
}
def count_of(nodes: DataFrame, column: str) -> Column:
    """How many a node has of something: the size of an array, or the number itself, 0 for null."""
    sized = nodes.schema[column].dataType.typeName() == "array"
    return F.coalesce(F.size(column) if sized else F.col(column), F.lit(0)).cast("int")


STRUCT_HINT = r"(?:->|\.)\s*field_|\bstruct\s+\w+"


def priority(apis: Column, strings: Column, internal: Column, callers: Column, instructions: Column, analysed: Column) -> Column:
    """Priority of a function from counts of its parts."""
    # What each part counts, and the most of it that counts.
    n = F.coalesce(instructions, F.lit(0))
    return (
        F.when(apis > 0, 200 + 40 * F.least(apis, F.lit(5))).otherwise(0)
        + F.when(strings > 0, 120 + 15 * F.least(strings, F.lit(5))).otherwise(0)
        + F.when(internal == 0, 60).otherwise(F.greatest(F.lit(0), 40 - internal * 4))
        + F.least(callers * 6, F.lit(40))
        + F.when(n == 0, -20).when(n <= 30, 15).when(n <= 150, 5).otherwise(-F.least(F.floor((n - 150) / 50) * 5, F.lit(40)))
        + analysed * 25
    ).cast("bigint")


def analysed_entries(status: DataFrame, functions: DataFrame) -> DataFrame:
    """``entry_va`` of functions analysed or locked in any view."""
    done = status.where(F.col("analysis_state").isin("ANALYZED", "LOCKED"))
    return functions.join(done.select(F.col("function_id").alias("id")), "id", "left_semi").select("entry_va").distinct()


def scores(nodes: DataFrame, calls: DataFrame, analysed: DataFrame) -> DataFrame:
    """``entry_va, score`` of all nodes; ``calls`` has ``entry_va, callee_va``."""
    hits = calls.join(analysed.select(F.col("entry_va").alias("callee_va")), "callee_va", "left_semi").groupBy("entry_va").agg(F.countDistinct("callee_va").alias("analysed"))
    size = lambda c: count_of(nodes, c)
    j = nodes.join(hits, "entry_va", "left")
    return j.select("entry_va", priority(size("external_callees"), size("string_refs"), size("callees"), size("callers"), F.col("instr_count"), F.coalesce("analysed", F.lit(0))).alias("score"))


def stored_scores(store: Store, version: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Scores kept in a store for one version of their inputs, which the caller names; made and kept where
    that version has none.  Scores of other versions aren't looked at."""
    name = f"scores_{version}"
    if not store.exists(name):
        store.replace(name, make())
    return store.read(name)


def to_rescore(calls: DataFrame, changed: DataFrame) -> DataFrame:
    """``entry_va`` of the changed functions and of their callers."""
    callers = calls.join(changed.select(F.col("entry_va").alias("callee_va")), "callee_va", "left_semi").select("entry_va")
    return changed.select("entry_va").unionByName(callers).distinct()


def rescored(nodes: DataFrame, calls: DataFrame, analysed: DataFrame, old: DataFrame, todo: DataFrame) -> DataFrame:
    """Stored scores ``old`` with those of the functions ``todo`` (see ``to_rescore``) worked out anew; ``nodes`` need
    hold no others."""
    new = scores(nodes.join(todo, "entry_va", "left_semi"), calls.join(todo, "entry_va", "left_semi"), analysed)
    return old.join(todo, "entry_va", "left_anti").unionByName(new)


def top(rows: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first ``k`` rows in the order given, ties by entry address."""
    return rows.orderBy(*order, "entry_va").limit(k)


def richness(text: Column, names: Column, strings: Column, apis: Column, internal: Column, callers: Column, instructions: Column, structs: tuple[str, ...] = ()) -> Column:
    """How much a function tells: capped counts of its parts and keywords, each keyword once."""
    low = F.lower(F.coalesce(text, F.lit("")))
    spoken = F.lower(F.concat_ws("\n", strings, names))
    found = sum(F.when(spoken.contains(k), w).otherwise(0) for k, w in SIGNALS.items())
    manual = sum((F.when(low.contains(s.lower()), 1).otherwise(0) for s in structs if s.strip()), F.lit(0))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    n = F.coalesce(instructions, F.lit(0))
    return (
        4 * F.least(size(apis), F.lit(15)) + 3 * F.least(size(strings), F.lit(20)) + 2 * F.least(internal, F.lit(20)) + 2 * F.least(callers, F.lit(20))
        + 5 * F.least(F.regexp_count(low, F.lit(STRUCT_HINT)), F.lit(10)) + 8 * F.least(manual, F.lit(6))
        + F.when(n >= 120, 2).when(n >= 30, 1).otherwise(0) + F.least(found, F.lit(80))
    ).cast("int")


def entry_points(nodes: DataFrame, entries: list[str], limit: int = 3) -> DataFrame:
    """``entry_va``: stated addresses, else exact names, else parts of names; with none stated the
    best tier that has any of named entries, roots with callees, and functions with callees."""
    out = None
    for token in [e.strip() for e in entries if e and e.strip()]:
        low = token.lower()
        names = F.transform("names", F.lower)
        tier = (
            F.when(T.parse_address(F.lit(token)) == F.col("entry_va"), 0).when(F.array_contains(names, low), 1)
            .when(F.exists(names, lambda n: n.contains(low)), 2))
        hits = nodes.select("entry_va", tier.alias("tier")).where("tier is not null")
        hits = hits.crossJoin(F.broadcast(hits.agg(F.min("tier").alias("best")))).where("tier = best").select("entry_va")
        out = hits if out is None else out.unionByName(hits)
    if out is not None:
        return out.distinct().orderBy("entry_va")
    fan = count_of(nodes, "callees")
    tier = F.when(F.exists("names", lambda n: n.rlike(T.ENTRY_HINT)), 0).when((count_of(nodes, "callers") == 0) & (fan > 0), 1).when(fan > 0, 2)
    ranked = nodes.select("entry_va", fan.alias("fan"), tier.alias("tier")).where("tier is not null")
    best = ranked.agg(F.min("tier").alias("best"))  # one row
    return ranked.crossJoin(F.broadcast(best)).where("tier = best").orderBy(F.desc("fan"), "entry_va").limit(max(1, limit)).select("entry_va")


def ordered_callees(calls: DataFrame, depth: DataFrame, branch: int) -> DataFrame:
    """``entry_va, callee_va, rank``: each function's callees by depth and fan-out, the first ``branch``."""
    fan = calls.groupBy(F.col("entry_va").alias("callee_va")).agg(F.count(F.lit(1)).alias("fan"))
    j = calls.join(fan, "callee_va", "left").join(depth.select(F.col("entry_va").alias("callee_va"), "depth"), "callee_va", "left")
    rank = F.row_number().over(W.partitionBy("entry_va").orderBy(F.desc(F.coalesce("depth", F.lit(0))), F.desc(F.coalesce("fan", F.lit(0))), "callee_va"))
    return j.select("entry_va", "callee_va", rank.alias("rank")).where(F.col("rank") <= branch)


def goals(nodes: DataFrame, addresses: list[int], keywords: list[str], structs: list[str], degree: DataFrame, limit: int, rich: DataFrame) -> DataFrame:
    """``entry_va, score``: stated addresses (100), else 10 a struct and 6 a keyword found in the
    node's text (column ``text``); where nothing is stated or found, the best connected nodes."""
    low = F.lower(F.coalesce("text", F.lit("")))
    hit = sum((F.when(low.contains(s.lower()), 10).otherwise(0) for s in structs), F.lit(0)) + sum((F.when(low.contains(k.lower()), 6).otherwise(0) for k in keywords), F.lit(0))
    score = F.when(F.col("entry_va").isin(addresses), 100).otherwise(hit) if addresses else hit
    manual = nodes.select("entry_va", score.alias("score")).where("score > 0").join(degree, "entry_va", "left").join(rich, "entry_va", "left")
    order = [F.desc(F.coalesce("degree", F.lit(0))), F.desc(F.coalesce("richness", F.lit(0))), F.col("entry_va")]
    auto = nodes.select("entry_va", F.lit(0).alias("score")).join(degree, "entry_va", "left").join(rich, "entry_va", "left")
    rows = manual.withColumn("tier", F.lit(0)).unionByName(auto.withColumn("tier", F.lit(1)))
    best = rows.agg(F.min("tier").alias("best"))  # one row
    return rows.crossJoin(F.broadcast(best)).where("tier = best").orderBy(F.desc("score"), *order).limit(limit).select("entry_va", "score")


def candidates(rows: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """``rows`` with ``reason``: the first check that fails, null for candidates."""
    reason = F.lit(None).cast("string")
    for name, passes in reversed(checks):
        reason = F.when(~F.coalesce(passes, F.lit(False)), name).otherwise(reason)
    return rows.withColumn("reason", reason)


def rank_for_comparison(nodes: DataFrame, limit: int, evidence: bool = False) -> DataFrame:
    """Best nodes by ``priority, evidence, degree`` (and fewer instructions) or by ``priority,
    degree, richness``, larger addresses first among equals."""
    order = ["priority", "evidence", "degree"] if evidence else ["priority", "degree", "richness"]
    extra = [F.asc("instr_count")] if evidence else []
    return nodes.orderBy(*[F.desc(c) for c in order], *extra, F.desc("entry_va")).limit(limit)
