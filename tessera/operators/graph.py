"""Typed edges, distances, neighbourhoods, paths and common ancestors.

Iterative operators keep each round's frontier as a table in the shared folder, go on until it is empty,
however many rounds that takes, and never bring a graph to the driver.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T

# What an edge of each kind costs.
WEIGHTS = {"call": 1.0, "data": 0.5, "string": 0.4, "indirect": 0.8, "global": 0.1}
GLOBAL_CLUSTER, STRING_CLUSTER = 24, 20
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  Where that is unset, one machine (tests) gets a temporary folder, made once for
    this process; on a cluster it is an error, as executors would not share one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "dir" not in _LOCAL:
            _LOCAL["dir"] = tempfile.mkdtemp(prefix="spark-")
        where = _LOCAL["dir"]
    return f"{where.rstrip('/')}/tessera"


def kept(df: DataFrame, name: str = "round", folder: str | None = None) -> DataFrame:
    """``df`` as a table in the cluster's shared folder, so lineage ends there."""
    spark: SparkSession = df.sparkSession
    path = f"{folder or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clique(members: DataFrame, key: str, most: int, kind: str) -> DataFrame:
    """Edges ``a < b`` between the ``most`` least members of each cluster: at most
    ``most * (most - 1) / 2`` a cluster.  Spark keeps no more than ``most`` rows of a cluster in each task
    before it brings a cluster together (a partial group limit), so a very common key is no hot one."""
    rank = F.row_number().over(W.partitionBy(key).orderBy("entry_va"))
    few = members.select(key, "entry_va").distinct().withColumn("r", rank).where(F.col("r") <= most)
    rest = F.filter("vas", lambda v: v > F.col("a"))
    return few.groupBy(key).agg(F.array_sort(F.collect_list("entry_va")).alias("vas")).select(F.explode("vas").alias("a"), "vas").select("a", F.explode(rest).alias("b")).select("a", "b", F.lit(kind).alias("kind"))


def mixed_edges(calls: DataFrame, strings: DataFrame | None = None, globals_: DataFrame | None = None, data: DataFrame | None = None, indirect: DataFrame | None = None) -> DataFrame:
    """``a, b, kinds`` with ``a < b``: undirected edges of all kinds, self edges dropped.

    ``calls``, ``data`` and ``indirect`` have ``entry_va, callee_va``; ``strings`` has
    ``entry_va, value`` and ``globals_`` has ``entry_va, global_va``, whose clusters are cliques of
    their first 20 and 24 members."""
    def pairs(df: DataFrame, kind: str) -> DataFrame:
        return df.select(F.least("entry_va", "callee_va").alias("a"), F.greatest("entry_va", "callee_va").alias("b"), F.lit(kind).alias("kind"))

    parts = [pairs(calls, "call")]
    parts += [pairs(d, k) for d, k in ((data, "data"), (indirect, "indirect")) if d is not None]
    if globals_ is not None:
        parts.append(clique(globals_, "global_va", GLOBAL_CLUSTER, "global"))
    if strings is not None:
        parts.append(clique(strings.select(F.lower(F.trim("value")).alias("value"), "entry_va").where("value != ''"), "value", STRING_CLUSTER, "string"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("a != b").groupBy("a", "b").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def edge_cost(kinds: Column, weights: dict[str, float] = WEIGHTS) -> Column:
    """The least weight of an edge's kinds; unknown kinds and none cost 1."""
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.coalesce(F.array_min(F.transform(kinds, lambda k: F.coalesce(F.try_element_at(table, k), F.lit(1.0)))), F.lit(1.0))


def both_ways(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("a", "b")]
    return edges.select("a", "b", *rest).unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), *rest))


def distances(edges: DataFrame, starts: DataFrame, radius: float) -> DataFrame:
    """``start, node, dist`` within ``radius`` of each start over undirected weighted edges
    ``a, b, cost``: relaxation of the improved nodes only, until none improves.  Costs may not be negative."""
    steps = kept(both_ways(edges.select("a", "b", "cost")))
    if steps.where("cost < 0").limit(1).count():
        raise ValueError("costs may not be negative")
    best = kept(starts.select(F.col("entry_va").alias("start"), F.col("entry_va").alias("node"), F.lit(0.0).alias("dist")).distinct())
    frontier = best
    while frontier.limit(1).count():
        reached = frontier.join(steps, frontier["node"] == steps["a"]).select("start", F.col("b").alias("node"), (F.col("dist") + F.col("cost")).alias("dist")).where(F.col("dist") <= radius + 1e-9)
        reached = reached.groupBy("start", "node").agg(F.min("dist").alias("dist"))
        old = best.withColumnRenamed("dist", "old")
        frontier = kept(reached.join(old, ["start", "node"], "left").where("old is null or dist < old - 1e-12").select("start", "node", "dist"))
        best = kept(best.unionByName(frontier).groupBy("start", "node").agg(F.min("dist").alias("dist")))
    return best


def hops(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """``start, node, hop`` by breadth-first search along ``src, dst``, up to ``depth`` hops."""
    seen = kept(starts.select(F.col("entry_va").alias("start"), F.col("entry_va").alias("node"), F.lit(0).alias("hop")).distinct())
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select("start", F.col("dst").alias("node")).distinct()
        frontier = kept(step.join(seen, ["start", "node"], "left_anti").withColumn("hop", F.lit(d)))
        if not frontier.limit(1).count():
            break
        seen = kept(seen.unionByName(frontier))
    return seen


def budget_neighbourhood(calls: DataFrame, starts: DataFrame, budget: int, depth: int = 5) -> DataFrame:
    """``start, node, hop, side``: the start and up to ``budget - 1`` callers and callees, half of
    the budget each, what one side leaves going to the other; nearest first, then least address."""
    down = hops(calls.select(F.col("entry_va").alias("src"), F.col("callee_va").alias("dst")), starts, depth).withColumn("side", F.lit(1))
    up = hops(calls.select(F.col("callee_va").alias("src"), F.col("entry_va").alias("dst")), starts, depth).withColumn("side", F.lit(0))
    near = up.unionByName(down).where("hop > 0").groupBy("start", "node").agg(F.min(F.struct("hop", "side")).alias("x")).select("start", "node", "x.hop", "x.side")
    place = F.row_number().over(W.partitionBy("start", "side").orderBy("hop", "node"))
    ranked = near.withColumn("place", place)
    room = budget - 1
    share = F.when(F.col("side") == 0, room // 2).otherwise(room - room // 2)
    first = (F.col("place") > share).cast("int")  # within its side's share or not
    order = F.row_number().over(W.partitionBy("start").orderBy(first, "hop", "side", "node"))
    chosen = ranked.withColumn("order", order).where(F.col("order") <= room).select("start", "node", "hop", "side")
    own = starts.select(F.col("entry_va").alias("start"), F.col("entry_va").alias("node"), F.lit(0).alias("hop"), F.lit(-1).alias("side")).distinct()
    return own.unionByName(chosen)


def simple_paths(calls: DataFrame, starts: DataFrame, max_depth: int, max_branch: int | None = None, max_paths: int | None = None, ranks: DataFrame | None = None) -> DataFrame:
    """``start, path, depth, leaf``: paths without repeated nodes, ended by depth (``max_depth``), by
    having no callee (``no_callee``) or by reaching a node of the path (``cycle_cut``).

    Paths follow each node's callees in the order of ``ranks`` (``entry_va, callee_va, rank``),
    by default ascending address; ``max_paths`` keeps those that a depth-first walk meets first."""
    if ranks is None:
        ranks = calls.select("entry_va", "callee_va").distinct().withColumn("rank", F.row_number().over(W.partitionBy("entry_va").orderBy("callee_va")))
    if max_branch:
        ranks = ranks.where(F.col("rank") <= max_branch)
    # kept, as every round reads it
    step = kept(ranks.select(F.col("entry_va").alias("tail"), "callee_va", F.col("rank").cast("int").alias("rank")), "steps")
    live = kept(starts.select(F.col("entry_va").alias("start"), F.array("entry_va").alias("path"), F.array().cast("array<int>").alias("key")).distinct())
    done = []
    for d in range(max_depth):
        tail = live.withColumn("tail", F.element_at("path", -1))
        j = tail.join(step, "tail", "left")
        cyclic = F.array_contains("path", F.col("callee_va"))
        leaf = F.when(F.col("callee_va").isNull(), "no_callee").when(cyclic, "cycle_cut")
        ends = j.select("start", "path", F.when(F.col("callee_va").isNull(), F.col("key")).otherwise(F.array_append("key", F.col("rank"))).alias("key"), leaf.alias("leaf")).where("leaf is not null")
        done.append(kept(ends))
        live = kept(j.where(F.col("callee_va").isNotNull() & ~cyclic).select("start", F.array_append("path", F.col("callee_va")).alias("path"), F.array_append("key", F.col("rank")).alias("key")))
        if not live.limit(1).count():
            break
    out = live.withColumn("leaf", F.lit("max_depth"))
    for p in done:
        out = out.unionByName(p)
    out = out.withColumn("depth", F.size("path") - 1)
    if max_paths:
        out = out.withColumn("n", F.row_number().over(W.partitionBy("start").orderBy("key"))).where(F.col("n") <= max_paths).drop("n")
    return out.select("start", "path", "depth", "leaf", "key")


def longest_depth(calls: DataFrame) -> DataFrame:
    """``entry_va, depth``: the most calls in a row below each function, self calls aside.

    Functions are settled from the leaves upwards, each as soon as all it calls are, one round for each
    depth.  Those from which a cycle can be reached never are: they have no longest path, and the depth null.
    """
    spark = calls.sparkSession
    folder = f"{shared_folder(spark)}/depth-{uuid.uuid4().hex}"
    steps = kept(calls.where("entry_va != callee_va").select("entry_va", "callee_va").distinct())
    waiting = kept(steps.groupBy("entry_va").agg(F.count(F.lit(1)).alias("open"), F.lit(0).alias("depth")))
    leaves = steps.select(F.col("callee_va").alias("entry_va")).distinct().join(waiting, "entry_va", "left_anti")
    settled = kept(leaves.select("entry_va", F.lit(0).alias("depth")), "settled", folder)
    while settled.limit(1).count():
        told = steps.join(settled.select(F.col("entry_va").alias("callee_va"), F.col("depth").alias("below")), "callee_va").groupBy("entry_va").agg(F.count(F.lit(1)).alias("n"), (F.max("below") + 1).alias("new"))
        j = waiting.join(told, "entry_va", "left")
        waiting = kept(j.where("open > 0").select("entry_va", (F.col("open") - F.coalesce("n", F.lit(0))).alias("open"), F.greatest("depth", F.coalesce("new", F.lit(0))).alias("depth")))
        settled = kept(waiting.where("open = 0").select("entry_va", "depth"), "settled", folder)
    done = spark.read.schema("entry_va bigint, depth int").parquet(f"{folder}/settled-*")
    return done.unionByName(waiting.where("open > 0").select("entry_va", F.lit(None).cast("int").alias("depth")))


def ancestor_roots(calls: DataFrame, anchors: DataFrame, names: DataFrame, max_depth: int = 5, least: float = 0.28, frontier: int = 3, alpha: float = 0.35, beta: float = 0.2, gamma: float = 0.5) -> DataFrame:
    """``anchor, root, mode, weight``: for each anchor its heaviest ancestor if that reaches
    ``least``, else its ``frontier`` heaviest, else itself.  An ancestor weighs
    ``exp(-alpha * distance) / (1 + beta * callers) * (1 + gamma * overlap of name words)``.
    ``names`` has ``entry_va, names``."""
    up = hops(calls.select(F.col("callee_va").alias("src"), F.col("entry_va").alias("dst")), anchors, max_depth).where("hop > 0")
    # ancestors are few: what is known of them is looked up before the joins, so whole tables aren't shuffled for them
    met = kept(up.select("node").union(up.select("start")).distinct(), "met")
    indegree = calls.join(met.select(F.col("node").alias("callee_va")), "callee_va", "left_semi").groupBy(F.col("callee_va").alias("node")).agg(F.countDistinct("entry_va").alias("indegree"))
    words = names.join(met.select(F.col("node").alias("entry_va")), "entry_va", "left_semi").select("entry_va", T.plain_tokens(F.array_join("names", " ")).alias("words"))
    j = up.join(indegree, "node", "left").join(words.select(F.col("entry_va").alias("node"), F.col("words").alias("own")), "node", "left").join(words.select(F.col("entry_va").alias("start"), F.col("words").alias("wanted")), "start", "left")
    overlap = F.when((F.size("own") > 0) & (F.size("wanted") > 0), F.size(F.array_intersect("own", "wanted")) / F.size(F.array_union("own", "wanted"))).otherwise(0.0)
    weight = F.exp(-alpha * F.col("hop")) / (1 + beta * F.coalesce("indegree", F.lit(0))) * (1 + gamma * F.coalesce(overlap, F.lit(0.0)))
    ranked = j.select("start", "node", F.round(weight, 6).alias("weight")).withColumn("place", F.row_number().over(W.partitionBy("start").orderBy(F.desc("weight"), "node"))).withColumn("best", F.max("weight").over(W.partitionBy("start")))
    chosen = ranked.where(((F.col("best") >= least) & (F.col("place") == 1)) | ((F.col("best") < least) & (F.col("place") <= frontier)))
    found = chosen.select(F.col("start").alias("anchor"), F.col("node").alias("root"), F.when(F.col("best") >= least, "ancestor").otherwise("frontier").alias("mode"), "weight")
    lone = anchors.select(F.col("entry_va").alias("anchor")).distinct().join(found, "anchor", "left_anti").select("anchor", F.col("anchor").alias("root"), F.lit("anchor").alias("mode"), F.lit(None).cast("double").alias("weight"))
    return found.unionByName(lone)


def _is_control(line: Column) -> Column:
    return line.rlike(T.CONTROL_LINE) | line.rlike(T.COMPARE)


def guards(lines: DataFrame, calls: DataFrame, window: int = 18, most: int = 8) -> DataFrame:
    """``caller_va, callee_va, call_line, guard_line, guard``: control and comparison lines up to
    ``window`` lines before a call, nearest first, equal ones once, at most ``most``.

    ``lines`` has ``entry_va, line_no, line``; ``calls`` has ``caller_va, callee_va, call_line``."""
    text = T.normal_line(F.col("line"))
    control = lines.where(_is_control(F.col("line"))).select(F.col("entry_va").alias("caller_va"), F.col("line_no").alias("guard_line"), text.alias("guard"))
    j = calls.join(control, "caller_va").where("guard_line < call_line").where(F.col("guard_line") >= F.col("call_line") - window)
    once = j.groupBy("caller_va", "callee_va", "call_line", "guard").agg(F.max("guard_line").alias("guard_line"))
    place = F.row_number().over(W.partitionBy("caller_va", "callee_va", "call_line").orderBy(F.desc("guard_line"), "guard"))
    return once.withColumn("place", place).where(F.col("place") <= most).drop("place")


def call_sites(code: DataFrame, calls: DataFrame, most: int | None = 6) -> DataFrame:
    """``caller_va, callee_va, call_line, line``: first ``most`` lines (None: all) of a caller's code that name
    the callee as a whole word.  ``code`` has ``entry_va, body``; ``calls`` has ``caller_va, callee_va, callee_name``.

    Lines are cut into words once and meet the names in an equi-join; only names that aren't one word are looked
    for as they stand."""
    lines = code.select(F.col("entry_va").alias("caller_va"), F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("call_line", "line"))
    plain = F.col("callee_name").rlike(r"^\w+$")
    words = lines.join(calls.where(plain).select("caller_va").distinct(), "caller_va", "left_semi")
    words = words.select("caller_va", "call_line", "line", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"\w+"), 0))).alias("callee_name"))
    found = calls.where(plain).join(words, ["caller_va", "callee_name"])
    escaped = F.regexp_replace("callee_name", r"([^\w])", r"\\$1")
    # a word's end counts only where the name itself ends in one
    pattern = F.concat(F.when(F.col("callee_name").rlike(r"^\w"), r"(?<!\w)").otherwise(""), escaped, F.when(F.col("callee_name").rlike(r"\w$"), r"(?!\w)").otherwise(""))
    odd = calls.where(~plain & (F.col("callee_name") != "")).withColumn("pattern", pattern).join(lines, "caller_va").where("contains(line, callee_name) and line rlike pattern").drop("pattern")
    named = found.select(*calls.columns, "call_line", "line").unionByName(odd.select(*calls.columns, "call_line", "line"))
    named = named.dropDuplicates(["caller_va", "callee_va", "call_line"])
    if most is None:
        return named
    place = F.row_number().over(W.partitionBy("caller_va", "callee_va").orderBy("call_line"))
    return named.withColumn("place", place).where(F.col("place") <= most).drop("place")


def edge_conditions(code: DataFrame, calls: DataFrame, window: int = 18, most_guards: int | None = None, most_sites: int | None = None) -> DataFrame:
    """``caller_va, callee_va, status, sites, guard_count, signals, strength`` of every call: on which conditions it is made.

    The status is ``no_pseudocode`` for a caller without code and ``callsite_not_found`` where no line names the callee.  Every
    line that names the callee is a site (``most_sites``: the first so many), and different guards from ``window`` lines before it
    on are counted at each (``most_guards``: so many at most); signals of the environment are those of the lines from ``window``
    before a site to the one after it.  ``code`` and ``calls`` are as in ``call_sites``."""
    code = code.where("trim(body) != ''")
    sites = kept(call_sites(code, calls, most_sites).select("caller_va", "callee_va", "call_line", "line"), "sites")
    lines = code.select("entry_va", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("line_no", "line"))
    guard = F.when(_is_control(F.col("line")), T.normal_line(F.col("line")))
    # lines meet the sites once, for guards and signals both; in long code a site meets only lines of the two stretches
    # that its window can touch
    told = F.array(F.struct(guard.alias("guard"), T.environment_signals(F.col("line")).alias("signals")))
    told = F.filter(told, lambda x: x["guard"].isNotNull() | (F.size(x["signals"]) > 0))
    stretch = lambda line: F.floor(line / (window + 2))
    told = lines.select(F.col("entry_va").alias("caller_va"), "line_no", stretch(F.col("line_no")).alias("stretch"), F.inline(told))
    near = (F.col("line_no") >= F.col("call_line") - window) & (F.col("line_no") <= F.col("call_line") + 1)
    touched = F.array_distinct(F.array(stretch(F.col("call_line") - window), stretch(F.col("call_line") + 1)))
    of_site = sites.select("caller_va", "callee_va", "call_line", F.explode(touched).alias("stretch")).join(told, ["caller_va", "stretch"]).where(near).groupBy("caller_va", "callee_va", "call_line")
    of_site = of_site.agg(F.size(F.collect_set(F.when(F.col("line_no") < F.col("call_line"), F.col("guard")))).alias("guards"), F.flatten(F.collect_set("signals")).alias("signals"))
    found = of_site.groupBy("caller_va", "callee_va").agg(F.sum("guards" if most_guards is None else F.least("guards", F.lit(most_guards))).alias("guard_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("signals")))).alias("signals"))
    has = code.select(F.col("entry_va").alias("caller_va"), F.lit(True).alias("has_code")).distinct()
    count = sites.groupBy("caller_va", "callee_va").agg(F.count(F.lit(1)).alias("sites"))
    out = calls.select("caller_va", "callee_va").distinct().join(has, "caller_va", "left")
    for more in (count, found):
        out = out.join(more, ["caller_va", "callee_va"], "left")
    out = out.withColumns({"sites": F.coalesce("sites", F.lit(0)), "guard_count": F.coalesce("guard_count", F.lit(0)), "signals": F.coalesce("signals", F.array().cast("array<string>"))})
    status = F.when(F.col("has_code").isNull(), "no_pseudocode").when(F.col("sites") == 0, "callsite_not_found").otherwise("ok")
    return out.select("caller_va", "callee_va", status.alias("status"), "sites", "guard_count", "signals", (F.col("guard_count") + F.size("signals")).alias("strength"))


def edge_strength(sites: DataFrame, found: DataFrame) -> DataFrame:
    """``caller_va, callee_va, sites, guard_count, signals, strength`` of conditions on each edge:
    guards plus distinct signals of the environment in them."""
    g = found.groupBy("caller_va", "callee_va").agg(F.count(F.lit(1)).alias("guard_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(T.environment_signals(F.col("guard")))))).alias("signals"))
    s = sites.groupBy("caller_va", "callee_va").agg(F.count(F.lit(1)).alias("sites"))
    j = s.join(g, ["caller_va", "callee_va"], "left").withColumns({"guard_count": F.coalesce("guard_count", F.lit(0)), "signals": F.coalesce("signals", F.array().cast("array<string>"))})
    return j.withColumn("strength", F.col("guard_count") + F.size("signals"))


def deepest_path(paths: DataFrame, by: list[str]) -> DataFrame:
    """Of each ``by`` the path of most depth, then most nodes, then strongest conditions (``depth, path,
    strength``); of equals the one met first (``key``)."""
    order = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("depth"), F.desc(F.size("path")), F.desc("strength"), "key"))
    return paths.withColumn("place", order).where("place = 1").drop("place")


def paths_within(paths: DataFrame, allowed: DataFrame, by: str = "start") -> DataFrame:
    """Paths all of whose nodes are ``allowed`` (``<by>, entry_va``); where a start has none, all of its paths."""
    steps = paths.select(by, "key", F.size("path").alias("nodes"), F.explode(F.array_distinct("path")).alias("entry_va"))
    inside = steps.join(allowed.select(by, "entry_va").distinct().withColumn("ok", F.lit(1)), [by, "entry_va"], "left").groupBy(by, "key").agg(F.bool_and(F.col("ok").isNotNull()).alias("inside"))
    some = inside.groupBy(by).agg(F.bool_or("inside").alias("some"))
    return paths.join(inside, [by, "key"]).join(some, by).where("inside or not some").select(*paths.columns)


def path_nodes(paths: DataFrame, by: str = "start") -> DataFrame:
    """``<by>, entry_va``: nodes of any of the paths."""
    return paths.select(by, F.explode("path").alias("entry_va")).distinct()


def path_conditions(edges: DataFrame, by: list[str], most: int = 12) -> DataFrame:
    """``<by>, strength, signals, guards`` of each path from its edges (``position, strength, signals, guards``): up to
    the edge with which ``most`` guards are reached, their strengths' sum, their signals and the first ``most``
    guards.  What comes after that edge counts for nothing."""
    filled = edges.withColumn("guards", F.filter(F.transform(F.coalesce("guards", F.array().cast("array<string>")), lambda g: F.trim(g)), lambda g: g != ""))
    before = F.sum(F.size("guards")).over(W.partitionBy(*by).orderBy("position").rowsBetween(W.unboundedPreceding, -1))
    counted = filled.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < most)
    in_order = F.array_sort(F.collect_list(F.struct("position", "guards")))
    return counted.groupBy(*by).agg(
        F.sum("strength").alias("strength"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("signals")))).alias("signals"),
        F.slice(F.flatten(F.transform(in_order, lambda x: x["guards"])), 1, most).alias("guards"))


def anchors(paths: DataFrame, rich: DataFrame, goals: DataFrame, most_paths: int = 12, limit: int = 6) -> DataFrame:
    """``start, entry_va, score``: 5 for each time that a node lies on one of a start's first ``most_paths`` paths, its
    richness (``start, entry_va, richness``) and 50 for the goal itself; the ``limit`` best, ties by address."""
    first = F.row_number().over(W.partitionBy("start").orderBy("key"))
    on_paths = paths.withColumn("n", first).where(F.col("n") <= most_paths).select("start", F.explode("path").alias("entry_va"), F.lit(5).alias("score"))
    goal = goals.select(F.col("entry_va").alias("start"), "entry_va", F.lit(50).alias("score")).distinct()
    total = on_paths.unionByName(rich.select("start", "entry_va", F.col("richness").cast("int").alias("score"))).unionByName(goal).groupBy("start", "entry_va").agg(F.sum("score").alias("score"))
    place = F.row_number().over(W.partitionBy("start").orderBy(F.desc("score"), "entry_va"))
    return total.withColumn("place", place).where(F.col("place") <= limit).drop("place")


def of_kind(edges: DataFrame, kind: str = "call") -> DataFrame:
    """Mixed edges of which ``kind`` is one of the kinds."""
    return edges.where(F.array_contains("kinds", kind))


def generations(neighbours: Column, callees: Column, callers: Column, apis: Column, strings: Column, user_most: int = 0, most: int = 6) -> Column:
    """How many generations a goal is worth by what surrounds it: two to five, within ``user_most`` if that is given."""
    weight = neighbours * 2 + callees * 3 + callers * 2 + apis + strings
    found = F.least(F.when(weight >= 120, 5).when(weight >= 60, 4).when(weight >= 25, 3).otherwise(2), F.lit(most))
    return F.greatest(F.lit(1), F.least(found, F.lit(user_most))) if user_most > 0 else found
