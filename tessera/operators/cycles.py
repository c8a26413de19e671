"""Strongly connected components and the depth below each function of a graph with cycles.

What lies close together is settled at once: addresses are cut into cells, and a weakly connected piece within one cell, of which no call leads
into another, is settled in the cell's task.  Of the rest, peeling settles functions from the leaves upwards, as far as no cycle is reached.
Whatever peeling has left is settled in a task once its size is bounded, given how deep the settled calls of its functions are.  If one component
holds much of it, as in a graph of random calls, its functions are found first, as what a busy one reaches and is reached from, and count as one
from then on.  Else what is left falls into weakly connected pieces, and a piece of bounded size is settled whole in a task.
Only larger pieces take further rounds: every node takes the largest
colour that reaches it; a node that keeps its own is the root of the component of all nodes of its colour that reach it.  Edges between
colours are on no cycle and go, and what has no component yet is peeled (from both ends) and coloured again.  Colours are ordered by hash, so a chain
of components falls apart in about the logarithm of its length.  Rounds append what they change to logs; a round reads the logs for the nodes
that it touches.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import kept
from tessera.operators.rounds import Rounds

#: Steps that a cell holds on average, and at most: cells with more are left to the rounds.
CELL_STEPS, MOST_STEPS = 20_000, 200_000
#: Steps of a piece that is settled in one task (some 8 MB of rows); larger pieces take rounds.
PIECE_STEPS = 500_000
#: Rounds in which nodes of one component are looked for, and that they count as one node if they are one node in so many.
GIANT_ROUNDS, GIANT_SHARE = 20, 4


def _roots_and_depths(out: dict[int, list[int]], least_depth: dict[int, int] | None = None) -> dict[int, tuple[int, int]]:
    """Smallest node of each node's strongly connected component, and the depth below it (Tarjan, without recursion), which
    is no less than a member's ``least_depth``."""
    floor = least_depth or {}
    number: dict[int, int] = {}
    low: dict[int, int] = {}
    done: dict[int, tuple[int, int]] = {}
    held: list[int] = []
    for start in out:
        if start in number:
            continue
        number[start] = low[start] = len(number)
        held.append(start)
        path = [(start, iter(out[start]))]
        while path:
            node, rest = path[-1]
            for to in rest:
                if to not in number:
                    number[to] = low[to] = len(number)
                    held.append(to)
                    path.append((to, iter(out.get(to, ()))))
                    break
                if to not in done:
                    low[node] = min(low[node], number[to])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[node])
                if low[node] == number[node]:
                    members = [held.pop()]
                    while members[-1] != node:
                        members.append(held.pop())
                    inside = set(members)
                    deep = max(floor.get(m, 0) for m in members)
                    depth = max(deep, max((done[to][1] + 1 for m in members for to in out.get(m, ()) if to not in inside), default=0))
                    least = min(members)
                    for m in members:
                        done[m] = (least, depth)
    return done


def _settled_in_cell(src: list[int], dst: list[int], touched: set[int]) -> tuple[dict[int, tuple[int, int]], list[tuple[int, int]]]:
    """Component and depth of the nodes of pieces without a ``touched`` node, and the steps of the other pieces."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in zip(src, dst, strict=True):
        root[find(a)] = find(b)
    open_ = {find(x) for x in touched if x in root}
    out, left = defaultdict(list), []
    for a, b in zip(src, dst, strict=True):
        if find(a) in open_:
            left.append((a, b))
        else:
            out[a].append(b)
    return _roots_and_depths(dict(out)), left


def _local(rounds: Rounds, steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node, component, depth`` of the pieces that lie within one cell, and the steps of all others."""
    size = steps.agg(F.count(F.lit(1)).alias("n"), F.min(F.least("src", "dst")).alias("low"), F.max(F.greatest("src", "dst")).alias("high")).first()
    width = float(max(1, (size["high"] - size["low"] + 1) * CELL_STEPS // size["n"])) if size["n"] else 1.0
    cell = lambda c: F.floor(F.col(c).cast("double") / F.lit(width)).cast("long")
    placed = steps.withColumns({"cell": cell("src"), "other": cell("dst")})
    across = placed.where("cell != other")
    if 2 * across.count() > size["n"]:  # calls lead anywhere: little would be settled
        return steps.select(F.col("src").alias("node"), F.col("src").alias("component"), F.lit(0).alias("depth")).limit(0), rounds.keep(steps.distinct(), "left")
    # both ends of a step between cells are touched, in their cells
    ends = across.select("cell", "src").union(across.select("other", "dst")).select("cell", "src", F.lit(None).cast("long").alias("dst"))
    rows = placed.where("cell = other").select("cell", "src", "dst").unionByName(ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, src, dst, touched, full = None, [], [], set(), False

        def emit(found: dict[int, tuple[int, int]], left: list[tuple[int, int]]) -> pa.RecordBatch:
            nodes, values = list(found), list(found.values())
            gone = [None] * len(left)
            return pa.RecordBatch.from_arrays(
                [pa.array(nodes + [a for a, _ in left], pa.int64()), pa.array([c for c, _ in values] + gone, pa.int64()), pa.array([d for _, d in values] + gone, pa.int32()), pa.array([None] * len(nodes) + [b for _, b in left], pa.int64())],
                names=["node", "component", "depth", "dst"])

        def settled() -> pa.RecordBatch:
            return emit({}, list(zip(src, dst, strict=True))) if full else emit(*_settled_in_cell(src, dst, touched))

        for batch in batches:
            for c, a, b in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if c != here:
                    if src:
                        yield settled()
                    here, src, dst, touched, full = c, [], [], set(), False
                if b is None:
                    touched.add(a)
                    continue
                src.append(a)
                dst.append(b)
                if len(src) > MOST_STEPS:
                    full = True
                    yield emit({}, list(zip(src, dst, strict=True)))
                    src, dst = [], []
        if src:
            yield settled()

    done = rounds.keep(rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "node long, component long, depth int, dst long"), "cells")
    left = done.where("dst is not null").select(F.col("node").alias("src"), "dst").unionByName(across.select("src", "dst"))
    return done.where("dst is null").select("node", "component", "depth"), rounds.keep(left.distinct(), "left")


def _peel(rounds: Rounds, steps: DataFrame, name: str, known: DataFrame | None = None, most: int = 0) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Settles the nodes of ``src, dst`` (distinct, no loops) from the leaves upwards, until no more can be settled or
    ``most`` steps are left.  ``known`` (``node, depth``) says how deep nodes are at least.

    ``node, depth`` of the settled nodes: the most steps below each; the steps left, which lead out of all other nodes; ``node,
    depth`` of what is known of their ends; and the number of steps left."""
    held = left = steps.count()
    open_ = rounds.keep(steps.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("open")), f"{name}-open")
    leaves = steps.select(F.col("dst").alias("node")).distinct().join(open_, "node", "left_anti")
    leaves = leaves.withColumn("depth", F.lit(0)) if known is None else leaves.join(known, "node", "left").select("node", F.coalesce("depth", F.lit(0)).alias("depth"))
    # a row says how many more of a node's callees are settled, how deep they are, whether that settles the node, and the round
    first = lambda df, done, k: df.select("node", F.lit(0).cast("long").alias("n"), "depth", F.lit(done).alias("done"), F.lit(k).alias("round"))
    logs, k = [f"{name}-log0"], 0
    if known is not None:
        rounds.append(first(known.join(open_, "node", "left_semi"), False, k), logs[-1])
    last = rounds.append(first(leaves, True, k), logs[-1], "done")
    settled = lambda: reduce(DataFrame.unionByName, (rounds.log(log).where("done") for log in logs))
    # steps to settled nodes; those of the last round are still to be told to their callers
    untold = lambda: steps.join(settled().where(F.col("round") < k).select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
    while rounds.grew and left > most:
        if 2 * left < held:  # rounds go on with what is left, so that many rounds read little
            steps = rounds.keep(untold(), f"{name}-steps")
            open_ = rounds.keep(steps.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("open")), f"{name}-open")
            deep = rounds.log(logs[-1]).where("not done").groupBy("node").agg(F.max("depth").alias("depth")).join(open_, "node", "left_semi")
            logs.append(f"{name}-log{len(logs)}")
            rounds.append(first(deep, False, k), logs[-1])
            held = left
        k += 1
        told = steps.join(last.where("done").select(F.col("node").alias("dst"), "depth"), "dst").groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n"), (F.max("depth") + 1).alias("depth"))
        before = rounds.log(logs[-1]).groupBy("node").agg(F.sum("n").alias("had"), F.max("depth").alias("deep"))
        both = told.join(before, "node", "left").join(open_, "node")
        so_far = F.greatest("depth", F.coalesce("deep", F.lit(0))).alias("depth")
        last = rounds.append(both.select("node", "n", so_far, (F.col("n") + F.coalesce("had", F.lit(0)) == F.col("open")).alias("done"), F.lit(k).alias("round")), logs[-1], "done", "n")
        left -= rounds.total
    rest = rounds.keep(untold(), f"{name}-rest")
    # its ends call, or were settled in the last round
    ends = rest.select(F.col("src").alias("node")).distinct().union(last.where("done").select("node"))
    deep = rounds.log(logs[-1]).groupBy("node").agg(F.max("depth").alias("depth")).join(ends, "node", "left_semi")
    return settled().select("node", "depth"), rest, rounds.keep(deep, f"{name}-known"), left


def _pieces(rounds: Rounds, steps: DataFrame) -> DataFrame:
    """``node, piece`` of the weakly connected pieces of ``src, dst``.  In a round every node goes over to the least of itself and
    its neighbours, in an order that is new in each round, and the links are drawn between those."""
    links = steps.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    ups: list[DataFrame] = []
    rounds.grew = True
    while rounds.grew:
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(len(ups))).alias("h"), F.col(c).alias("node"))
        near = links.union(links.select("b", "a")).groupBy("a").agg(F.min(rank("b")).alias("best"))
        ups.append(rounds.keep(near.select(F.col("a").alias("node"), F.least("best", rank("a"))["node"].alias("piece")), "up"))
        one, other = ups[-1].select(F.col("node").alias("a"), F.col("piece").alias("x")), ups[-1].select(F.col("node").alias("b"), F.col("piece").alias("y"))
        drawn = links.join(one, "a").join(other, "b").where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        links = rounds.append(drawn, f"links{len(ups)}")
    of = ups.pop()
    while ups:
        low = ups.pop().withColumnRenamed("piece", "up")
        of = low.join(of.withColumnRenamed("node", "up"), "up", "left").select("node", F.coalesce("piece", "up").alias("piece"))
    return rounds.keep(of, "pieces")


def _in_tasks(placed: DataFrame, known: DataFrame, tasks: int) -> DataFrame:
    """``node, component, depth`` of the callers in ``piece, src, dst``, each piece in one task.  ``known`` is ``piece, node, depth``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, steps, floor = None, defaultdict(list), {}

        def settled() -> pa.RecordBatch:
            found = [(n, *v) for n, v in _roots_and_depths(dict(steps), floor).items() if n in steps]
            n, c, d = zip(*found, strict=True) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.int32())], names=["node", "component", "depth"])

        held = 0
        for batch in batches:
            for p, a, b, d in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                # small pieces are settled some at a time
                if p != here and held > CELL_STEPS:
                    yield settled()
                    steps, floor, held = defaultdict(list), {}, 0
                here, held = p, held + 1
                if b is None:
                    floor[a] = d
                else:
                    steps[a].append(b)
        yield settled()

    rows = placed.select("piece", "src", "dst", F.lit(None).cast("int").alias("depth")).union(known.select("piece", "node", F.lit(None).cast("long"), "depth"))
    return rows.repartition(tasks, "piece").sortWithinPartitions("piece").mapInArrow(run, "node long, component long, depth int")


def _within(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """Steps both of whose ends aren't among ``nodes``."""
    return steps.join(nodes.select(F.col("node").alias("src")), "src", "left_anti").join(nodes.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")


def _colours(rounds: Rounds, steps: DataFrame, name: str) -> DataFrame:
    """``node, colour``: of the nodes that reach each, itself included, the one with the largest hash (``h, root``)."""
    nodes = steps.select(F.col("src").alias("node")).union(steps.select("dst")).distinct()
    moved = rounds.append(nodes.withColumn("colour", F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("root"))), f"{name}-colours")
    while rounds.grew:
        told = moved.join(steps, moved["node"] == steps["src"]).groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("colour"))
        old = rounds.log(f"{name}-colours").groupBy("node").agg(F.max("colour").alias("old"))
        moved = rounds.append(told.join(old, "node").where("colour > old").select("node", "colour"), f"{name}-colours")
    return rounds.keep(rounds.log(f"{name}-colours").groupBy("node").agg(F.max("colour").alias("colour")), f"{name}-coloured")


def _members(rounds: Rounds, steps: DataFrame, colours: DataFrame, name: str) -> DataFrame:
    """``node, component``: nodes that reach the root of their colour within it.  ``steps`` are within colours."""
    found = rounds.append(colours.where("node = colour.root").select("node", F.col("node").alias("component")), f"{name}-found")
    while rounds.grew:
        back = steps.join(found.select(F.col("node").alias("dst"), "component"), "dst").select(F.col("src").alias("node"), "component").distinct()
        found = rounds.append(back.join(rounds.log(f"{name}-found"), "node", "left_anti"), f"{name}-found")
    return rounds.log(f"{name}-found")


def _cyclic(rounds: Rounds, steps: DataFrame) -> DataFrame:
    """``node, component`` of the components with two nodes or more."""
    k = 0
    out = steps.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    while True:
        turned = lambda df: df.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        steps = _peel(rounds, rounds.keep(steps, f"steps{k}"), f"down{k}")[1]
        _, core, _, left = _peel(rounds, turned(steps), f"up{k}")
        if not left:
            return out
        steps = turned(core)
        colours = _colours(rounds, steps, f"c{k}")
        of_src = colours.select(F.col("node").alias("src"), "colour")
        same = steps.join(of_src, "src").join(colours.select(F.col("node").alias("dst"), F.col("colour").alias("other")), "dst").where("colour = other")
        steps = rounds.keep(same.select("src", "dst"), f"same{k}")
        found = _members(rounds, steps, colours, f"m{k}")
        out = out.unionByName(found)
        steps = _within(steps, found)
        k += 1


def strong_components(calls: DataFrame) -> DataFrame:
    """``entry_va, component`` for every function of ``calls`` (``entry_va, callee_va``): the smallest function of its
    strongly connected component.  Nulls are no functions; self calls and repeated calls change nothing."""
    return condensed_depth(calls).select("entry_va", "component")


def _depths(rounds: Rounds, steps: DataFrame, name: str, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """As ``_peel``, but what is left is settled in a task if it is small: ``node, component, depth``, and what is still left."""
    done, rest, known, left = _peel(rounds, steps, name, known, PIECE_STEPS)
    done = done.select("node", F.col("node").alias("component"), "depth")
    if 0 < left <= PIECE_STEPS:
        one = F.lit(0).cast("long").alias("piece")
        done = done.unionByName(rounds.keep(_in_tasks(rest.select(one, "src", "dst"), known.select(one, "node", "depth"), 1), f"{name}-task"))
        left = 0
    return done, rest, known, left


def _giant(rounds: Rounds, steps: DataFrame, name: str) -> DataFrame | None:
    """``node`` of those that a node with many callers and callees reaches and is reached from in ``GIANT_ROUNDS`` rounds, which are of one
    component (all of it, if they are enough); None if they aren't a node in ``GIANT_SHARE``.  Each way every node is reached once."""
    ends = steps.select(F.col("src").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(steps.select("dst", F.lit(0), F.lit(1)))
    met = ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("in").alias("in"))
    row = met.agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(F.least("out", "in").alias("least"), "node")).alias("most")).first()
    log, k = f"{name}-reach", 0
    start = F.lit(row["most"]["node"]).cast("long").alias("node")
    moved = rounds.append(rounds.spark.range(2).select(start, (F.col("id") == 0).alias("down")), log)
    while rounds.grew and k < GIANT_ROUNDS:
        k += 1
        down = steps.join(moved.where("down").select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node"), F.lit(True).alias("down"))
        up = steps.join(moved.where("not down").select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), F.lit(False).alias("down"))
        moved = rounds.append(down.union(up).distinct().join(rounds.log(log), ["node", "down"], "left_anti"), log)
    found = rounds.keep(rounds.log(log).groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("node"), f"{name}-giant")
    return found if GIANT_SHARE * found.count() >= row["n"] else None


def _spread(rounds: Rounds, steps: DataFrame, known: DataFrame | None = None, k: int = 0, look: bool = True) -> DataFrame:
    """``node, component, depth`` of the nodes of ``src, dst`` (distinct, no loops), in rounds.  ``known`` (``node, depth``) says how
    deep nodes are at least."""
    out, rest, known, left = _depths(rounds, steps, f"all{k}", known)
    if not left:
        return out
    giant = _giant(rounds, rest, f"all{k}") if look else None
    return out.unionByName(_without(rounds, rest, known, giant, left, k) if giant is not None else _by_pieces(rounds, rest, known, left))


def _without(rounds: Rounds, steps: DataFrame, known: DataFrame, giant: DataFrame, left: int, k: int) -> DataFrame:
    """``node, component, depth`` of the nodes of ``steps``, all of which call, where ``giant`` are nodes of one component."""
    least = F.lit(giant.agg(F.min("node")).first()[0]).cast("long")
    one = lambda df, c: df.join(giant.select(F.col("node").alias(c), least.alias(f"{c}_one")), c, "left")
    met = one(one(steps, "src"), "dst").where("src_one is null or dst_one is null")
    met = met.select(F.coalesce("src_one", "src").alias("src"), F.coalesce("dst_one", "dst").alias("dst"))
    met = rounds.keep(met.distinct(), f"all{k}-met")
    deep = rounds.keep(one(known, "node").groupBy(F.coalesce("node_one", "node").alias("node")).agg(F.max("depth").alias("depth")), f"all{k}-deep")
    # another such component is looked for while each takes half of the steps
    found = _spread(rounds, met, deep, k + 1, 2 * met.count() <= left)
    # without a step left, they are a component of their own
    row = found.where(F.col("node") == least).select("component", "depth").first() or deep.where(F.col("node") == least).select(F.col("node").alias("component"), "depth").first()
    of = giant.select("node", F.lit(row["component"]).cast("long").alias("component") if row else least.alias("component"), F.lit(row["depth"] if row else 0).alias("depth"))
    return found.where(F.col("node") != least).unionByName(of)


def _by_pieces(rounds: Rounds, rest: DataFrame, known: DataFrame, left: int) -> DataFrame:
    """``node, component, depth`` of the nodes of ``rest``, all of which call: weakly connected pieces in tasks, large ones in rounds."""
    of = _pieces(rounds, rest)
    placed = rounds.keep(rest.join(of.withColumnRenamed("node", "src"), "src").select("piece", "src", "dst"), "placed")
    large = rounds.append(placed.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PIECE_STEPS).select("piece"), "large")
    any_large = rounds.grew
    deep = known.join(of, "node").join(large, "piece", "left_anti")
    out = rounds.keep(_in_tasks(placed.join(large, "piece", "left_anti"), deep, left // (5 * CELL_STEPS) + 1), "settled-pieces")
    if not any_large:
        return out
    steps = rounds.keep(placed.join(large, "piece", "left_semi").select("src", "dst"), "large-steps")
    found = rounds.keep(_cyclic(rounds, steps), "members")
    found = found.join(found.groupBy("component").agg(F.min("node").alias("least")), "component").select("node", F.col("least").alias("component"))
    # nothing is settled here, so every node calls
    nodes = steps.select(F.col("src").alias("node")).distinct()
    of = nodes.join(found, "node", "left").join(known, "node", "left").select("node", F.coalesce("component", "node").alias("component"), F.coalesce("depth", F.lit(0)).alias("depth"))
    of = rounds.keep(of, "components")
    one, other = of.select(F.col("node").alias("src"), F.col("component").alias("a")), of.select(F.col("node").alias("dst"), F.col("component").alias("b"))
    condensed = steps.join(one, "src").join(other, "dst").where("a != b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    least = rounds.keep(of.groupBy(F.col("component").alias("node")).agg(F.max("depth").alias("depth")), "least")
    depth = _depths(rounds, rounds.keep(condensed, "condensed"), "condensed-down", least)[0]
    depth = least.unionByName(depth.select("node", "depth")).groupBy(F.col("node").alias("component")).agg(F.max("depth").alias("depth"))
    return out.unionByName(of.select("node", "component").join(depth, "component").select("node", "component", "depth"))


def condensed_depth(calls: DataFrame) -> DataFrame:
    """``entry_va, component, depth``: the most calls in a row below each function where each component counts as one
    function, so calls within a cycle add nothing.  Without cycles it is the longest path down."""
    with Rounds(calls.sparkSession, "depth") as rounds:
        given = rounds.keep(calls.select("entry_va", "callee_va"), "calls")
        met = given.where(F.col("entry_va").isNotNull() & F.col("callee_va").isNotNull())
        near, steps = _local(rounds, met.where("entry_va != callee_va").select(F.col("entry_va").alias("src"), F.col("callee_va").alias("dst")))
        found = near.unionByName(_spread(rounds, steps)) if steps.limit(1).count() else near
        # functions of which only calls to themselves or to none are known
        lone = given.where("entry_va is null or callee_va is null or entry_va = callee_va").select(F.explode(F.array("entry_va", "callee_va")).alias("node")).where("node is not null").distinct()
        lone = rounds.keep(lone, "lone")
        # few: what is found of them is looked up before the join
        lone = lone.join(found.join(lone, "node", "left_semi").select("node"), "node", "left_anti").select("node", F.col("node").alias("component"), F.lit(0).alias("depth"))
        out = found.unionByName(lone)
        return kept(out.select(F.col("node").alias("entry_va"), "component", "depth"), "depth")


def deepest(depths: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """``depth``, the deepest of all functions, or of those ``only`` (``entry_va``); 0 where there is none."""
    if only is not None:
        depths = depths.join(only.select("entry_va").distinct(), "entry_va", "left_semi")
    return depths.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("depth"))
