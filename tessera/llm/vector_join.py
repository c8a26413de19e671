"""Exact range join of vectors by cosine: pivots, boundary replication, independent cells.

1. Equal vectors of one label are one class; a class stands for all its rows.
2. A cell (at first a label's vectors of one length) with too many rows gets pivots: rows of a bounded sample that are far
   from each other, moved to the means of what is nearest to them.  Which pivots there are decides the work only.
3. Every row goes to its nearest pivot and, because of the triangle inequality, to each pivot whose
   boundary is within half the radius: of two rows within the radius one at least is that near to the
   boundary between them.  Cells that are still too large are split again.  Cells that splitting doesn't shrink are
   dealt out as pairs of blocks.
4. Rows within half the radius of their pivot are all within the radius of each other.  Such a core is counted, not compared.
5. Cells join independently.  A pair that meets in two cells counts in the one of the lower pivot.
   A cell returns a number of links for each row and a spanning forest, never its pairs.
6. Links are summed by class, and connected components of the forests give the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage
from .components import connected_components
from .vector_codes import usable

#: A cell with more rows is split: comparing a row with so many others costs about as much as sending it to the few
#: cells that splitting would.  A cell that can't be split is dealt out in blocks of so many rows.
CELL_ROWS, BLOCK_ROWS = 4096, 4096
#: At most so many pivots for a cell (a row keeps the cells that it goes to as bits of a long), chosen among so many rows.
PIVOTS, SAMPLE_ROWS = 48, 1024
#: Rows of one cell that a task splits at once.
SPLIT_ROWS = 1 << 15
#: A part of a cell is split again if it has less than this share of the cell's rows, and at most so many times in all.
SHRINK, LEVELS = 0.7, 6
#: Distances are compared with this room, and cosines nearer to the bound are computed again for the pair alone.
ROOM = 1e-9
#: Tables of up to so many small rows are broadcast.
BROADCAST_ROWS = 100_000

_CELLS = "cell string, before long, node long, n long, own boolean, homes array<int>, masks array<long>, core string"


def units(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one length, and the same at length 1."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    raw = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw, x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    """Cosine of one pair."""
    return float((x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())))


def choose_pivots(x: np.ndarray, most: int, apart: float) -> np.ndarray:
    """Up to ``most`` centres: rows taken one after another, each farthest from those before and more than
    ``apart`` from them, then moved to the means of the rows nearest to each."""
    at, far = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(at) < most and far.max() > apart * apart:
        at.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[at[-1]]) ** 2).sum(axis=1))
    centres = x[at]
    home = (-2 * x @ centres.T + (centres * centres).sum(axis=1)).argmin(axis=1)
    sums = np.zeros_like(centres)
    np.add.at(sums, home, x)
    return sums / np.bincount(home, minlength=len(centres))[:, None]


def _split(rows: pa.Table, pivots: pa.Table, radius: float) -> pa.Table:
    """Rows of a cell in the cells of its pivots."""
    if not rows.num_rows:
        return rows.drop_columns(["salt", "size"])
    _, x = units(rows.column("vector"))
    centres = np.array(pivots.column("centres")[0].as_py()).reshape(-1, x.shape[1])
    square = (centres * centres).sum(axis=1)
    far = np.maximum(0, 1 - 2 * x @ centres.T + square)
    home = far.argmin(axis=1)
    nearest = far[np.arange(len(x)), home]
    between = np.sqrt(np.maximum(0, square[:, None] - 2 * centres @ centres.T + square))
    # a row's distance to the boundary of its own pivot and another one, times twice the pivots' distance
    goes = far - nearest[:, None] <= 2 * between[home] * (radius / 2 + ROOM)
    goes[np.arange(len(x)), home] = True
    masks = (goes * (1 << np.arange(len(centres), dtype=np.int64))).sum(axis=1)
    row, to = np.nonzero(goes)
    cell, core = rows.column("cell")[0].as_py(), rows.column("core").to_pylist()
    names = [f"{cell}/{q}" for q in range(len(centres))]
    own = np.array(rows.column("own").to_pylist())
    inside = own & (np.sqrt(nearest) <= radius / 2 - ROOM)
    core = [c or (names[h] if within else None) for c, h, within in zip(core, home.tolist(), inside.tolist(), strict=True)]
    homes = [[*old, h] for old, h in zip(rows.column("homes").to_pylist(), home.tolist(), strict=True)]
    masks = [[*old, m] for old, m in zip(rows.column("masks").to_pylist(), masks.tolist(), strict=True)]
    new = {
        "cell": pa.array([names[q] for q in to.tolist()], pa.string()), "before": rows.column("size").take(row),
        "own": pa.array(own[row] & (to == home[row])),
        "homes": pa.array(homes, pa.list_(pa.int32())).take(row), "masks": pa.array(masks, pa.list_(pa.int64())).take(row), "core": pa.array(core, pa.string()).take(row),
    }
    rows = rows.drop_columns(["salt", "size"])
    return pa.table({name: new[name] if name in new else rows.column(name).take(row) for name in rows.column_names})


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def cells(classes: DataFrame, radius: float, cell_rows: int = CELL_ROWS) -> tuple[DataFrame, list[str]]:
    """``classes`` (``cell, node, n, vector``) in cells that need no more splitting, and the staged tables that hold them."""
    kind = dict(classes.dtypes)["vector"]
    none = F.array().cast("array<int>")
    pending = classes.select("cell", F.lit(1 << 62).alias("before"), "node", "n", F.lit(True).alias("own"), none.alias("homes"), none.cast("array<long>").alias("masks"), F.lit(None).cast("string").alias("core"), "vector")
    done, paths = [], []

    def choose(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")
        most = min(PIVOTS, max(2, 4 * rows.column("size")[0].as_py() // cell_rows))
        centres = choose_pivots(units(rows.column("vector"))[1], most, radius)
        return pa.table({"cell": rows.column("cell")[:1], "size": rows.column("size")[:1], "centres": pa.array([centres.ravel().tolist()], pa.list_(pa.float64()))})

    for _ in range(LEVELS):
        sizes = pending.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.min("before").alias("was"))
        large = stage(sizes.where((F.col("size") > cell_rows) & (F.col("size") < SHRINK * F.col("was"))).select("cell", "size"), "large-cells")
        if not large.limit(1).count():
            break
        marked = pending.join(_small(large), "cell", "left")
        done.append(marked.where("size is null").drop("size"))
        marked = marked.where("size is not null")
        sample = marked.where(F.pmod(F.xxhash64("node"), "size") < SAMPLE_ROWS)
        pivots = sample.groupBy("cell").applyInArrow(choose, "cell string, size long, centres array<double>")
        salts = F.ceil(F.col("size") / SPLIT_ROWS)
        pivots = stage(pivots, "pivots").withColumn("salt", F.explode(F.sequence(F.lit(0), (salts - 1).cast("int"))))
        # a sample may have missed every row of a cell, which then stays as it is
        known = pivots.select("cell").distinct()
        done.append(marked.join(known, "cell", "left_anti").drop("size"))
        marked = marked.join(known, "cell", "left_semi").withColumn("salt", F.pmod(F.xxhash64("node", F.lit(1)), salts).cast("int"))
        parts = marked.groupBy("cell", "salt").cogroup(pivots.groupBy("cell", "salt"))
        pending = stage(parts.applyInArrow(lambda rows, own: _split(rows, own, radius), f"{_CELLS}, vector {kind}"), "cells")
        paths.append(pending.staged_path)
    for more in done:
        pending = pending.unionByName(more)
    return pending, paths


def _roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the groups of ``i`` and ``j`` in ``root``, which holds every row's smallest member."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


def join_cell(rows: pa.Table, cosine_at_least: float) -> pa.Table:
    """Links of every row of a cell, or between two blocks of one, that no other cell counts."""
    block = rows.column("block").to_numpy()
    first, other = rows.column("first")[0].as_py(), rows.column("second")[0].as_py()
    rows = rows.take(pa.array(np.argsort(block, kind="stable")))
    m, cut = rows.num_rows, rows.num_rows if first == other else int((block == first).sum())
    raw, x = units(rows.column("vector"))
    n = rows.column("n").to_numpy()
    path = [int(p) for p in rows.column("cell")[0].as_py().split("/")[1:]]
    homes, masks = (np.array(rows.column(c).to_pylist(), dtype=np.int64).reshape(m, len(path)) for c in ("homes", "masks"))
    core = rows.column("core").combine_chunks().dictionary_encode()
    core = core.indices.fill_null(-1).to_numpy()
    links, root = np.zeros(m, dtype=np.int64), np.arange(m)
    for at in range(0, cut, 256):
        to = min(cut, at + 256)
        begin = at if first == other else cut
        near = x[at:to] @ x[begin:].T
        i, j = np.nonzero(near >= cosine_at_least - ROOM)
        score = near[i, j]
        i, j = i + at, j + begin
        ok = (i < j) & ((core[i] != core[j]) | (core[i] < 0))
        for level, c in enumerate(path):
            hi, hj = homes[i, level], homes[j, level]
            # where a pair meets in the cells of both, the lower one counts it
            ok &= ((hi == c) | (hj == c)) & ((hi == hj) | ~(((hi == c) & (hj < c) & (masks[i, level] >> hj & 1 == 1)) | ((hj == c) & (hi < c) & (masks[j, level] >> hi & 1 == 1))))
        i, j, score = i[ok], j[ok], score[ok]
        doubtful = np.flatnonzero(np.abs(score - cosine_at_least) <= ROOM)
        out = [k for k in doubtful.tolist() if cosine(raw[i[k]], raw[j[k]]) < cosine_at_least]
        i, j = np.delete(i, out), np.delete(j, out)
        np.add.at(links, i, n[j])
        np.add.at(links, j, n[i])
        _roots(root, i, j)
    node = rows.column("node").to_numpy()
    has = links > 0
    return pa.table({"node": node[has], "links": links[has], "to": node[root[has]]})


def _links(found: DataFrame, cosine_at_least: float, block_rows: int) -> DataFrame:
    """``node, links, to`` of all cells: what each adds to a node's links, and a node that it is joined to."""
    own = found.where("own and core is not null")
    sums = stage(own.groupBy("core").agg(F.sum("n").alias("total"), F.min("node").alias("to")), "cores")
    cored = own.join(_small(sums), "core").select("node", (F.col("total") - F.col("n")).alias("links"), "to")
    sizes = found.groupBy("cell", "core").agg(F.count(F.lit(1)).alias("rows"))
    most = F.max_by(F.when(F.col("core").isNotNull(), F.col("core")), F.when(F.col("core").isNotNull(), F.col("rows")))
    sizes = sizes.groupBy("cell").agg(F.sum("rows").alias("size"), most.alias("main"), F.max(F.when(F.col("core").isNotNull(), F.col("rows"))).alias("inside"))
    # the main core of a cell isn't compared with itself: its blocks meet the others only
    inside = F.when(F.col("inside") > block_rows, F.col("inside")).otherwise(0)
    large = sizes.where(F.col("size") > block_rows).select("cell", F.when(inside > 0, F.col("main")).alias("main"), F.ceil((F.col("size") - inside) / block_rows).cast("int").alias("free"), F.ceil(inside / block_rows).cast("int").alias("held"))
    rows = found.join(_small(stage(large, "dealt-cells")), "cell", "left")
    held = F.coalesce(F.col("core") == F.col("main"), F.lit(False))
    deal = F.xxhash64("node", F.lit(2))
    block = F.when(F.col("free").isNull(), 0).when(held, F.col("free") + F.pmod(deal, "held")).otherwise(F.pmod(deal, F.greatest("free", F.lit(1)))).cast("int")
    others = F.when(F.col("free").isNull(), 1).when(held, F.col("free")).otherwise(F.col("free") + F.col("held"))
    dealt = rows.withColumn("block", block).withColumn("others", others).where("others > 0").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    dealt = dealt.select("cell", "node", "n", "homes", "masks", "core", "vector", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    joined = dealt.groupBy("cell", "first", "second").applyInArrow(lambda t: join_cell(t, cosine_at_least), "node long, links long, to long")
    return joined.unionByName(cored)


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine_at_least: float = 0.98, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``df``, under the given name of the identifier.

    Rows of one label whose vectors have a cosine of ``cosine_at_least`` or more are linked; ``n_links`` counts the other rows linked
    directly, the component is the smallest identifier reachable, itself included, and ``kept`` says whether it is the row's own.
    Null labels and vectors that are null, empty, zero or hold null or non-finite components link with nothing, and neither do
    vectors of different lengths.  Every row is a vector of its own, those that repeat an identifier as well.  A row without
    identifier links and is counted; where no row of its component has an identifier, that is null and the row
    stays.  Other columns are ignored; an empty table gives an empty result.
    """
    spark = df.sparkSession
    radius = float(np.sqrt(2 - 2 * cosine_at_least))
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    ok = F.coalesce(usable(F.col("vector")) & F.exists("vector", lambda x: x != 0) & F.col("label").isNotNull(), F.lit(False))
    classes = rows.where(ok).groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    cell = F.concat_ws(":", F.hex(F.col("label").cast("string")), F.size("vector"))
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("cell", cell), "vector-classes")
    found, paths = cells(classes, radius, cell_rows)
    found = stage(_links(found, cosine_at_least, block_rows), "vector-links")
    for path in paths:
        unstage(spark, path)
    comps = connected_components(found, "node", "to")
    named = comps.join(classes.select("node", "rep"), "node")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    comps = named.join(least, "component").select("node", "component_id")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    by_class = classes.join(links, "node", "left").join(comps, "node", "left").select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    linked = rows.where(ok).join(by_class, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    out = linked.unionByName(rows.where(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull())).select(F.col("vec_id").alias(id_col), "n_links", "component_id", "kept")
